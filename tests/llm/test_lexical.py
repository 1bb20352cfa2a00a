"""Block-Max MaxScore against scores of all documents, and its index against plain counts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweave.llm.lexical import Shard, all_scores, best_documents, build_index, from_varints, open_blocks, posting_blocks, rank_documents, search, term_counts, term_weight, terms_of, to_varints

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, queries, k=10):
    """item, rank, doc_id, score in Python integers; docs are (doc_id, text)."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        terms, found = set(plain_terms(text)), []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


ODD_TEXTS = ["", None, "a1-B2_c3", "É é ÀB x", "\x00a\x7fb", "漢字 語", " , ", "z" * 50, "A" * 5 + "[" + "b", "@@x`y{z~"]


def test_terms():
    assert [[w.decode() for w in x] for x in terms_of(pa.array(ODD_TEXTS)).to_pylist()] == [plain_terms(t) for t in ODD_TEXTS]
    for size in (1, 3, 7, 1 << 20):
        counts = [Counter() for _ in ODD_TEXTS]
        for words, term, doc, tf in term_counts(pa.array(ODD_TEXTS), size):
            for w, d, n in zip(term, doc, tf):
                counts[d][words[int(w)].as_py().decode()] += int(n)
        assert counts == [Counter(plain_terms(t)) for t in ODD_TEXTS]


def test_codes_come_back():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 21, 28, 31, 45)])
    data, at = to_varints(values)
    assert (from_varints(data) == values).all() and at[-1] == len(data)
    term = np.sort(rng.integers(0, 5, 2000))
    doc = np.concatenate([np.sort(rng.choice(10**6, (term == t).sum(), replace=False)) for t in range(5)])
    tf, impact = rng.integers(1, 400, 2000), rng.integers(0, 1000, 2000)
    start, size, top, last, payload = posting_blocks(term, doc, tf, impact)
    for blocks in (np.arange(len(start)), np.array([1, 4, 7])):
        d, c = open_blocks([payload[int(b)].as_py() for b in blocks], size[blocks], doc[start[blocks]])
        at = np.concatenate([np.arange(start[b], start[b] + size[b]) for b in blocks])
        assert (d == doc[at]).all() and (c == tf[at]).all()
    assert (top == [impact[s : s + n].max() for s, n in zip(start, size)]).all() and (last == [doc[s + n - 1] for s, n in zip(start, size)]).all()


def zipf_texts(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    return [" ".join(rnd.choices(words, weights, k=rnd.choice((0, 3, 30, 30, 200)))) for _ in range(n)]


def test_pruned_search_equals_all_scores_and_opens_few_blocks(spark):
    """One shard of 12,000 documents; most blocks of the queries' lists stay compressed."""
    texts = zipf_texts(12_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    index = build_index(docs, shard_bytes=1 << 30)
    rows = index.read().toArrow()
    assert index.read().select("shard").distinct().count() == 1
    df = {r["term"]: r["n"] for r in index.read().where("term is not null").groupBy("term").agg(F.sum("postings").alias("n")).toArrow().to_pylist()}
    opened = whole = 0
    for seed in range(40):
        words = random.Random(seed).choice([t for t in texts if t.count(" ") == 199]).split()
        terms = {w.encode() for w in sorted(words, key=lambda w: -int(w[1:]))[:3] + ["w0", "w1", "w2", "w3", "w4", "w5"]}
        weights = {t: term_weight(index.docs, df[t]) for t in terms}
        shard = Shard.of(rows, index.docs, index.terms)
        doc, score = best_documents(shard, weights, 10, width=1024)
        opened, whole = opened + len(shard.opened), whole + sum(b - a for t, (a, b) in shard.lists.items() if t in terms)
        every = all_scores(Shard.of(rows, index.docs, index.terms), weights)
        order = np.lexsort((shard.ids, -every))[:10]
        assert doc.tolist() == order.tolist() and score.tolist() == every[order].tolist()
    assert opened < 0.5 * whole, (opened, whole)


def test_shards_and_blocks_of_queries_give_the_same(spark):
    texts = zipf_texts(600, 2)
    texts[5], texts[17] = "w1 " * 30_000 + "w2", texts[4]
    rows, queries = list(enumerate(texts)), [(i, texts[i * 7]) for i in range(40)] + [(99, texts[3]), (None, "w5 w6"), (98, None), (97, "unknown"), (96, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    table = spark.createDataFrame(queries, "item_id bigint, text string")
    want = brute(rows, queries)
    assert got(search(build_index(docs, shard_bytes=20_000), table)) == want
    assert got(search(build_index(docs), table, items=7)) == want
    assert got(search(build_index(docs), table, size=200)) == want


def test_ties_nulls_repeats_and_clashes(spark, odd, clash, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    queries = [("a", "the CAT sat nobody"), ("b", "hund 漢字 é"), ("a", "the CAT sat nobody")]
    table = spark.createDataFrame(queries, "item_id string, text string").select(F.lit(0).alias("TEXT"), F.lit(0).alias("rank"), "*")
    want = brute(rows, queries)
    assert got(rank_documents(odd, table)) == want and got(rank_documents(clash, table)) == want
    assert got(rank_documents(none, table)) == [] and got(rank_documents(odd, table.limit(0))) == []
    same = spark.createDataFrame([(i, "alpha beta") for i in (5, 3, None, 9, 3)] + [(50 + i, "other") for i in range(20)], "doc_id bigint, text string").repartition(4)
    assert [r[2] for r in got(rank_documents(same, spark.createDataFrame([("q", "beta")], "item_id string, text string")))] == [3, 3, 5, 9, None]
