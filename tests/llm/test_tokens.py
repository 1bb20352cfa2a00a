"""Token files, BPE tables and packing against the library itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm.bpe import encode_and_decode, split_words
from docweave.llm.encoders import PieceEncoder
from docweave.llm.packing import PackFit, bm25_idf, blocked, candidates, choose, fill, listed, nearest, pack
from docweave.llm.queries import BYTE_BPE, WORD_BPE
from docweave.llm.token_output import OrcLayout, read_token_ids, token_file_report, write_token_ids


def ids_of(vocabulary, text):
    return Tokenizer.from_file(vocabulary).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_texts(n=3000):
    rnd = random.Random(3)
    parts = [" ", " ", "\n", "\t", "a", "B", "é", "1", ".", "'s", ",", "́", "Σ", "<|endoftext|>", "\x85", "漢", "İ", "!!"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize(("vocabulary", "keeps_space"), [(BYTE_BPE, True), (WORD_BPE, False)])
@pytest.mark.parametrize("limit", [400_000, 50])
def test_pieces_give_the_ids_of_whole_texts(vocabulary, keeps_space, limit):
    texts, enc, t = odd_texts(), PieceEncoder(vocabulary, keeps_space, limit), Tokenizer.from_file(vocabulary)
    for i in range(0, len(texts), 500):
        want = [np.array(e.ids, enc.dtype).tobytes() for e in t.encode_batch(texts[i : i + 500], add_special_tokens=False)]
        ids, at = enc.encode(pa.array(texts[i : i + 500]))
        assert [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] == want


def test_words_make_up_the_text():
    t = Tokenizer.from_file(BYTE_BPE)
    for text in odd_texts(1000):
        words = split_words(text, BYTE_BPE)
        assert "".join(words) == text
        assert [i for w in words for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


def test_token_files(odd, none, docs):
    for df in (odd, docs):
        start = 0
        rows = df.select("doc_id", "text").collect()
        got = sorted((tuple(r) for r in token_file_report(df, BYTE_BPE).collect()), key=lambda r: r[1])
        for r, g in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")), got, strict=True):
            ids = [*ids_of(BYTE_BPE, r[1]), 0]
            assert g == (r[0], start, len(ids), crc(ids))
            start += len(ids)
    assert token_file_report(none, BYTE_BPE).count() == 0


def test_token_files_are_pruned(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    write_token_ids(docs, path, BYTE_BPE, layout=OrcLayout(stripe_bytes=1 << 16, index_stride=1000))
    some = read_token_ids(spark, path, [5, 7])
    assert "PushedFilters: [In(doc_id, [5,7])]" in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in some.collect()) == [5, 7]


def test_encode_and_decode(odd, none, docs):
    for df in (odd, docs):
        got = sorted(map(tuple, encode_and_decode(df, BYTE_BPE).collect()), key=str)
        t, want = Tokenizer.from_file(BYTE_BPE), []
        for doc_id, text in df.select("doc_id", "text").collect():
            ids = ids_of(BYTE_BPE, text)
            want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert encode_and_decode(none, BYTE_BPE).count() == 0


@pytest.mark.parametrize("fit", [PackFit(), PackFit(window=64, shard_docs=7)])
def test_packing_loses_nothing(odd, none, docs, fit):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        got = pack(df, WORD_BPE, fit=fit).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for p in got:
            pieces[p["doc_id"]].append(p)
            sequences[p["sequence_id"]].append(p)
        assert set(pieces) == {r[0] for r in rows}
        want = sorted((r[0], len(ids_of(WORD_BPE, r[1])) + 1) for r in rows if r[0] is not None)
        assert sum(p["length"] for p in got) == sum(n for _, n in want) + sum(len(ids_of(WORD_BPE, r[1])) + 1 for r in rows if r[0] is None)
        for s in sequences.values():
            at = 0
            for p in sorted(s, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= fit.window
        for r in rows:
            ids, at = [*ids_of(WORD_BPE, r[1]), 2], 0
            if len([x for x in rows if x[0] == r[0]]) == 1:
                for p in sorted(pieces[r[0]], key=lambda p: p["start"]):
                    assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), crc(ids[at : at + p["length"]]))
                    at += p["length"]
                assert at == len(ids)
    assert pack(none, WORD_BPE).count() == 0


def test_neighbours_share_words(spark):
    """Documents of one topic land in the same windows more often than chance has it."""
    rnd = random.Random(5)
    topics = [[f"{a}{b}" for b in "bcdfghjklmnp"] for a in ("alpha", "gamma", "delta", "omega")]
    rows = [(i, " ".join(rnd.choice(topics[i % 4]) for _ in range(40))) for i in range(200)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), WORD_BPE, fit=PackFit(window=1024)).collect()
    by = defaultdict(set)
    for p in got:
        by[p["sequence_id"]].add(p["doc_id"])
    same = [a % 4 == b % 4 for s in by.values() for a in s for b in s if a < b]
    assert sum(same) / len(same) > 0.6


def bm25(docs, fit):
    """Score of a document for a seed over the whole corpus; terms of one document find nothing."""
    df = np.bincount(np.concatenate([np.unique(x) for x in docs.values()]))
    idf, mean = np.where(df > 1, np.maximum(0, np.log((len(docs) - df + 0.5) / (df + 0.5))), 0), sum(map(len, docs.values())) / len(docs)

    def score(seed, doc):
        x, terms = docs[doc], np.unique(docs[seed])
        tf = np.array([(x == t).sum() for t in terms], float)
        return float((idf[terms] * tf * (fit.k1 + 1) / (tf + fit.k1 * (1 - fit.b + fit.b * len(x) / mean))).sum())

    return score


def some_topics(n=120):
    rnd = random.Random(9)
    topics = [[f"{a}{b}" for b in "bcdfghjklmnp"] for a in ("alpha", "gamma", "delta", "omega")]
    return [(i, " ".join(rnd.choice(topics[i % 4]) for _ in range(rnd.randint(20, 60)))) for i in range(n)]


def placed_by_brute_force(docs, score, seeds, fit):
    """seed, doc: documents ask their best seed, seeds take their best until full, refused documents ask again."""
    need = {s: fit.window - len(docs[s]) % fit.window for s in seeds}
    free, out = [d for d in docs if d not in seeds], set()
    for _ in range(fit.rounds):
        asked = defaultdict(list)
        for d in free:
            best = max(((round(score(s, d), 4), -s) for s in seeds if need[s] > 0 and score(s, d) > 0), default=None)
            if best:
                asked[-best[1]].append((-best[0], d))
        for s, who in asked.items():
            for _, d in sorted(who):
                if need[s] > 0:
                    need[s] -= len(docs[d])
                    out.add((s, d))
        free = [d for d in free if not any(d == x for _, x in out)]
    return out


def test_search_and_choice_equal_brute_force(spark):
    """With all terms and unbounded lists, scores are BM25 over the whole corpus, and choices are those of brute force."""
    fit = PackFit(window=512, terms=60, list_docs=10**9, shard_docs=10**6, reach=10**6, generations=1)
    docs = {i: np.array([*ids_of(WORD_BPE, t), 2]) for i, t in some_topics()}
    df, mean = np.bincount(np.concatenate([np.unique(x) for x in docs.values()])), sum(map(len, docs.values())) / len(docs)
    score = bm25(docs, fit)
    schema = "key bigint, doc_id bigint, length bigint, ids binary"
    encoded = spark.createDataFrame([(i, i, len(x), x.astype("<u2").tobytes()) for i, x in docs.items()], schema).repartition(3)
    known = listed(encoded, bm25_idf(df, len(docs)), mean, np.dtype("<u2"), fit)
    seeds = [i for i in docs if i % 9 == 0]
    found = candidates(known.withColumn("need", F.expr("if(key % 9 = 0, 512 - length % 512, null)")), 1, fit).collect()
    want = {(s, d): score(s, d) for s in seeds for d in docs if d not in seeds and score(s, d) > 0}
    assert {(r["seed"], r["doc"]) for r in found} == {*want}
    for r in found:
        assert r["score"] == pytest.approx(want[r["seed"], r["doc"]], rel=1e-5)
    again = spark.createDataFrame([(*r[:4], round(r["score"], 4)) for r in found], "seed bigint, doc bigint, length bigint, need bigint, score double")
    got = {(r["seed"], r["doc"]) for t in choose(again, fit) for r in t.collect()}
    assert got == placed_by_brute_force(docs, score, seeds, fit)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_keys_of_several_terms_give_the_same_scores(spark, width):
    """Documents that share as many of their strongest terms as a key joins score the sum of these terms' weights."""
    fit = PackFit(window=512, terms=5, list_docs=10**9, shard_docs=10**6, reach=10**6)
    rnd = random.Random(4)
    rows = [(i, 100, sorted(rnd.sample(range(12), rnd.randint(0, 5))), 400 if i % 5 == 0 else None) for i in range(60)]
    weights = {(i, t): rnd.randint(1, 9) / 4 for i, _, terms, _ in rows for t in terms}
    free = spark.createDataFrame([(i, n, t, [weights[i, x] for x in t], need) for i, n, t, need in rows], "key bigint, length bigint, terms array<int>, weights array<float>, need bigint")
    got = {(r["seed"], r["doc"]): r["score"] for r in candidates(free, width, fit).collect()}
    want = {}
    for i, _, a, need in rows:
        for j, _, b, other in rows:
            if need and not other and len({*a} & {*b}) >= width:
                want[i, j] = sum(weights[j, t] for t in {*a} & {*b})
    assert got == pytest.approx(want)


def test_long_lists_are_dealt_into_shards(spark):
    """A key that all documents share makes no more pairs than shards hold, and nothing is lost."""
    fit = PackFit(window=512, terms=2, shard_docs=10)
    free = spark.createDataFrame([(i, 10, [7, 8], [1.0, 1.0], 500 if i % 5 == 0 else None) for i in range(1000)], "key bigint, length bigint, terms array<int>, weights array<float>, need bigint").repartition(4)
    found = candidates(free, 2, fit).collect()
    assert 0 < len(found) <= 200 * 10
    assert len({r["doc"] for r in found}) > 700


def as_packed(docs, fit):
    """The rows that ``pack`` searches, and each document's weights by term."""
    texts = {r["doc_id"]: np.array([*ids_of(WORD_BPE, r["text"]), 2]) for r in docs.select("doc_id", "text").collect()}
    df, mean = np.bincount(np.concatenate([np.unique(x) for x in texts.values()]), minlength=1 << 16), sum(map(len, texts.values())) / len(texts)
    rows = [(i, i, len(x), x.astype("<u2").tobytes()) for i, x in texts.items()]
    encoded = docs.sparkSession.createDataFrame(rows, "key bigint, doc_id bigint, length bigint, ids binary").repartition(3)
    known = listed(encoded, bm25_idf(df, len(texts)), mean, np.dtype("<u2"), fit)
    return known, {r["key"]: dict(zip(r["terms"], r["weights"])) for r in known.collect()}, {i: len(x) for i, x in texts.items()}, mean


def test_a_search_finds_the_best_of_all_documents(spark, docs):
    """With the fit that queries use, a seed's neighbours are those of BM25 over all terms of all documents."""
    fit = PackFit(block_docs=37)  # several blocks of both sides
    known, weights, length, _ = as_packed(docs, fit)
    rows = known.where("size(terms) > 0").selectExpr("*", "0L as filled", "4096 - length % 4096 as need")
    seeds, rest = rows.where("key % 5 = 0"), rows.where("key % 5 <> 0")
    found = defaultdict(list)
    for r in nearest(blocked(seeds, "need", fit), blocked(rest, "length", fit), 1 << 16, fit).collect():
        found[r["seed"]].append(r)
    for s in (r["key"] for r in seeds.collect()):
        score = {d: sum(round(w * 1024) / 1024 for t, w in weights[d].items() if t in weights[s]) for d in weights if d % 5 and weights[d]}
        total, want = 0, []
        for x in sorted((x for x in score.items() if x[1] > 0), key=lambda x: -x[1]):
            if total >= fit.reach * (4096 - length[s] % 4096):
                break
            want.append(x[1])
            total += length[x[0]]
        got = sorted((r["score"] for r in found[s]), reverse=True)
        assert got[: len(want) - 3] == pytest.approx(want[: len(want) - 3], rel=1e-3)  # of equal scores, shorter ones make more
        for r in found[s]:
            assert r["score"] == pytest.approx(score[r["doc"]], rel=1e-3)


def test_no_open_window_shares_a_term_with_a_document_left(spark, docs):
    """No bound leaves a neighbour out: what nobody took shares no term with a window that has room."""
    fit = PackFit(window=2048, rounds=1)
    known, weights, length, mean = as_packed(docs, fit)
    taken = fill(known.localCheckpoint(), 1 << 16, mean, fit).collect()
    room = {s: 2048 - length[s] % 2048 for s in {r["seed"] for r in taken}}
    for s in room:
        at = 0
        for r in sorted((r for r in taken if r["seed"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at < room[s] and weights[s].keys() & weights[r["doc"]].keys()
            at += length[r["doc"]]
        room[s] -= at
    assert len({r["doc"] for r in taken}) == len(taken) and not {r["doc"] for r in taken} & {*room}
    share = mean / 2048
    picked = {r["key"] for r in known.where(f"length >= 2048 or pmod(xxhash64(key, 0), 1000003) < {share} * 1000003").collect()}
    left = {*weights} - {*room} - {r["doc"] for r in taken} - picked  # a seed picked may have found nobody unused
    for d in left:
        assert not any(weights[s].keys() & weights[d].keys() for s in room if room[s] > 0)


def test_a_full_cache_keeps_what_most_batches_held():
    """More words of many batches than a small cache takes do not empty it; ids stay those of the library."""
    enc = PieceEncoder(WORD_BPE, False, limit=40)
    common, words, fresh = ([f"{a}{b}{c}" for b in "aeiou" for c in "lmnrst"] for a in "bcd")
    common, words, fresh = common[:8], words[:28], fresh[:10]
    for words_of in (common, common, common, common + words, common + words, fresh):
        text = " ".join(words_of)
        assert enc.encode(pa.array([text]))[0].tolist() == ids_of(WORD_BPE, text)
    assert len(enc.known) <= 40
    assert {w.encode() + b" " for w in common[:-1]} <= enc.known.keys()


def test_large_rows_go_to_python_a_few_at_a_time(spark):
    """Batches hold as many rows as told, the session's setting stays, and texts reach the encoder in such batches."""
    from docweave.llm.common import stored

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    got = [r["n"] for r in stored(spark.range(5000, numPartitions=1).mapInArrow(sizes, "n bigint"), "sizes", arrow_rows=700).collect()]
    assert sum(got) == 5000 and max(got) <= 700 and spark.conf.get(setting) == before


def test_a_seed_is_named_by_few_tasks(spark):
    """Blocks of documents in many files meet a block of seeds in as few tasks as keep all cores busy."""
    from docweave.llm.packing import meetings

    cores = spark.sparkContext.defaultParallelism
    asked, listed_ = (spark.range(0, n, 1, 16).selectExpr("id as block", "cast(cast(id as string) as binary) as payload") for n in (2 * cores, 40))
    met = meetings(asked, listed_)
    assert met.distinct().count() == met.count() == 2 * cores * 40
    assert met.rdd.getNumPartitions() <= 2 * cores * 2
