"""Similarity join, nearest neighbours, language model and pipeline against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from docweave.llm.ann import AnnFit, fit_router, nearest_neighbours, usable_rows
from docweave.llm.graph import connected_components
from docweave.llm.katz import CUT, KatzFit, discounts, score_documents
from docweave.llm.ngram_join import JoinFit, jaccard_components, keep_representatives


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def families():
    """Near copies, exact copies, chains, a passage that many share, and short texts."""
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(20):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 110))]
        for _ in range(rnd.randint(1, 12)):
            x = list(base)
            for _ in range(rnd.randint(0, 3)):
                x[rnd.randrange(len(x))] = rnd.choice(vocabulary)
            x += passage[: rnd.randint(5, 60)] if rnd.random() < 0.3 else []
            out.append(" ".join(x[rnd.randint(0, 4) :]))
    out += [" ".join(passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))]) for _ in range(50)]
    return [*enumerate(out)]


@pytest.mark.parametrize("fit", [JoinFit(), JoinFit(local=1, least=2, block=1000), JoinFit(broadcast_rows=0)])
def test_join_equals_brute_force(spark, fit):
    rows = families()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), fit).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_join_on_odd_rows(odd, none, docs):
    for df in (odd, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, jaccard_components(df).collect()), key=str) == sorted(brute_components(rows), key=str)
    assert jaccard_components(none).count() == 0
    kept = keep_representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 6, 7, 8, None, 9]))


def test_null_ids_bridge_near_copies(spark):
    """Two documents that only a text of null doc_id, there twice, joins."""
    w = [f"w{i}" for i in range(104)]
    rows = [(5, " ".join(w[:86])), (None, " ".join(w[9:95])), (None, " ".join(w[9:95])), (3, " ".join(w[18:])), (9, "some other text of seven words here")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)
    assert {d: c for d, _, c in got} == {5: 3, 3: 3, None: 3, 9: 9}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (5, 5), *[(100, i) for i in range(101, 160)], (159, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 4], 1), **dict.fromkeys([10, 11, 12], 10), **dict.fromkeys([*range(100, 160), 200], 100)}


def brute_nearest(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            best = sorted(((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def clusters(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, 16))
    return [(i, [float(a) for a in row]) for i, row in enumerate(x)]


def asked(df, every, k, fit=AnnFit()):
    got = defaultdict(list)
    for r in sorted(nearest_neighbours(df, every, k, fit).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_few_vectors_are_searched_exactly(spark):
    rows = [*clusters(300), (1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [float("inf")] * 16), (1100, []), *[(2000 + i, clusters(3)[0][1]) for i in range(40)]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got, want = asked(df, 20, 7), brute_nearest(rows, 20, 7)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if q != 1100}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in got for a, b in zip(got[q], want[q]))
    assert asked(df.limit(0), 20, 7) == {}
    assert len(asked(df.where("vec_id < 5"), 1, 20)[0]) == 4


def test_recall_and_blocks(spark):
    rows = clusters(3000)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    fit = AnnFit(rows_per_part=300, block_rows=100, block_queries=16)
    got, want = asked(df, 20, 10, fit), brute_nearest(rows, 20, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("n", [2000, 9000])
def test_recall_with_the_fit_of_the_query(spark, n):
    """Several partitions at the size of the given table too, and not all of them visited."""
    rows = clusters(n)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    router = fit_router(usable_rows(df), 20)
    assert router.probes < router.parts
    got, want = asked(df, 20, 20), brute_nearest(rows, 20, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def brute_katz(rows, fit):
    tokens = lambda t: [*words(t), "end"]
    one, two = Counter(), Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % fit.folds != fit.held_out:
            w = tokens(t)
            one.update(w)
            two.update(zip(["start", *w[:-1]], w))
    total, n0, n1 = sum(one.values()), np.zeros(CUT + 2), np.zeros(CUT + 2)
    for counts, n in ((one, n0), (two, n1)):
        for c in counts.values():
            if c <= CUT + 1:
                n[c] += 1
    d0, d1 = discounts(n0), discounts(n1)
    less = lambda c, d: c * (d[c] if c <= CUT else 1.0)
    left0 = 1 + sum(r * n0[r] * (1 - d0[r]) for r in range(1, CUT + 1))
    word = lambda w: (less(one[w], d0) if one[w] else left0) / (total + 1)
    followers, back = defaultdict(list), {}
    for (h, w), c in two.items():
        followers[h].append((w, c))
    for h, f in followers.items():
        whole, left = sum(c for _, c in f), sum(c * (1 - d1[c]) for _, c in f if c <= CUT)
        whole, left = (whole, left) if left > 0 else (whole + 1, 1)
        back[h] = whole, left / whole / (1 - sum(word(w) for w, _ in f))
        mass = sum(less(c, d1) for _, c in f) / whole + back[h][1] * (1 - sum(word(w) for w, _ in f))
        assert mass == pytest.approx(1)
    out = []
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (total + len(one) + 1)) for x in w)
        katz = sum(math.log10(less(two[h, x], d1) / back[h][0] if two[h, x] else back.get(h, (0, 1))[1] * word(x)) for h, x in zip(["start", *w[:-1]], w))
        out.append((d, len(w), sum(one[x] > 0 for x in w), total, round(base, 5), round(katz, 5)))
    return sorted(out, key=str)


@pytest.mark.parametrize("fit", [KatzFit(), KatzFit(hot=30, salts=3)])
def test_katz_equals_brute_force(odd, none, docs, fit):
    for df in (odd, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in score_documents(df, fit).collect()]
        for g, w in zip(sorted(got, key=str), brute_katz(rows, fit), strict=True):
            assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-6, abs=2e-5)
    assert score_documents(none, fit).count() == 0


def test_katz_beats_the_base_on_held_out_texts(docs):
    held = [r for r in score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_pipeline(spark, odd, none):
    for df in (odd, none):
        at = df
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, "")
            if i < 3:
                assert out.columns == df.columns
                assert set(map(tuple, out.collect())) <= set(map(tuple, at.collect()))
            at = out
        assert at.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark, docs):
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, "")
    groups = {d: c for d, _, c in map(tuple, jaccard_components(kept).collect())}
    assert len(set(groups.values())) == len(groups) >= 0.6 * docs.count()


def test_clashing_names_do_no_harm(spark, odd, clash):
    from docweave.llm.bpe import encode_and_decode
    from docweave.llm.langid import language_predictions
    from docweave.llm.packing import pack
    from docweave.llm.quality_rules import keep_good, repetition_coverage
    from docweave.llm.queries import BYTE_BPE, WORD_BPE
    from docweave.llm.token_output import token_file_report

    rows = lambda df: sorted(map(str, df.collect()))
    for f in (repetition_coverage, language_predictions, jaccard_components, score_documents, lambda d: encode_and_decode(d, BYTE_BPE), lambda d: token_file_report(d, BYTE_BPE)):
        assert rows(f(clash)) == rows(f(odd))
    assert pack(clash, WORD_BPE).agg({"length": "sum"}).first() == pack(odd, WORD_BPE).agg({"length": "sum"}).first()
    assert keep_good(clash).columns == clash.columns and keep_representatives(clash).columns == clash.columns
