"""Scores and fusions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions.porter import stem
from docweave.operators import fusion, retrieval


@pytest.fixture(scope="module")
def lists(spark):
    v = spark.createDataFrame([("n1", 0.9, 1), ("n2", 0.8, 2), ("n3", 0.6, 3)], "id string, score double, rank bigint")
    k = spark.createDataFrame([("n3", -5.0, 1), ("n4", -3.0, 2), ("n1", -1.0, 3)], "id string, score double, rank bigint")
    return v, k


def scores(df):
    return {r["id"]: r["fused"] for r in df.collect()}


def test_bm25(spark):
    docs = spark.createDataFrame([("d1", "laser sensor power"), ("d2", "laser laser beam"), ("d3", "power meter for the lab")], "id string, text string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(docs, "id", "text", "laser power").collect()}
    assert got == pytest.approx({"d1": 0.940007258, "d2": 0.646254990, "d3": 0.470003629})


def test_bm25_rises_with_tf_and_counts_repeated_terms(spark):
    docs = spark.createDataFrame([("a", "laser xxx yyy"), ("b", "laser laser yyy"), ("c", "zzz zzz zzz")], "id string, text string")
    once = {r["id"]: r["score"] for r in retrieval.bm25(docs, "id", "text", "laser").collect()}
    twice = {r["id"]: r["score"] for r in retrieval.bm25(docs, "id", "text", "laser laser").collect()}
    assert once["b"] > once["a"] and twice["a"] == pytest.approx(2 * once["a"]) and "c" not in once


def test_fts(spark):
    rows = [(1, "laser sensor power"), (2, "laser laser beam"), (3, "laser text here words"), (4, "power meter power power"), (5, "another laser")]
    docs, tok = spark.createDataFrame(rows, "id bigint, text string"), retrieval.plain_tokens(F.col("text"))
    both = {r["id"]: r["score"] for r in retrieval.fts_scores(docs, "id", tok, ["laser", "power"]).collect()}
    assert both == pytest.approx({1: -0.3453019804392623})
    some = {r["id"]: r["score"] for r in retrieval.fts_scores(docs, "id", tok, ["laser", "power"], every=False).collect()}
    assert some == pytest.approx({1: -0.34530198, 2: -1.3996024e-06, 3: -9.0721649e-07, 4: -0.50185690, 5: -1.1812081e-06}, rel=1e-6)


def test_fusions(lists):
    v, k = lists
    assert scores(fusion.rrf(v, k, 9)) == pytest.approx({"n1": 0.032266458, "n3": 0.032266458, "n2": 0.016129032, "n4": 0.016129032}, rel=1e-6)
    assert [r["id"] for r in fusion.rrf(v, k, 9).orderBy("rank").collect()] == ["n1", "n3", "n2", "n4"]
    assert scores(fusion.weighted(v, k, 9, compat=True)) == pytest.approx({"n1": 1.1, "n2": 0.622222222, "n3": 0.513333333, "n4": 0.15})
    assert scores(fusion.alpha(v, k, 9, compat=True)) == pytest.approx({"n2": 0.444444444, "n1": 0.0, "n4": -1.5, "n3": -2.166666667}, abs=1e-8)
    assert scores(fusion.rank_weighted(v, k, 9)) == pytest.approx({"n1": 1.0, "n3": 0.986301370, "n2": 0.767123288, "n4": 0.205479452})


def test_weighted_takes_the_best_keyword_hit_as_best(lists):
    v, k = lists
    got = scores(fusion.weighted(v, k, 9))
    assert got["n2"] == pytest.approx(0.622222222) and got["n4"] == pytest.approx(0.3 * 3 / 5) and got["n3"] > got["n4"]


def test_rrf_depends_on_ranks_only(lists):
    v, k = lists
    assert scores(fusion.rrf(v.withColumn("score", F.exp("score")), k, 9)) == scores(fusion.rrf(v, k, 9))


def test_phrase_needs_neighbours(spark):
    docs = spark.createDataFrame([(1, "of the of the"), (2, "of x the"), (3, "the of the")], "id bigint, text string")
    got = {r["id"]: r["occurrences"] for r in retrieval.phrase_hits(docs, "id", "text", "Of the", 9).collect()}
    assert got == {1: 2, 3: 1}


def test_tokens_and_stems(spark):
    row = spark.createDataFrame([("Éanment ère; PM10K+ 2.0 x_y",)], "t string").select(T.tokenize(F.col("t")).alias("t")).first()
    assert row["t"] == ["éanment", "ère", "pm10k", "x_y"]
    known = {"caresses": "caress", "ponies": "poni", "motoring": "motor", "hopping": "hop", "relational": "relat", "adjustable": "adjust", "happy": "happi", "controll": "control", "rate": "rate", "feed": "feed", "agreed": "agre"}
    assert {w: stem(w) for w in known} == known


def test_zero_vectors_have_no_score(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id bigint, e array<double>")
    got = retrieval.vector_scores(rows, "id", "e", spark.createDataFrame([([2.0, 0.0],)], "query array<double>")).collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0)]
