"""Change detection, upserts, jobs and parsing on tiny tables."""

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import filters, jobs, lifecycle, parsing


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "s"), [("a b c d e", "A B C D E", 1.0), ("1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8 x", 0.8), ("a b c d", "a b c x", 0.6), ("a b", "x y", 0.0), ("", "", 1.0)])
def test_set_jaccard(spark, a, b, s):
    assert one(spark, T.set_jaccard(T.word_set(F.col("a")), T.word_set(F.col("b"))), a=a, b=b) == pytest.approx(s)


@pytest.mark.parametrize(("size", "kind"), [(110, "minor_update"), (140, "minor_update"), (150, "major_update"), (180, "structure_change"), (195, "complete_rewrite")])
def test_change_class(spark, size, kind):
    c = lifecycle.change_class(F.lit("h"), F.lit("g"), F.lit(100), F.col("n"))
    assert one(spark, c, n=size) == kind


@pytest.mark.parametrize(("kind", "n", "k", "seconds"), [("minor_update", 2500, 2, 7.25), ("new_document", 50000, 0, 120.0), ("major_update", 10000, 25, 60.0), ("no_change", 0, 0, 0.1)])
def test_effort(spark, kind, n, k, seconds):
    assert one(spark, lifecycle.effort(F.col("c"), F.col("n"), F.col("k")), c=kind, n=n, k=k) == pytest.approx(seconds)


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0), (3, 2, 50.0), (4, 3, 5.0)], "doc_id bigint, priority int, effort double")
    assert sorted(r["doc_id"] for r in lifecycle.within_budget(df, 60.0).collect()) == [1, 2]


def test_diff_with_itself_is_unchanged_and_upsert_is_idempotent(spark):
    chunks = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c"), (2, 0, "")], "doc_id bigint, chunk_index bigint, text string")
    assert {r["label"] for r in lifecycle.chunk_diff(chunks, chunks).collect()} == {"unchanged"}
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v bigint, t bigint")
    new = spark.createDataFrame([("b", 2, 2), ("c", 2, 2)], "k string, v bigint, t bigint")
    first = lifecycle.latest_wins(old, new, ["k"], "t")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, lifecycle.latest_wins(first, new, ["k"], "t").collect()))


def test_retry(spark):
    rows = [(1, "failed", 0.0, 3, 3), (2, "failed", 0.0, 2, 3), (3, "processing", 699.0, 0, 3), (4, "processing", 701.0, 0, 3)]
    df = spark.createDataFrame(rows, "job_id bigint, status string, updated_at double, retry_count bigint, max_retries bigint")
    assert {r["job_id"]: (r["status"], r["retry_count"]) for r in jobs.retry(df, 1000.0).collect()} == {1: ("failed", 4), 2: ("pending", 3), 3: ("pending", 1), 4: ("processing", 0)}


@pytest.mark.parametrize(("name", "kind"), [("a.md", "markdown"), ("pm10k-plus-ds.pdf", "datasheet_pdf"), ("annual_report.pdf", "generic_pdf"), ("sensor_guide.pdf", "generic_pdf"), ("x.pdf", "generic_pdf"), ("a.docx", "unsupported")])
def test_classify(spark, name, kind):
    assert one(spark, parsing.classify(F.col("s"), datasheet_mode=False), s=name) == kind


def test_pairs(spark):
    block = "Metadata: {'pairs': [('A', '1'), ('B', '2')]}"
    pairs, rest = parsing.pairs_from_literal(F.col("t"))
    got = [spark.createDataFrame([(t,)], "t string").select(pairs.alias("p"), rest.alias("r")).first() for t in (block + "\nbody", block, "Metadata: {'pairs': [('A', '1', 'x')]}\nbody")]
    assert [(len(r["p"]), r["r"]) for r in got] == [(2, "body"), (2, block), (0, "Metadata: {'pairs': [('A', '1', 'x')]}\nbody")]
    assert len(one(spark, parsing.pairs_from_json(F.col("t")), t="Metadata: {'pairs': [['A', '1']]}\n---\nx")) == 1
    assert one(spark, parsing.pairs_from_json(F.col("t")), t="Metadata: {'pairs': [('A', '1')]}\n---\nx") == []


def test_sections_and_sentences():
    assert list(parsing.heading_sections("x\n# A\na\n```\n# no\n```\n## B\n")) == [("", "x"), ("A", "a\n```\n# no\n```"), ("B", "")]
    chunks = list(parsing.sentence_windows("a b c. d e f. g h i.", 6, 3))
    assert chunks == ["a b c. d e f.", "d e f. g h i."]


def test_filters_warn_and_refuse(spark):
    with pytest.warns(UserWarning):
        assert filters.validate({"nonsense": 1, "doc_ids": [1]}) == {"doc_ids": [1]}
    with pytest.raises(TypeError):
        filters.validate([1])
    df = spark.createDataFrame([("a%b",), ("axb",)], "source string")
    assert [r["source"] for r in df.where(filters.predicate({"source": {"pattern": "a%*"}})).collect()] == ["a%b"]


def test_duration_and_size(spark):
    assert one(spark, T.format_duration(F.col("x")), x=7230.0) == "2.0h"
    assert [one(spark, T.format_file_size(F.col("x")), x=v) for v in (10, 2048, 5 << 40)] == ["10.0B", "2.0KB", "5.0TB"]


def test_a_hot_jobs_actions_are_folded_in_runs(spark):
    """One job with most of the actions, over many tasks, ties, unknown actions and a job without id, against a plain loop."""
    import random

    rnd = random.Random(5)
    names = ["start", "complete", "fail", "cancel", "requeue", "nonsense"]
    rows = [(1 if rnd.random() < 0.8 else rnd.choice([2, 3, None]), rnd.randrange(3000), rnd.choice(names)) for _ in range(4000)] + [(9, 1, "nonsense")]
    got = jobs.run_machine(spark.createDataFrame(rows, "job_id bigint, seq bigint, action string").repartition(6)).collect()
    want = {}
    for job, _, action in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        status, moves = want.get(job, ("pending", 0))
        new = jobs.TRANSITIONS.get((status, action))
        want[job] = (new or status, moves + bool(new))
    assert {r["job_id"]: (r["status"], r["moves"]) for r in got} == want
    assert jobs.run_machine(spark.createDataFrame([], "job_id bigint, seq bigint, action string")).collect() == []
