"""Versions of tables: commits, conflicts, failed writes, deletions, merging and expiry; and ingest on top of them."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docweave.operators import ingest
from docweave.operators.batches import call_in_batches
from docweave.operators.ingest import Library, Steps
from docweave.operators.plugins import HashedEmbedder, origin_nodes, with_keywords
from docweave.operators.retrieval import bm25_top, fts_top
from docweave.plans.engine import Engine
from docweave.sources.versions import Conflict, TableStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see the folder of tests


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k bigint, v string")


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def test_commits_are_seen_by_other_sessions_and_old_versions_stay(spark, store):
    assert store.snapshot().version == 0 and store.snapshot().tables == {}
    tx = store.begin()
    tx.append("t", rows(spark, (1, "a"), (2, "b")), "k")
    assert TableStore(spark.newSession(), store.path).snapshot().version == 0  # nothing is seen before the commit
    first = tx.commit()
    tx = TableStore(spark.newSession(), store.path).begin()
    tx.replace("t", rows(spark, (2, "c"), (3, "d")), rows(spark, (2, "")).select("k"), "k")
    tx.commit()
    assert content(store.snapshot().table("t")) == [(1, "a"), (2, "c"), (3, "d")]
    assert content(first.table("t")) == content(store.snapshot(1).table("t")) == [(1, "a"), (2, "b")]


def test_of_two_writers_one_gets_a_conflict_and_leaves_nothing(spark, store):
    a, b = store.begin(), TableStore(spark.newSession(), store.path).begin()
    a.append("t", rows(spark, (1, "a")), "k")
    b.append("t", rows(spark, (2, "b")), "k")
    b.commit()
    with pytest.raises(Conflict):
        a.commit()
    assert content(store.snapshot().table("t")) == [(2, "b")]
    assert len(store.files.names(f"{store.path}/data/t")) == 1


def test_a_failed_write_leaves_the_old_version(spark, store):
    tx = store.begin()
    tx.append("t", rows(spark, (1, "a")), "k")
    tx.commit()
    with pytest.raises(Exception, match="boom"):
        store.begin().append("t", rows(spark, (2, "b")).withColumn("v", F.raise_error(F.lit("boom")).cast("string")), "k")
    assert store.snapshot().version == 1 and content(store.snapshot().table("t")) == [(1, "a")]


def test_null_keys_repeats_and_deletes_in_order(spark, store):
    for part in ([(None, "n"), (1, "a"), (1, "a")], [(1, "b")], [(1, "c"), (None, "m")]):
        tx = store.begin()
        new = rows(spark, *part)
        tx.replace("t", new, new.select("k"), "k")
        tx.commit()
    assert content(store.snapshot().table("t")) == [(1, "c"), (None, "m")]
    tx = store.begin()
    tx.delete("t", rows(spark, (1, "")).select("k"))
    tx.commit()
    assert content(store.snapshot().table("t")) == [(None, "m")]


def test_merging_and_expiry_keep_what_is_there(spark, store):
    for i in range(5):
        tx = store.begin()
        tx.replace("t", rows(spark, (i, "x"), (0, str(i))), rows(spark, (i, ""), (0, "")).select("k"), "k")
        tx.commit()
    want = content(store.snapshot().table("t"))
    merged = store.compact("t", most=2)
    assert merged.version == 6 and len(merged.segments("t")) == 1 and content(merged.table("t")) == want
    writing = store.begin()
    writing.append("t", rows(spark, (9, "z")), "k")
    gone = store.expire(keep=1)
    assert len(gone) >= 8 and store.versions() == [6] and content(store.snapshot().table("t")) == want
    writing.commit()  # folders of a transaction that was open meanwhile were spared
    assert (9, "z") in content(store.snapshot().table("t"))


# ---- models in batches


class Odd:
    """Fails for texts with an x, and with them for their whole batch; remembers sizes of calls by the length of answers."""

    def __call__(self, texts):
        if any("x" in t for t in texts):
            raise ValueError("an x")
        return [[t, str(len(texts))] for t in texts]


def test_only_rows_that_fail_alone_are_lost(spark):
    texts = [f"t{i}" for i in range(120)] + ["x"] + [f"u{i}" for i in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").coalesce(1)
    got = {r["id"]: r for r in call_in_batches(df, "text", "out", "array<string>", Odd(), 50).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i]["out"] or [None])[0] == (None if t == "x" else t)
    assert got[120]["out_error"] == "ValueError: an x" and got[181]["out_error"] is None
    assert [got[i]["out"][1] for i in (0, 49, 50, 99, 100, 119, 121, 149, 150)] == ["50"] * 4 + ["1"] * 4 + ["32"]
    assert all(r["out_seconds"] >= 0 for r in got.values())
    assert call_in_batches(df.limit(0), "text", "out", "array<string>", Odd()).collect() == []


def test_keywords_are_appended_and_failures_leave_the_text(spark):
    df = spark.createDataFrame([(1, "laser laser beams"), (2, "x laser"), (3, "no"), (4, None)], "id bigint, text string").coalesce(1)
    got = {r["id"]: r["text"] for r in with_keywords(df, "text").collect()}
    assert got == {1: "laser laser beams\n\nKeywords: laser, beams", 2: "x laser\n\nKeywords: laser", 3: "no", 4: None}
    failed = {r["id"]: (r["text"], r["keywords_error"]) for r in with_keywords(df, "text", Odd()).collect()}
    assert failed[2] == ("x laser", "ValueError: an x") and failed[3][0] == "no\n\nKeywords: no, 1"
    docs = spark.createDataFrame([(1, "Laser beams are bright. Short one."), (2, "")], "doc_id bigint, text string")
    assert [(r["node_id"], r["keywords"]) for r in origin_nodes(docs, 4, 0).orderBy("node_id").collect()] == [("1_0", ["beams", "bright", "laser"]), ("1_1", ["short"])]


# ---- ingest


def docs_of(spark, *docs):
    return spark.createDataFrame(list(docs), "doc_id bigint, source string, text string")


LONG = "x y " * 600


def test_three_versions_of_a_library(spark, store):
    one = docs_of(spark, (1, "a", LONG), (2, "b", "short one"), (3, "c", ""), (4, "d", None))
    first = Engine(one).ingest(store)
    state = lambda lib: {r["doc_id"]: (r["state"], r["chunk_count"], r["error_count"]) for r in lib.registry.collect()}
    assert state(first) == {1: ("indexed", 3, 0), 2: ("indexed", 1, 0), 3: ("indexed", 0, 0), 4: ("corrupted", 0, 1)}
    assert {r["strategy"] for r in ingest.planned(first.registry, one.where("text is not null")).collect()} == {"skip"}
    again = ingest.ingest(TableStore(spark.newSession(), store.path), docs_of(spark, (1, "a", LONG + "tail words"), (2, "b", "short one"), (5, "e", "new laser")))
    assert state(again) == state(first) | {5: ("indexed", 1, 0)}
    actions = {(r["node_id"], r["action"]) for r in again.snapshot.read("nodes", again.snapshot.segments("nodes")[-1:]).collect()}
    assert actions == {("1_0", "keep"), ("1_1", "keep"), ("1_2", "embed"), ("5_0", "embed")}
    report = json.loads(again.runs.orderBy(F.desc("version")).first()["report"])
    assert report["documents"] == {"incremental": 1, "skip": 1, "full_reindex": 1} and report["chunks"] == {"keep": 2, "embed": 2} and report["version"] == 2
    third = ingest.remove(store, spark.createDataFrame([(1,)], "doc_id bigint"))
    assert third.snapshot.version == 3 and third.entries.count() == 4 and third.vectors.count() == 2
    assert state(third) == {k: v for k, v in state(again).items() if k != 1}
    assert content(Library(store.snapshot(1)).entries) == content(first.entries)  # what a reader of version 1 sees
    before, states = content(third.nodes.select("node_id", "text")), state(third)
    tidy = ingest.tidied(store, most=1)
    assert content(tidy.nodes.select("node_id", "text")) == before and state(tidy) == states


def test_an_index_that_took_updates_answers_like_a_new_one(spark, store, tmp_path):
    texts = {i: f"laser w{i % 7} power w{i % 3} " * (1 + i % 4) for i in range(900)}
    ingest.ingest(store, docs_of(spark, *[(i, "s", t) for i, t in texts.items()]))
    changed = {i: texts[i] + " beam laser" for i in range(0, 900, 9)} | {1000: "laser laser beam"}
    ingest.ingest(store, docs_of(spark, *[(i, "s", t) for i, t in changed.items()]))
    library = ingest.remove(store, spark.range(0, 900, 10).withColumnRenamed("id", "doc_id"))
    left = {i: t for i, t in (texts | changed).items() if i % 10 or i == 1000}
    fresh = ingest.ingest(TableStore(spark, str(tmp_path / "fresh")), docs_of(spark, *[(i, "s", t) for i, t in left.items()]))
    hits = lambda lib, f: [(r["id"], round(r["score"], 9)) for r in f(lib.index).collect()]
    searches = (
        lambda x: bm25_top(x, "id", "laser beam w3 laser", 25),
        lambda x: fts_top(x, "id", ["laser", "w2"], 25),
        lambda x: fts_top(x, "id", ["lasers", "powered"], 10, stems=True),
        lambda x: fts_top(x, "id", ["beam", "nowhere"], 10),
        lambda x: bm25_top(x, "id", "w1", 5, allowed=spark.createDataFrame([(f"{i}_0",) for i in range(0, 900, 11)], "key string")),
    )
    for f in searches:
        assert hits(library, f) == hits(fresh, f)
    assert library.index.n == fresh.index.n and library.index.average(True) == fresh.index.average(True)
    phrase = lambda lib: content(lib.index.phrase("id", lib.index.stemmed(["laser"]) + lib.index.stemmed(["beams"])))
    assert phrase(library) == phrase(fresh) and len(phrase(fresh)) > 0
    tidy = ingest.tidied(store, most=1)
    assert len(tidy.index._segments()) == 1 and all(hits(tidy, f) == hits(fresh, f) for f in searches) and phrase(tidy) == phrase(fresh)


def test_few_ranges_are_read_for_the_best(spark, store):
    rare = {77, 5000, 9001}
    docs = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.repeat(F.lit("filler "), (F.col("id") % 50).cast("int")), F.when(F.col("id").isin(*rare), "needle ").otherwise("")).alias("text"))
    from docweave.operators.postings import KeywordIndex
    from docweave.operators.retrieval import plain_tokens

    docs.write.parquet(store.path + "-docs")
    index = KeywordIndex.build(spark.read.parquet(store.path + "-docs"), "doc_id", {"text": plain_tokens(F.col("text"))}, store.path, 1 << 20)
    got = bm25_top(index, "id", "needle common", 3).collect()
    assert {r["id"] for r in got} == rare
    assert index.read[1] > 70 and index.read[0] <= 32 < index.read[1] / 2


def test_repeated_and_null_ids(spark, store):
    docs = spark.createDataFrame([(1, "a", "old", 1.0), (1, "a", "new", 2.0), (2, "b", "left", None), (2, "b", "right", None), (None, "c", "nobody", 1.0)], "doc_id bigint, source string, text string, modified double")
    library = ingest.ingest(store, docs)
    assert content(library.nodes.select("doc_id", "text")) == [(1, "new"), (2, "right")]
    assert library.registry.count() == 2 and json.loads(library.runs.first()["report"])["without_id"] == 1
    empty = ingest.ingest(store, docs.limit(0))
    assert empty.snapshot.version == 2 and content(empty.nodes.select("doc_id", "text")) == [(1, "new"), (2, "right")]


def test_of_two_batches_at_once_one_has_to_come_again(spark, store):
    one, two = docs_of(spark, (1, "a", "first words")), docs_of(spark, (1, "a", "other words"), (2, "b", "second words"))
    late = store.begin()
    ingest.ingest_into(late, one, Steps())
    ingest.ingest(TableStore(spark.newSession(), store.path), two)
    with pytest.raises(Conflict):
        late.commit()
    assert content(Library(store.snapshot()).nodes.select("doc_id", "text")) == [(1, "other words"), (2, "second words")]
    again = ingest.ingest(store, one)
    assert content(again.nodes.select("doc_id", "text")) == [(1, "first words"), (2, "second words")]
    assert {r["id"] for r in fts_top(again.index, "id", ["words"], 5).collect()} == {"1_0", "2_0"}


class Half(HashedEmbedder):
    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise TimeoutError("away")
        return super().__call__(texts)


def test_the_whole_loop_with_failures(spark, store):
    docs = docs_of(spark, (1, "m/a.md", "Metadata: {'pairs': [('PM10', '123')]}\nlaser sensors measure"), (2, "m/b.pdf", "bad " * 300), (3, "m/c.docx", "never read"))
    library = ingest.ingest(store, docs, Steps(parser=lambda t: F.concat(F.lit("parsed "), t), pairs=True, keywords=Odd(), embedder=Half()))
    got = {r["doc_id"]: r for r in library.registry.collect()}
    assert [(got[i]["state"], got[i]["last_error"]) for i in (1, 2, 3)] == [("indexed", None), ("corrupted", "TimeoutError: away"), ("corrupted", "no parser for this kind of file")]
    assert [tuple(p) for p in got[1]["pairs"]] == [("PM10", "123")] and got[2]["pairs"] == []
    texts = {r["node_id"]: r["text"] for r in library.nodes.collect()}
    assert texts["1_0"].startswith("laser sensors measure\n\nKeywords: ") and texts["2_0"].startswith("parsed bad")
    stages = {(r["doc_id"], r["stage"]): (r["items"], r["failed"]) for r in library.stages.collect()}
    assert stages[1, "embedding"] == (1, 0) and stages[2, "embedding"] == (2, 2) and stages[3, "parsing"] == (1, 1) and stages[1, "keywords"] == (1, 0)
    means = {r["stage"]: (r["documents"], r["items"], r["failed"]) for r in ingest.stage_averages(library.stages).collect()}
    assert means["parsing"] == (3, 3, 1) and means["embedding"] == (3, 3, 2)
    assert {r["id"] for r in fts_top(library.index, "id", ["laser"], 5, weights={"text": 1.0, "keywords": 2.0}).collect()} == {"1_0"}
