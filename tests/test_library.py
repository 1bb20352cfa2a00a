"""Files, stored indexes, plug-ins, ingest and the job machine over streams, each on small inputs."""

import random
import re
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions.porter import stem, stem_terms
from docweave.functions.text import STOP_WORDS
from docweave.operators import jobs, lifecycle, parsing, plugins, retrieval
from docweave.operators.postings import KeywordIndex
from docweave.sources import files
from docweave.sources.storage import clear_component, inventory
from docweave.streaming.feeds import changed_sources, latest_state
from docweave.streaming.job_state import ProgressLog, job_machine


def test_files_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é plain".encode())
    (tmp_path / "b.md").write_bytes("é latin".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(b"no")
    (tmp_path / "list").write_text("one.pdf\n\n two.md \n")
    got = files.read_files(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("n"), files.decoded(F.col("content")).alias("t"))
    assert {r["n"]: r["t"] for r in got.collect()} == {"a.txt": "é plain", "b.md": "é latin"}
    assert [r["path"] for r in files.path_list(spark, str(tmp_path / "list")).collect()] == ["one.pdf", "two.md"]


def test_artefacts_as_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.pdf", [("m", "p")], "text", "{}", 4, 1)], files.ARTEFACT)
    files.write_artefacts(rows, str(tmp_path / "a"))
    assert files.read_artefacts(spark, str(tmp_path / "a")).collect() == rows.collect()


def some_docs():
    rnd = random.Random(2)
    words = ["laser", "Sensor", "power", "the", "of", "x_y", "ère", "beam", "on"]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(some_docs(), "doc_id bigint, text string").repartition(3)
    return docs, KeywordIndex.build(docs, "doc_id", {"text": retrieval.plain_tokens(F.col("text"))}, str(tmp_path_factory.mktemp("index") / "i"), 10_000)


def test_index_holds_every_word(index):
    want = Counter((i, w) for i, t in some_docs() for w in re.findall(r"\w+", (t or "").lower()))
    rows = index[1].postings().collect()
    assert {(r["key"], r["term"]): r["tf"] for r in rows} == dict(want)
    for r in rows:
        tokens = re.findall(r"\w+", some_docs()[r["key"]][1].lower())
        assert r["positions"] == [i for i, t in enumerate(tokens) if t == r["term"]]
        assert r["dl_all"] == len(tokens) and r["dl"] == sum(len(t) > 2 and t not in STOP_WORDS for t in tokens)
    assert {r["term"]: r["df"] for r in index[1].terms().collect()} == dict(Counter(w for _, w in want))
    assert index[1].n == 62


def test_searches_agree_with_and_without_index(index):
    docs, stored = index
    for f in (lambda x: retrieval.bm25(x, "doc_id", "text", "laser power laser"), lambda x: retrieval.fts_scores(x, "doc_id", retrieval.plain_tokens(F.col("text")), ["laser", "of"]), lambda x: retrieval.phrase_hits(x, "doc_id", "text", "laser power", 50)):
        a, b = ({r["doc_id"]: tuple(r)[1:] for r in f(x).collect()} for x in (docs, stored))
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k])


def test_a_search_reads_the_folders_of_its_terms(index):
    plan = index[1].matched("doc_id", ["laser"], True)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(term,laser)" in plan or "In(term" in plan


def test_storage_inventory(spark, index):
    path = index[1].snapshot.store.path + "/data"
    assert {r["component"] for r in inventory(spark, path).collect()} == {"keyword_postings", "keyword_lexicon"}
    (spark.createDataFrame([(1,)], "x int")).write.parquet(path + "/spare")
    assert clear_component(spark, path, "spare") and not clear_component(spark, path, "spare")


def test_stemmed_scores(spark):
    docs = spark.createDataFrame([(1, "lasers heating"), (2, "laser heat heats"), (3, "cold")], "doc_id bigint, text string")
    found = stem_terms(retrieval.term_frequencies(docs, "doc_id", retrieval.plain_tokens(F.col("text"))), "doc_id", ["heated"])
    assert {r["doc_id"] for r in found.collect()} == {1, 2}
    assert stem("heating") == stem("heats") == "heat"


def test_literal_pairs():
    for text, want in (
        ("Metadata: {'pairs': [('a', 'b'), ('c', 'd')]}\nbody", ([("a", "b"), ("c", "d")], "body")),
        ("Metadata: {'pairs': [(\"it's\", 'x}y')]}\n\nbody", ([("it's", "x}y")], "body")),
        ("```python\nMetadata: {'pairs': [['a', 'b']], 'more': {'x': 1}}\n```\nbody", ([("a", "b")], "body")),
        ("Metadata: {'pairs': [('a', 'b', 'c')]}\nbody", ([], "Metadata: {'pairs': [('a', 'b', 'c')]}\nbody")),
        ("Metadata: {'pairs': [('a', 'b')]}", ([("a", "b")], "Metadata: {'pairs': [('a', 'b')]}")),
        ("Metadata: {'pairs': [('a', 'b')", ([], "Metadata: {'pairs': [('a', 'b')")),
        ("see metadata: {'pairs': []} inline", ([], "see metadata: {'pairs': []} inline")),
        ("İ title\nMETADATA:  {'pairs': [('a', 'b')]}\nx", ([("a", "b")], "İ title\nx")),
        (None, ([], None)),
        ("", ([], "")),
    ):
        assert parsing.literal_pairs(text) == want


def test_newer_and_new_rows_win(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 1, "p"), ("c", 1, "q")], "k string, v int, x string")
    assert {tuple(r) for r in lifecycle.latest_wins(old, new, ["k"], "v").collect()} == {("a", 1, "new"), ("b", 5, "old"), ("c", 1, "q")}


def test_a_failing_model_leaves_the_order(spark):
    hits = spark.createDataFrame([(i, i + 1, t) for i, t in enumerate(["none", "laser beam", "laser"])], "id bigint, rank bigint, text string")

    def broken(query: str, texts: pd.Series) -> pd.Series:
        raise RuntimeError("away")

    order = lambda model: [r["id"] for r in plugins.rerank(hits, "laser beam", "text", model).orderBy("new_rank").collect()]
    assert order(plugins.overlap_reranker) == [1, 2, 0]
    assert order(broken) == order(None) == [0, 1, 2]


def test_job_machine_stream_equals_batch(spark, tmp_path):
    schema = "job_id bigint, seq bigint, action string, ts timestamp"
    rows = [(1, 1, "start", 0), (1, 2, "complete", 5), (2, 3, "start", 6), (2, 4, "fail", 7), (2, 5, "requeue", 8), (2, 6, "start", 9), (3, 7, "start", 10), (3, 8, "cancel", 11), (4, 9, "complete", 12)]
    stamp = lambda s: pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(seconds=s)
    made = spark.createDataFrame([(j, s, a, stamp(t).to_pydatetime()) for j, s, a, t in rows], schema)
    late = spark.createDataFrame([(9, 10, "start", stamp(1000).to_pydatetime())], schema)
    log = ProgressLog(spark, str(tmp_path / "progress"), every=2)
    spark.streams.addListener(log)
    for df in (made, late):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = job_machine(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        held: list = []
        query = stream.writeStream.outputMode("update").foreachBatch(lambda b, i, held=held: held.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        if df is made:
            assert {(r["job_id"], r["status"], r["moves"]) for r in held} == {tuple(r) for r in jobs.run_machine(made).collect()}
    assert ("failed", True) in {(r["status"], r["timed_out"]) for r in held if r["job_id"] == 2}
    spark.streams.removeListener(log)
    for _ in range(100):  # reports come behind the batches
        if log.ended >= 2:
            break
        time.sleep(0.1)
    assert len(log.held) < 2 and log.progress().agg(F.sum("input_rows")).first()[0] == 10


def test_state_of_ended_jobs_goes(spark, tmp_path):
    """100 jobs end, a late one moves the watermark past their keeping: state shrinks, and late actions find nobody."""
    schema = "job_id bigint, seq bigint, action string, ts timestamp"
    stamp = lambda s: (pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(seconds=s)).to_pydatetime()
    first = [(j, 2 * j + i, a, stamp(j / 100)) for j in range(100) for i, a in enumerate(("start", "complete" if j % 2 else "fail"))]
    batches = [first, [(500, 1000, "start", stamp(10_000))], [(501, 1001, "start", stamp(10_001))], [(0, 1002, "requeue", stamp(10_001)), (1, 1003, "start", stamp(10_002))]]
    sizes, out = [], {}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = job_machine(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keep_ended=600)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: out.update({r["job_id"]: (r["status"], r["moves"]) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sizes[0] == 100 and sizes[-1] <= 4
    assert out[2] == ("failed", 2) and out[3] == ("completed", 2)
    assert out[0] == ("pending", 0) and out[1] == ("processing", 1)  # a forgotten job is one that nobody knows


def test_sources_in_order(spark, tmp_path):
    for name in ("b.md", "a.pdf", "c.txt", "d.docx", "sub/e.pdf", "A.PDF2"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    names = lambda sources, **k: [r["path"].rsplit("/", 1)[-1] for r in files.resolve(spark, sources, **k).orderBy("list", "at").collect()]
    top = str(tmp_path / "in")
    assert names([top]) == ["a.pdf", "c.txt", "b.md"] and names([top], recursive=True) == ["a.pdf", "e.pdf", "c.txt", "b.md"]
    assert names(["https://x/y", f"{top}/c.txt", top, "https://x/y", f"{top}/*", f"{top}/none*"]) == ["y", "c.txt", "a.pdf", "b.md"]
    assert names([f"{top}/d.docx"]) == ["d.docx"] and names([]) == []


def test_bad_bytes_go_alone(spark):
    cases = [b"plain", "é 漢 😀".encode(), b"a\xffb", b"\xc3(", b"\xe2\x82x", b"\xf0\x9f\x98", b"\x80\x80", b"", None, b"\xed\xa0\x80z", b"caf\xe9"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c binary")
    got = {r["i"]: (r["lenient"], r["strict"]) for r in df.select("i", files.decoded_leniently(F.col("c")).alias("lenient"), files.decoded(F.col("c")).alias("strict")).collect()}
    for i, c in enumerate(cases):
        lenient = None if c is None else c.decode("utf-8", "ignore")
        try:
            strict = None if c is None else c.decode()
        except UnicodeDecodeError:
            strict = c.decode("latin-1")
        assert got[i] == (lenient, strict)


def test_typed_metadata(spark):
    df = spark.createDataFrame([(["a=1", " b = x y ", "c=\"q\"", "d=[1, {\"k\": null}]", "e=null", "f=true", "g=1=2", "a=2.5", "h="],)], "i array<string>")
    got = {k: tuple(v) for k, v in df.select(T.typed_metadata(F.col("i")).alias("m")).first()["m"].items()}
    assert got == {"a": ("number", "2.5"), "b": ("string", "x y"), "c": ("string", "q"), "d": ("array", '[1,{"k":null}]'), "e": ("null", "null"), "f": ("boolean", "true"), "g": ("string", "1=2"), "h": ("string", "")}
    for bad in ("novalue", "=x"):
        with pytest.raises(Exception, match="key=value"):
            spark.createDataFrame([([bad],)], "i array<string>").select(T.typed_metadata(F.col("i"))).collect()


def test_change_and_state_feeds(spark, tmp_path):
    schema = "source string, content_hash string, ts timestamp"
    spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", "3")], "source string, content_hash string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([("a", "1"), ("b", "9")], "source string, content_hash string")
    out: list = []
    feed = changed_sources(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), stored)
    feed.writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["source"], r["content_hash"]) for r in out) == [("b", "2"), ("c", "3")]
    changes = spark.createDataFrame([(1, 1, "pending"), (1, 2, "completed")], "job_id bigint, seq bigint, status string")
    assert latest_state(changes).first()["status"] == "completed"
