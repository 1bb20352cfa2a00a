"""Every query with an oracle against DuckDB on the smallest tables; streams against their batch twins."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.plans import catalog
from docweave.streaming import feeds

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(dict(zip(want.columns, r))[c]) for c in cols) for r in want.fetchall()), key=str)


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = feeds.tumbling(stream, "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert rows(spark.table("daily")) == rows(feeds.tumbling(events, "1 day"))


def test_job_feed_hands_over_in_order(spark, tmp_path):
    jobs = spark.createDataFrame([(1, 2, 5.0), (2, 1, 9.0), (3, 1, 3.0)], "job_id bigint, priority bigint, created_at double")
    jobs.write.parquet(str(tmp_path / "jobs"))
    seen = []
    q = feeds.job_feed(spark, str(tmp_path / "jobs"), jobs.schema, lambda df, n: seen.extend(r["job_id"] for r in df.collect()), str(tmp_path / "at"))
    q.awaitTermination(60)
    assert seen == [3, 2, 1]


def python_duration(x):
    return f"{x:.1f}s" if x < 60 else f"{x / 60:.1f}m" if x < 3600 else f"{x / 3600:.1f}h"


def python_size(x):
    for unit in ("B", "KB", "MB", "GB"):
        if x < 1024:
            return f"{x:.1f}{unit}"
        x /= 1024.0
    return f"{x:.1f}TB"


def test_formats_round_as_printf(spark):
    """Ties, and doubles next to ties, of every unit."""
    got = spark.range(40_000).select("id", T.format_duration(F.col("id").cast("double")).alias("a"), T.format_duration(F.col("id") / 20).alias("b"), T.format_file_size(F.col("id")).alias("c"), T.format_file_size(F.col("id") * F.col("id") * 256).alias("d"))
    for i, *texts in got.collect():
        assert texts == [python_duration(i), python_duration(i / 20), python_size(i), python_size(i * i * 256)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_whole_formats_keep_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars").collect()
    for name, f in (("format_duration_whole", python_duration), ("format_file_size_whole", lambda n: python_size(n * n + 1))):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == sorted((d, f(n)) for d, n in docs)
