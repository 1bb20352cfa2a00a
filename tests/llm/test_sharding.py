"""The Feistel permutation, its shards and slots, against what files hold."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm.sharding import Feistel, sharding_report, write_shards


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 1000, 4097, 100_003])
def test_permutes_every_number_and_back(n):
    order = Feistel(n, seed=5)
    to = order.forward(np.arange(n))
    assert sorted(to.tolist()) == list(range(n))
    assert (order.inverse(to) == np.arange(n)).all()
    if n >= 1000:
        assert (to != Feistel(n, seed=6).forward(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(to, np.arange(n))[0, 1]) < 0.1


def laws(rows, n, shards=16):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == n
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_whole_table_and_its_digests(spark, docs):
    rows = sharding_report(docs).collect()
    laws(rows, docs.count())
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = sharding_report(docs.repartition(3).coalesce(2))  # no scan of files: stored first, in an order of its own
    laws(again.collect(), docs.count())


def test_same_files_same_places_and_computed_slots(spark, docs, tmp_path):
    docs.repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    a, b = write_shards(table, shards=5, rows_a_file=7), write_shards(table, shards=5, rows_a_file=1000)
    place = lambda w: {r["row_number"]: (r["shard"], r["slot"], r["c0"]) for r in w.read().collect()}
    assert place(a) == place(b)
    numbers = np.arange(a.rows)
    shard, slot = a.shard_and_slot(numbers)
    assert {n: v[:2] for n, v in place(a).items()} == dict(zip(numbers.tolist(), zip(shard.tolist(), slot.tolist())))
    assert (a.row_number(shard, slot) == numbers).all()
    files = a.read().groupBy(F.input_file_name().alias("f")).agg(F.countDistinct("shard").alias("s"), F.max("slot").alias("b"), F.min("slot").alias("a")).collect()
    assert all(r["s"] == 1 and r["b"] // 7 == r["a"] // 7 for r in files)


def test_rows_that_no_plain_scan_gives(spark, docs):
    some = docs.where("doc_id % 3 <> 0")
    rows = sharding_report(some).collect()
    laws(rows, some.count())
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in some.collect()}
    swapped = docs.where("doc_id <> 5").join(spark.createDataFrame([(i,) for i in range(1000)] + [(7,)], "doc_id bigint"), "doc_id")
    laws(sharding_report(swapped).collect(), docs.count())  # as many rows as in the file, but one twice and one not at all
    twice = docs.unionByName(docs)
    laws(sharding_report(twice).collect(), 2 * docs.count())


def test_odd_rows(spark, odd, clash, none):
    for table in (odd, clash):
        rows = sharding_report(table).collect()
        laws(rows, odd.count())
        assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1) for r in odd.collect())
    assert sharding_report(none).collect() == []
    named = odd.select(F.lit(1).alias("_metadata"), F.lit(2).alias("slot"), F.lit(3).alias("shard"), F.lit("f").alias("__file"), "*")
    laws(sharding_report(named).collect(), odd.count())


def test_a_third_of_all_rows_alike(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    laws(sharding_report(rows).collect(), 900)
