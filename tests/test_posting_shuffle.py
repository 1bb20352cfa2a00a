"""What carries posting blocks through a shuffle gives them back whole, in few bytes."""

from pyspark.sql import functions as F

from docweave.operators import postings
from docweave.operators.retrieval import plain_tokens
from docweave.plans.base import Tables
from docweave.sources.storage import scratch

SF = "/root/testdata/sf0.001"


def test_blocks_come_back_whole_from_payloads(spark):
    t = Tables(spark, SF)
    nodes = t.chunks.unionByName(t.chunks.limit(1).withColumn("node_id", F.lit(None).cast("string"))).repartition(2)
    path = scratch(spark, "posting-nodes")
    nodes.write.parquet(path)
    nodes = spark.read.parquet(path)
    fields = {"text": plain_tokens(F.col("text")), "lead": plain_tokens(F.substring("text", 1, 30))}
    plain = postings.node_blocks(nodes, "node_id", fields)
    packed = postings.node_blocks(nodes, "node_id", fields, buckets=8)
    schema = postings.BLOCKS.replace("docs array<bigint>", "docs array<string>")
    back = packed.repartition(3, "bucket").mapInArrow(postings._opened, schema + ", bucket int")
    want, got = (sorted(map(str, df.collect())) for df in (plain, back.drop("bucket")))
    assert len(want) > 1000 and got == want
    assert all(r["bucket"] == (-1 if r["term"] is None else postings.bucket_of(r["term"], 8)) for r in back.select("term", "bucket").distinct().collect())


def test_an_index_is_shuffled_in_less_than_its_text(spark):
    """As rows, blocks took some ten times the text."""
    t = Tables(spark, SF)
    text = t.chunks.agg(F.sum(F.octet_length("text"))).first()[0]
    packed = postings.node_blocks(t.chunks.coalesce(1), "node_id", {"text": plain_tokens(F.col("text"))}, buckets=4)
    assert packed.agg(F.sum(F.octet_length("payload"))).first()[0] < text
