"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by id, so the files are in id order and the stripes' and row groups'
minima and maxima, together with the Bloom filters, let a reader of a few documents skip the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.llm.common import only, scratch, small_batches
from docweave.llm.encoders import encoder

#: Columns of the files; ``part_start`` counts the ids before the document in its part.
FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)),
    ]
)


@dataclass(frozen=True)
class OrcLayout:
    """Writer settings; a stripe is the unit of parallel reads."""

    stripe_bytes: int = 64 << 20
    index_stride: int = 1_000
    bloom_fpp: float = 0.01
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.compression,
            "orc.stripe.size": str(self.stripe_bytes),
            "orc.create.index": "true",
            "orc.row.index.stride": str(self.index_stride),
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": str(self.bloom_fpp),
        }


def encode_documents(docs: DataFrame, vocabulary: str, keeps_space: bool = True, end_id: int = 0) -> DataFrame:
    """Rows of the files, in ascending doc_id order over the partitions (null ids first; ties in order of text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(vocabulary, keeps_space), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "text", 16_384, 8 << 20):
            ids, at = enc.encode(batch.column("text"))
            edges = at + np.arange(len(at))
            flat = np.insert(ids, at[1:], end_id).astype(np.int32)
            arrays = [batch.column("doc_id"), pa.array(np.full(len(at) - 1, part, np.int32)), pa.array(start + edges[:-1]), pa.array(np.diff(edges).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))]
            start += int(edges[-1])
            yield pa.RecordBatch.from_arrays(arrays, names=FILE_SCHEMA.names)

    rows = only(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(work, FILE_SCHEMA)


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, keeps_space: bool = True, end_id: int = 0, layout: OrcLayout = OrcLayout()) -> None:
    """Encode every whole text, append ``end_id``, and write ORC files in ascending doc_id order.

    A null text is empty and gives the end id alone.  Repeated rows stay repeated, an empty table writes no rows, and
    further columns are ignored.
    """
    encode_documents(docs, vocabulary, keeps_space, end_id).write.options(**layout.options()).orc(path)


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with ``doc_ids``, statistics and Bloom filters prune stripes and row groups."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before, by the files' counts; a row for each part meets in one place."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").withColumn("start", F.col("offset") + F.col("part_start")).drop("offset")


def checksums(rows: DataFrame) -> DataFrame:
    """Replaces the ids of rows read back by the crc32 of them as little-endian unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            edges = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "part", "part_start", "n_tokens")], pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(work, "doc_id bigint, part int, part_start bigint, n_tokens int, ids_crc32 bigint")


def token_file_report(docs: DataFrame, vocabulary: str, layout: OrcLayout = OrcLayout()) -> DataFrame:
    """Write the files below the shared folder, read them back and digest them, one row per document."""
    spark = docs.sparkSession
    path = scratch(spark, "token-ids")
    write_token_ids(docs, path, vocabulary, layout=layout)
    files = read_token_ids(spark, path)
    rows = with_starts(checksums(files), files)
    return rows.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
