"""A reproducible shuffle of a whole table into shards: a Feistel permutation of global row numbers.

A row's global number is its place in the table: files in order of their paths, rows in their order in the file.  Both
come with the scan, so numbering takes counts of rows by file and no sort.  The permutation is computed, not stored:
number p of the shuffled order is row p % shards, slot p // shards, of the shards, and its inverse tells which row of the
table a slot holds.  So rows travel once, to the file that they end up in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from docweave.llm.common import mix, positional, scratch

#: Columns that the operator adds to a document's own in the files of a shard.
PLACE = ("shard", "slot", "row_number")


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. n - 1 that a seed names.

    A Feistel network permutes the numbers of the least number of bits that holds n of them; numbers beyond n walk on
    along their cycle until they fall below n.  Fewer than half of the numbers lie beyond, so a walk is short.
    """

    n: int
    seed: int = 0
    rounds: int = 8

    def _halves(self) -> tuple[int, int]:
        bits = max(2, (self.n - 1).bit_length())
        return bits // 2, bits - bits // 2

    def _f(self, half: np.ndarray, i: int, bits: int) -> np.ndarray:
        key = np.uint64((self.seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        return mix(mix(half ^ key, 0xFF51AFD7ED558CCD) + key, 0xC4CEB9FE1A85EC53) >> np.uint64(64 - bits)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = self._halves()
        a, b = x >> np.uint64(right), x & np.uint64((1 << right) - 1)
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            bits = right if i % 2 else left  # of the half that changes; halves change places every round
            a, b = (b ^ self._f(a, i, bits), a) if back else (b, a ^ self._f(b, i, bits))
        return (a << np.uint64(right)) | b

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(numbers, np.uint64)
        if x.size and int(x.max()) >= self.n:
            raise ValueError("a number beyond the table")
        x = self._once(x, back)
        while len(beyond := np.flatnonzero(x >= np.uint64(self.n))):
            x[beyond] = self._once(x[beyond], back)
        return x.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def inverse(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, True)


@dataclass(frozen=True)
class Shards:
    """Shard files below ``path``, one folder a shard, each file in order of slots."""

    spark: SparkSession
    path: str
    rows: int
    shards: int
    seed: int
    schema: StructType

    def read(self) -> DataFrame:
        """All columns of the table, and shard, slot and row_number behind them."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/shards")

    def shard_and_slot(self, row_number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where rows of the table stand, by computation alone."""
        place = Feistel(self.rows, self.seed).forward(row_number)
        return place % self.shards, place // self.shards

    def row_number(self, shard: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which rows of the table slots hold, by computation alone."""
        return Feistel(self.rows, self.seed).inverse(np.asarray(slot, np.int64) * self.shards + np.asarray(shard, np.int64))


def _with_place(docs: DataFrame) -> DataFrame | None:
    """The table by positions of columns with the file and row of each row; None if rows don't come from files as they are."""
    try:
        source = docs.metadataColumn("_metadata")
        rows = docs.select(source["file_path"], source["row_index"], "*")
    except AnalysisException:
        return None
    return rows.toDF("__file", "__row", *[f"c{i}" for i in range(len(docs.columns))])


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """The table with columns c0, c1, ... and its global row numbers (row_number), and how many rows it has.

    A table that is no plain scan of Parquet files is stored first, sorted by all its columns; equal rows are dealt
    over tasks, as they may be any part of it.
    """
    rows = _with_place(docs)
    if rows is not None:
        n, row = F.count("*").cast("decimal(38,0)"), F.col("__row").cast("decimal(19,0)")
        each_once = (n == F.max("__row") + 1) & (F.sum(row) * 2 == n * (n - 1)) & (F.sum(row * row) * 6 == n * (n - 1) * (2 * n - 1))
        if rows.groupBy("__file").agg(each_once.alias("whole")).agg(F.bool_and("whole").alias("whole")).first()["whole"] is False:
            rows = None  # filtered, joined or repeated rows: their places in files are no numbers
    if rows is None:
        path, plain = scratch(docs.sparkSession, "sharding-table"), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        keys = [F.to_json(F.struct(c)) if t.startswith(("map", "struct", "variant")) else F.col(c) for c, t in plain.dtypes]
        tied = plain.withColumn("__tie", F.monotonically_increasing_id())
        tied.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys).drop("__tie").write.option("compression", "zstd").parquet(path)
        back = docs.sparkSession.read.schema(plain.schema).parquet(path)
        rows = back.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), *back.columns)
    files = rows.groupBy("__file").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    before = files.select("__file", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__before"))
    known = before.agg(F.sum("n").alias("n"), F.count("*").alias("files")).first()
    if known["files"] <= 1_000_000:  # some 200 bytes each
        before = F.broadcast(before)
    out = rows.join(before.drop("n"), "__file").withColumn("row_number", F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")
    return out, known["n"] or 0


def write_shards(docs: DataFrame, shards: int = 16, seed: int = 11, rows_a_file: int = 16_384, path: str | None = None) -> Shards:
    """Deals every row of a table into shards whose numbers of rows are at most one apart, in a shuffled order, and writes them.

    The order depends on the number of rows, the seed and the place of a row in the table, and on nothing in the row: null
    ids, null, empty and very long texts, repeated rows and rows that tie are rows like others, each with a slot of its
    own.  Equal texts are not kept together; as counts are at most one apart, a group larger than a shard could not be.
    Columns may have any names, twice or in any case: they come back in their order.  An empty table gives empty shards.
    Each file holds ``rows_a_file`` slots in a row of one shard, written by one task.
    """
    rows, n = numbered(docs)
    spark = docs.sparkSession
    path = path or scratch(spark, "shards")
    files = max(1, -(-(-(-n // shards)) // rows_a_file))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Feistel(n, seed)
        for batch in batches:
            place = order.forward(batch.column("row_number").to_numpy())
            shard, slot = place % shards, place // shards
            to = (shard * files + slot // rows_a_file).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(slot), pa.array(to)], names=[*batch.schema.names, "shard", "slot", "file_number"])

    schema = StructType([*rows.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    dealt = rows.mapInArrow(work, StructType([*schema.fields, StructField("file_number", IntegerType())])).repartitionById(shards * files, F.col("file_number"))
    dealt.sortWithinPartitions("shard", "slot").drop("file_number").write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/shards")
    return Shards(spark, path, n, shards, seed, schema)


def sharding_report(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """Writes the shards of a table with doc_id and text and reads from their files what each row is and where it stands.

    doc_id, size (UTF-8 bytes of the text, none for null, and 1), text_crc32, law (``rows``), shard, slot, grown_shard (null:
    with more shards, rows of this law move as they must).
    """
    _, places = positional(docs)
    written = write_shards(docs, shards, seed)
    text = F.coalesce(F.col(places["text"]).cast("string"), F.lit(""))
    return written.read().select(
        F.col(places["doc_id"]).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
