"""Blocks of documents that meet their dictionaries.

Some operators must look up every word of every document in a table that grows with the corpus.  Joining word by word
would shuffle many times the input.  Instead documents travel once as compressed blocks; a block sends each distinct
key once to the bucket of the key's hash, buckets merge what all blocks sent, and each answer goes back to its block.
A block gives a key once, so a frequent key weighs no more than the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from docweave.llm.common import forgetting, only, small_batches


def buckets(spark: SparkSession) -> int:
    """Partitions of the exchanges: the session's setting, so buckets shrink as a cluster is tuned for more data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of the types that ``unpack_arrays`` is told, each by byte planes, of which high ones are mostly zero."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return squeeze(b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *planes]))


def unpack_arrays(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = unsqueeze(data)
    lengths, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(lengths.tolist(), kinds):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return squeeze(sink.getvalue().to_pybytes())


def document_blocks(docs: DataFrame, rows: int = 16_384, size: int = 8 << 20, pack: Callable[[pa.Table], bytes] = packed_table) -> DataFrame:
    """block_id and payload: whole documents, at most ``rows`` or about ``size`` bytes of text a block.

    ``pack`` makes the payload of a block's table of doc_id and text.  The blocks are dealt by their id; everything that
    needs them reads that one exchange.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, load, count, number = [], 0, 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            payload = pack(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())], names=["block_id", "payload"])

        for batch in small_batches(batches, "text", 1024, 1 << 20):
            held.append(batch)
            count += batch.num_rows
            load += batch.nbytes
            if count >= rows or load >= size:
                yield out()
                held, load, count, number = [], 0, 0, number + 1
        if count:
            yield out()

    plain = only(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return plain.mapInArrow(lambda b: forgetting(work(b)), "block_id bigint, payload binary").repartition(buckets(docs.sparkSession), "block_id")


def open_block(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(payload)).read_all()


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable[[int, bytes, dict[int, dict]], pa.Table], schema: str) -> DataFrame:
    """Bring each block together with its answers, one of each bucket it asked, and run ``work`` on them."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()
        if len(block) != 1:
            raise ValueError("answers without their block: the blocks were not the same in both places")
        return work(block[0]["block_id"], block[0]["payload"], {r["bucket"]: r for r in right.to_pylist()})

    return blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(both, schema)
