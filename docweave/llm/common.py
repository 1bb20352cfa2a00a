"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.storage import scratch

#: Words are split at space and at tab to carriage return, as ``bytes.split()`` does it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; sets a folder of its own only where none is set."""
    scratch(df.sparkSession, "unused")
    return df.checkpoint()


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, kind: str, arrow_rows: int | None = None) -> DataFrame:
    """Write to the shared folder as Parquet and read it back: cuts lineage and survives lost executors.

    ``arrow_rows`` bounds the batches that Python is sent meanwhile, for tables of large rows: both sides hold them whole.
    """
    path, conf = scratch(df.sparkSession, kind), df.sparkSession.conf
    before = conf.get(_ARROW_ROWS)
    try:
        if arrow_rows:
            conf.set(_ARROW_ROWS, str(min(arrow_rows, int(before)) if int(before) > 0 else arrow_rows))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_ARROW_ROWS, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the folders of stored tables that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "__dict__", {}).get("stored_at")) is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns named by place, and where to find a name.

    So further columns whose names clash, or differ in case alone, do no harm: the first column of exactly that name
    counts, else the first that differs in case.
    """
    places: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        places.setdefault(c, f"c{i}")
    for i, c in enumerate(df.columns):
        places.setdefault(c.lower(), f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), places


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else the table holds."""
    rows, places = positional(df)
    return rows.select(*[F.col(places[n]).alias(n) for n in names])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.where(_SPACE, np.uint64(0), np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, np.uint64))
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
#: Odd factors of a byte's place in its word; grows with the longest word.
_PLACE = np.zeros(0, np.uint64)


def mix(x: np.ndarray, by: int) -> np.ndarray:
    """Spreads 64-bit numbers; one to one for an odd factor."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, one behind the other, and where each starts; a null text is empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(text) else np.zeros(0, np.uint8)
    return data, at - at[0] if len(text) else np.zeros(1, np.int64)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in the bytes of texts, and how many words stand before each text and in all."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, at)


def _keys(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    global _PLACE
    starts, ends, before = word_spans(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    longest = int((ends - starts).max())
    if longest > len(_PLACE):
        _PLACE = mix(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93) | np.uint64(1)
    gaps = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, gaps)  # beyond a word's end bytes count nothing
    sums = np.add.reduceat((_LOWER if lower else _BYTE)[data[starts[0] :]] * _PLACE[np.minimum(place, longest - 1)], starts - starts[0])
    return mix(sums + (ends - starts).astype(np.uint64), 0xFF51AFD7ED558CCD), before


def word_keys(text: pa.Array, lower: bool = True, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a batch's texts, and how many stand before each text and in all.

    A word's hash is the sum over its bytes of a random number of the byte times one of its place, mixed.  Texts are
    worked through in groups of about ``size`` bytes, so only a single longer text takes more memory.
    """
    data, at = text_bytes(text)
    keys, counts, i = [], [np.zeros(1, np.int64)], 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        found, before = _keys(data[at[i] : at[j]], at[i : j + 1] - at[i], lower)
        keys.append(found)
        counts.append(before[1:] + counts[-1][-1])
        i = j
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(counts)


#: What empties the caches of this Python worker, by whoever fills them.
on_release: list[Callable[[], None]] = []
_libc = ctypes.CDLL(None) if sys.platform.startswith("linux") else None


def release_caches() -> None:
    """Empties all caches of this worker, which other operators may have left full."""
    for empty in on_release:
        empty()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def forgetting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes a task's results on and empties the caches behind them: idle Python workers hold none."""
    yield from batches
    release_caches()


def small_batches(batches: Iterable[pa.RecordBatch], column: str, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``rows`` rows and, beyond one row, about ``size`` bytes of a column."""
    for batch in batches:
        at, lengths = 0, None
        if batch.num_rows:
            lengths = batch.column(column)
            lengths = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            end, total = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or total + lengths[end] <= size):
                total += int(lengths[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end
