"""Calls of models in batches: a failed batch is tried again row by row, and a failed row keeps what it had."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class BatchModel(Protocol):
    """Answers for a list of texts, one each, None where there is none; may raise."""

    def __call__(self, texts: list[str]) -> Sequence[Any]: ...


def _answers(model: BatchModel, texts: list[str]) -> list[Any]:
    got = list(model(texts))
    if len(got) != len(texts):
        raise ValueError(f"{len(got)} answers to {len(texts)} texts")
    return got


def call_in_batches(rows: DataFrame, text: str, out: str, kind: str, model: BatchModel, size: int = 50) -> DataFrame:
    """The rows with ``out`` (of Spark type ``kind``), ``out``_error and ``out``_seconds.

    A partition's texts go to the model ``size`` at a time, across the batches that Spark hands over; null texts are not
    sent.  If a call fails, each of its texts is sent alone, and a row whose own call fails has no answer but the error's
    text; all others are as if nothing had failed.  Seconds are a call's time divided among its rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(kind)), T.StructField(f"{out}_error", T.StringType()), T.StructField(f"{out}_seconds", T.DoubleType())])
    answer_type = to_arrow_type(schema[out].dataType)

    def one_batch(texts: list[str]) -> Iterator[tuple[Any, str | None, float]]:
        began = time.perf_counter()
        try:
            got, errors = _answers(model, texts), [None] * len(texts)
        except Exception:  # noqa: BLE001  a model may raise anything
            got, errors = [], []
            for t in texts:
                try:
                    got.append(_answers(model, [t])[0])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    got.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
        each = (time.perf_counter() - began) / len(texts)
        yield from ((a, e, each) for a, e in zip(got, errors))

    def answered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = table.column(text).to_pylist()
        sent = [i for i, t in enumerate(texts) if t is not None]
        answers, errors, seconds = [None] * len(texts), [None] * len(texts), [0.0] * len(texts)
        for k in range(0, len(sent), size):
            part = sent[k : k + size]
            for i, (a, e, s) in zip(part, one_batch([texts[i] for i in part])):
                answers[i], errors[i], seconds[i] = a, e, s
        for name, values, type_ in ((out, answers, answer_type), (f"{out}_error", errors, pa.string()), (f"{out}_seconds", seconds, pa.float64())):
            table = table.append_column(name, pa.array(values, type_))
        yield from table.to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= size:
                table = pa.Table.from_batches(held)
                whole = count - count % size  # null texts among them make the last call of a stretch smaller
                yield from answered(table.slice(0, whole))
                held, count = table.slice(whole).to_batches(), count - whole
        if count:
            yield from answered(pa.Table.from_batches(held))

    return rows.mapInArrow(work, schema)
