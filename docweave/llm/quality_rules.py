"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths find, within one text, the n-grams that occur again; the share of
the text's word characters inside them, and inside repeated lines, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import forgetting, only, positional, release_caches, small_batches, text_bytes, word_keys, word_spans

#: Odd multiplier of the rolling hash.
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class CoverageRules:
    """Highest shares of word characters that a kept text may have.

    ``ngram_share`` maps an n-gram length to the share inside n-grams that occur twice or more, first one included.
    ``line_share`` is the share of all characters in lines with a word that equal an earlier line.
    """

    ngram_share: tuple[tuple[int, float], ...] = ((3, 0.50), (5, 0.40), (8, 0.30), (12, 0.28))
    line_share: float = 0.30
    min_words: int = 20
    base_window: int = 8
    base_percent: int = 30


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"


def covered(words: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that lie in an n-word window occurring twice or more."""
    mask = np.zeros(len(words), bool)
    if len(words) <= n:
        return mask
    rolled = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        rolled = rolled * _STEP + words[i : len(words) - n + 1 + i]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return mask
    again = np.zeros(len(rolled), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-1][: len(rolled)] += again
    edge[n : n + len(rolled)] -= again
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, keys: np.ndarray, sizes: np.ndarray, symbols: int, rules: CoverageRules = CoverageRules()) -> tuple:
    """All columns but doc_id for one text (null: empty), given the hashes and characters of its words and its symbols."""
    text, n, total = text or "", len(keys), int(sizes.sum())
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line)
            else:
                seen.add(line)
    repeat, worst, kept = 0, 0.0, True
    shares = dict(rules.ngram_share)
    for length in sorted({*shares, rules.base_window}) if n else []:
        mask = covered(keys, length)
        if length == rules.base_window:
            repeat = int(mask.sum())
        if length in shares:
            share = float(sizes[mask].sum()) / total
            worst = max(worst, share)
            kept &= share <= shares[length]
    line_share = dup_line_chars / max(1, len(text))
    kept &= line_share <= rules.line_share
    failed = n < rules.min_words or 100 * repeat > rules.base_percent * n
    return n, total, symbols, dup_lines, repeat, failed, bool(kept and not failed), line_share, worst


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True


def measured(text: pa.Array, rules: CoverageRules = CoverageRules()) -> list[tuple]:
    """``measure`` of each text of a batch; its bytes are hashed and counted for all texts at once."""
    data, at = text_bytes(text)
    starts, ends, before = word_spans(data, at)
    keys, _ = word_keys(text, lower=False)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    sizes, marks = chars[ends] - chars[starts], np.diff(marks[at]).tolist()
    return [measure(t, keys[i:j], sizes[i:j], m, rules) for t, i, j, m in zip(text.to_pylist(), before[:-1], before[1:], marks)]


def repetition_coverage(docs: DataFrame, rules: CoverageRules = CoverageRules()) -> DataFrame:
    """One row per document with its counts, shares and verdict.

    Words are runs of anything but space and U+0009 to U+000D; a null text has none.  ``n_repeat_words`` counts words in
    8-word windows found twice or more in the text.  ``base_failed`` is true with fewer than 20 words or if over 30 %
    of the words repeat so; ``kept`` is false then, and otherwise says whether no share of repeated n-grams or
    lines passes its bound.  A null doc_id stays null, repeated rows give one row each, an empty table gives none, and
    further columns are ignored.  Each text is judged whole, in a map without a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_share", pa.float64()), ("dup_ngram_share", pa.float64())])
        for batch in small_batches(batches, "text", 1024, 1 << 20):
            rows = measured(batch.column("text"), rules)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]], schema=schema)

    return only(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lambda b: forgetting(work(b)), SCHEMA)


def keep_good(docs: DataFrame, rules: CoverageRules = CoverageRules()) -> DataFrame:
    """The documents whose text the rules keep, with all their columns, filtered in place by a vectorised predicate."""
    @F.pandas_udf("boolean")
    def good(text):  # noqa: ANN001, ANN202  pandas UDF
        release_caches()
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True)], names=["text"])
        return pd.Series([m[6] for part in small_batches([batch], "text", 256, 1 << 20) for m in measured(part.column("text"), rules)], dtype=bool)

    rows, at = positional(docs)
    return rows.where(good(F.col(at["text"]))).toDF(*docs.columns)


