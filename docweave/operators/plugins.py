"""What a deployment may plug in, each with a deterministic offline default, none of them posing as a remote model."""

from __future__ import annotations

import hashlib
import logging
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.batches import BatchModel, call_in_batches

WORDS = regex.compile(r"[\p{L}\p{N}_]+")


class PageParser(Protocol):
    """An expression from a file's text to what parsing it gives; null where that failed."""

    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    """Scores of texts for a query, higher ones better; may raise."""

    def __call__(self, query: str, texts: pd.Series) -> pd.Series: ...


class HashedEmbedder:
    """Sixteen counts of words by the first digit of their MD5; None for a text without words."""

    def __init__(self) -> None:
        self.digit: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            counts = [0.0] * 16
            words = WORDS.findall(text.lower())
            for w in words:
                if (d := self.digit.get(w)) is None:
                    d = self.digit[w] = int(hashlib.md5(w.encode()).hexdigest()[0], 16)
                counts[d] += 1
            out.append(counts if words else None)
            if len(self.digit) > 200_000:
                self.digit = {}
        return out


class CommonWords:
    """Keywords of a text: its most frequent words of five letters or more, the first in the alphabet of equally frequent ones."""

    def __init__(self, count: int = 5):
        self.count = count

    def __call__(self, texts: list[str]) -> list[list[str]]:
        found = [Counter(w for w in WORDS.findall(t.lower()) if len(w) >= 5) for t in texts]
        return [sorted(c, key=lambda w: (-c[w], w))[: self.count] for c in found]


def same_text(text: Column) -> Column:
    return text


def overlap_reranker(query: str, texts: pd.Series) -> pd.Series:
    """How many distinct words of the query a text holds."""
    words = set(query.lower().split())
    return texts.fillna("").map(lambda t: float(len(words & set(t.lower().split()))))


def embed(nodes: DataFrame, key: str, text: str, embedder: BatchModel | None = None, size: int = 50) -> DataFrame:
    """(key, embedding) of the nodes that could be embedded, 50 texts a call."""
    rows = call_in_batches(nodes.select(key, text), text, "embedding", "array<float>", embedder or HashedEmbedder(), size)
    return rows.where("embedding is not null").select(key, "embedding")


def rebuilt_vectors(nodes: DataFrame, key: str, text: str, width: int, embedder: BatchModel | None = None) -> DataFrame:
    """The nodes with an embedding, made anew where there is none, and whether it has ``width`` entries (fitting); nodes that
    cannot be embedded are left out."""
    there = nodes.where("embedding is not null")
    made = call_in_batches(nodes.where("embedding is null").drop("embedding"), text, "embedding", "array<float>", embedder or HashedEmbedder())
    rows = there.unionByName(made.where("embedding is not null").select(*there.columns))
    return rows.withColumn("fitting", F.size("embedding") == width)


def with_keywords(nodes: DataFrame, text: str, model: BatchModel | None = None, size: int = 10) -> DataFrame:
    """Nodes with keywords, their error and seconds, and the text with its keywords in a block behind it, ten texts a call;
    without keywords, or where the model failed, the text stays as it was."""
    rows = call_in_batches(nodes, text, "keywords", "array<string>", model or CommonWords(), size)
    block = F.concat(F.col(text), F.lit("\n\nKeywords: "), F.array_join("keywords", ", "))
    return rows.withColumn(text, F.when(F.size("keywords") > 0, block).otherwise(F.col(text)))


def origin_nodes(docs: DataFrame, size: int = 128, overlap: int = 16, model: BatchModel | None = None) -> DataFrame:
    """doc_id, node_id, chunk_index, total_chunks, text, keywords, keywords_error of documents (doc_id, text) split at sentences:
    the nodes that everything else is derived from, enhanced by the keyword model."""
    from docweave.operators.parsing import sentence_chunks

    pieces = sentence_chunks(docs, size, overlap)
    rows = pieces.withColumn("node_id", F.concat_ws("_", "doc_id", "chunk_index"))
    return with_keywords(rows, "text", model).drop("keywords_seconds")


def rerank(hits: DataFrame, query: str, text: str, reranker: Reranker | None = overlap_reranker, order: str = "rank") -> DataFrame:
    """Adds rerank_score and new_rank to a cut list of hits; without a model, or where it fails, the old order stays.

    ``hits`` is a top-k list, so it is small by definition and is scored in one piece, as a model compares them.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        b = pd.concat(held).sort_values(order, kind="stable")
        try:
            if reranker is None:
                raise ValueError("no model")
            b["rerank_score"] = reranker(query, b[text]).astype(float)
            b = b.sort_values("rerank_score", ascending=False, kind="stable")
        except Exception as e:  # noqa: BLE001  a plug-in may raise anything; the fused order is the fallback
            logging.getLogger(__name__).warning("reranking failed, the order stays: %s: %s", type(e).__name__, e)
            b["rerank_score"] = None
        b["new_rank"] = range(1, len(b) + 1)
        yield b

    schema = T.StructType([*hits.schema.fields, T.StructField("rerank_score", T.DoubleType()), T.StructField("new_rank", T.LongType())])
    return hits.coalesce(1).mapInPandas(work, schema)
