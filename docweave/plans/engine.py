"""One object over a document table and a vector table: ingest plans, hybrid search and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import fixed_chunks
from docweave.operators import fusion, ingest, lifecycle, retrieval
from docweave.operators.ingest import Library, Steps
from docweave.operators.postings import KeywordIndex
from docweave.sources.versions import TableStore


class Engine:
    """``documents`` has doc_id and text (and what filters name); ``vectors`` has id and embedding, ids as doc_id."""

    def __init__(self, documents: DataFrame, vectors: DataFrame | None = None, index: KeywordIndex | None = None):
        self.documents, self.vectors, self.index = documents, vectors, index

    def search(self, terms: list[str], query: DataFrame | None = None, kind: str = "hybrid", fuse: str = "rrf", top_k: int = 10, where: Column | None = None, post: bool = False) -> DataFrame:
        """Hits (id, fused or score, rank); filters hold before any cut, or only on the hits (``post``), of which fewer are left then.

        kind: vector, keyword or hybrid; fuse: rrf, adaptive, or weighted.  ``query`` is a one-row table with column ``query``.
        """
        if kind not in ("vector", "keyword", "hybrid"):
            raise ValueError(f"unknown kind of search: {kind}")
        docs = self.documents if where is None else self.documents.where(where)
        if post and where is not None:
            hits = self.search(terms, query, kind, fuse, top_k)
            return docs.select(F.col("doc_id").alias("id")).join(hits, "id").select(*hits.columns)
        fetch = top_k * max(3, top_k // 5) if kind == "hybrid" else top_k
        vector = keyword = None
        if kind != "keyword":
            points = self.vectors if where is None else self.vectors.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
            vector = retrieval.top(retrieval.vector_scores(points, "id", "embedding", query), "id", F.desc("score"), fetch)
        if kind != "vector":
            allowed = None if where is None else docs.select(F.col("doc_id").alias("key"))
            if self.index is not None:
                keyword = retrieval.fts_top(self.index, "id", terms, fetch, allowed=allowed)
            else:
                hits = retrieval.fts_scores(self.documents, "doc_id", retrieval.plain_tokens(F.col("text")), terms).withColumnRenamed("doc_id", "id")
                hits = hits if allowed is None else hits.join(allowed.withColumnRenamed("key", "id"), "id", "left_semi")
                keyword = retrieval.top(hits, "id", F.col("score"), fetch)
        if kind == "vector":
            return vector
        if kind == "keyword":
            return keyword
        if fuse == "rrf":
            return fusion.rrf(vector, keyword, top_k)
        return fusion.adaptive(vector, keyword, " ".join(terms), top_k) if fuse == "adaptive" else fusion.weighted(vector, keyword, top_k)

    def payload(self, hits: DataFrame, text: int = 200) -> DataFrame:
        """Hits (id, ...) with what the library knows of their documents; Spark sends a list to all tasks if it is small."""
        rows = self.documents.withColumn("preview", F.substring("text", 1, text)).drop("text").withColumnRenamed("doc_id", "id")
        return rows.join(hits, "id")

    def ingest(self, store: TableStore, steps: Steps | None = None) -> Library:
        """The library's version after this engine's documents (doc_id, source, text) came in."""
        return ingest.ingest(store, self.documents, steps)

    def chunks(self, width: int = 1000) -> DataFrame:
        rows = self.documents.select("doc_id", F.posexplode(fixed_chunks(F.col("text"), width)).alias("chunk_index", "text"))
        return rows.withColumn("chunk_index", F.col("chunk_index").cast("bigint")).withColumn("node_id", F.concat_ws("_", "doc_id", "chunk_index"))

    def changes(self, old: DataFrame) -> DataFrame:
        """What to do about each document, compared with an older documents table: class, strategy, priority, effort.

        Classes go by metadata hashes (source, size, time, content), so a touched document counts as changed.
        """
        side = lambda df, stamp, length: ingest.fingerprinted(df).select("doc_id", F.col("metadata_hash").alias(stamp), F.col("size").alias(length))
        joined = side(self.documents, "current", "length").join(side(old, "stored", "old_length"), "doc_id", "full_outer")
        kind = lifecycle.change_class(F.col("stored"), F.col("current"), F.col("old_length"), F.col("length"))
        out = joined.select("doc_id", kind.alias("change_type"), F.coalesce("length", F.lit(0)).alias("length"))
        c = F.col("change_type")
        return out.select("doc_id", "change_type", lifecycle.strategy(c).alias("strategy"), lifecycle.priority(c).alias("priority"), lifecycle.effort(c, F.col("length"), F.lit(0)).alias("effort"))
