"""Ingest: what changed, what to do about it, and one commit of every table of a library.

A batch is joined with the registry once; what has to be done is stored, chunked, sent to the models and written as a further
segment of the library's tables, and nothing of a batch is seen before all of it is.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import clean_text, fixed_chunks
from docweave.operators import lifecycle
from docweave.operators.batches import BatchModel, call_in_batches
from docweave.operators.parsing import classify, pairs_from_literal
from docweave.operators.plugins import HashedEmbedder, PageParser, same_text, with_keywords
from docweave.operators.postings import KeywordIndex
from docweave.operators.retrieval import plain_tokens
from docweave.sources.versions import Snapshot, TableStore, Transaction

_PAIRS = "array<struct<model:string,part:string>>"
REGISTRY = f"doc_id bigint, source string, metadata_hash string, size bigint, state string, chunk_count bigint, vector_indexed boolean, keyword_indexed boolean, error_count bigint, last_error string, pairs {_PAIRS}"
#: One row a chunk: what a batch did to it (action), what stood there before (held) and, of those it embedded, all the rest.
NODES = "node_id string, doc_id bigint, chunk_index bigint, action string, held string, chunk_hash string, text string, keywords array<string>, keywords_error string, keywords_seconds double, embedding array<float>, embedding_error string, embedding_seconds double"
STAGES = "doc_id bigint, stage string, items bigint, failed bigint, seconds double"
RUNS = "version bigint, report string"


@dataclass(frozen=True)
class Library:
    """The tables of one version of a library."""

    snapshot: Snapshot

    def _table(self, name: str, schema: str) -> DataFrame:
        there = name in self.snapshot.tables
        return self.snapshot.table(name) if there else self.snapshot.store.spark.createDataFrame([], schema)

    @property
    def registry(self) -> DataFrame:
        """A row a document: state, chunks, which indexes hold it, errors so far, its pairs."""
        return self._table("registry", REGISTRY)

    @property
    def nodes(self) -> DataFrame:
        """A row a chunk: node_id, doc_id, chunk_index, chunk_hash, text, keywords, embedding (null: could not be made)."""
        return self._table("nodes", NODES).where("action = 'embed'").select("node_id", "doc_id", "chunk_index", "chunk_hash", "text", "keywords", "embedding")

    @property
    def entries(self) -> DataFrame:
        """doc_id, index_type, chunk_index, chunk_hash: one for each chunk in each index."""
        kinds = F.when(F.col("embedding").isNotNull(), F.array(F.lit("keyword"), F.lit("vector"))).otherwise(F.array(F.lit("keyword")))
        return self.nodes.select("doc_id", F.explode(kinds).alias("index_type"), "chunk_index", "chunk_hash")

    @property
    def vectors(self) -> DataFrame:
        return self.nodes.where("embedding is not null").select("node_id", "doc_id", "chunk_index", "embedding")

    @property
    def stages(self) -> DataFrame:
        """What each ingest did for each document: stage, items, failed, seconds of the models' calls."""
        return self._table("stages", STAGES)

    @property
    def runs(self) -> DataFrame:
        """A report of each ingest, as JSON."""
        return self._table("runs", RUNS)

    @property
    def index(self) -> KeywordIndex:
        """Chunks by the words of their text and of their keywords; node ids are its keys."""
        return KeywordIndex(self.snapshot)


@dataclass(frozen=True)
class Steps:
    """What an ingest does with a document: ``parser`` reads files by the kind that their name tells (None: texts are what they
    are), ``pairs`` takes pairs of models and parts out of texts, ``keywords`` enhances chunks, ``embedder`` makes their vectors."""

    parser: PageParser | None = None
    pairs: bool = False
    keywords: BatchModel | None = None
    embedder: BatchModel = field(default_factory=HashedEmbedder)
    width: int = 1000
    embed_batch: int = 50
    keyword_batch: int = 10


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, size, metadata_hash of incoming documents (doc_id, source, text, and modified if it is there).

    Of several rows of one id the last modified counts, of those the one of the greatest source and text; a row without id is
    no document and is left out.
    """
    modified = F.col("modified").cast("double") if "modified" in docs.columns else F.lit(0.0)
    order = Window.partitionBy("doc_id").orderBy(F.desc("modified"), F.desc("source"), F.desc("text"))
    rows = docs.where("doc_id is not null").select("doc_id", "source", "text", modified.alias("modified"))
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    size, stamp = F.length("text").cast("bigint"), F.when(F.col("modified") == 0, "0").otherwise(F.col("modified").cast("string"))
    return rows.select("doc_id", "source", "text", size.alias("size"), lifecycle.metadata_hash(F.col("source"), size, stamp, lifecycle.content_hash(F.col("text"))).alias("metadata_hash"))


def planned(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """Incoming documents with change_type and strategy; a text that cannot be read gets the safe answer, a full reindex."""
    old = registry.select("doc_id", F.col("metadata_hash").alias("stored"), F.col("size").alias("old_size"), F.col("error_count").alias("errors_before"))
    kind = lifecycle.change_class(F.col("stored"), F.col("metadata_hash"), F.col("old_size"), F.col("size"))
    rows = fingerprinted(docs).join(old, "doc_id", "left").withColumn("change_type", F.when(F.col("text").isNull(), "complete_rewrite").otherwise(kind))
    return rows.withColumn("strategy", lifecycle.strategy(F.col("change_type"))).drop("stored", "old_size")


def chunk_actions(nodes: DataFrame, todo: DataFrame, width: int = 1000) -> DataFrame:
    """node_id, doc_id, strategy, chunk_index, text, chunk_hash, held, action (keep, embed, drop) of every chunk of the documents
    to do (doc_id, strategy, text).  An incremental update keeps the chunks whose text stands at the same place in both indexes.
    """
    pieces = todo.select("doc_id", "strategy", F.posexplode(fixed_chunks(F.col("text"), width)).alias("chunk_index", "text"))
    pieces = pieces.withColumn("chunk_index", F.col("chunk_index").cast("bigint")).withColumn("chunk_hash", F.sha2("text", 256))
    held = nodes.select("doc_id", "chunk_index", F.col("chunk_hash").alias("held"), F.col("embedding").isNotNull().alias("whole"))
    held = held.join(todo.select("doc_id", F.col("strategy").alias("its")), "doc_id")
    joined = pieces.join(held, ["doc_id", "chunk_index"], "full_outer").withColumn("strategy", F.coalesce("strategy", "its"))
    same = (F.col("strategy") == "incremental") & (F.col("held") == F.col("chunk_hash")) & F.col("whole")
    action = F.when(F.col("text").isNull(), "drop").when(same, "keep").otherwise("embed")
    return joined.select(F.concat_ws("_", "doc_id", "chunk_index").alias("node_id"), "doc_id", "strategy", "chunk_index", "text", "chunk_hash", "held", action.alias("action"))


def _read(plan: DataFrame, steps: Steps) -> DataFrame:
    """The plan with kind, the text that was read, and pairs; nothing is read of documents that are skipped."""
    text = F.when(F.col("strategy") != "skip", F.col("text"))
    plan = plan.withColumn("kind", classify(F.col("source")) if steps.parser else F.lit("text"))
    if steps.parser:
        text = F.when(F.col("kind") == "markdown", text).when(F.col("kind") != "unsupported", steps.parser(text))
    plan = plan.withColumn("text", text)
    if not steps.pairs:
        return plan.withColumn("pairs", F.array().cast(_PAIRS))
    pairs, rest = pairs_from_literal(F.col("text"))
    return plan.withColumns({"pairs": pairs, "text": rest})


def _made(actions: DataFrame, steps: Steps) -> DataFrame:
    """Nodes of the chunks to embed, through the models, and of the others without text."""
    todo, nothing = actions.where("action = 'embed'"), F.lit(None).cast("string")
    if steps.keywords is not None:
        todo = with_keywords(todo, "text", steps.keywords, steps.keyword_batch)
    else:
        todo = todo.withColumns({"keywords": F.lit(None).cast("array<string>"), "keywords_error": nothing, "keywords_seconds": F.lit(0.0)})
    made = call_in_batches(todo, "text", "embedding", "array<float>", steps.embedder, steps.embed_batch)
    names = [c.split()[0] for c in NODES.split(", ")]
    return made.unionByName(actions.where("action <> 'embed'").withColumn("text", nothing), allowMissingColumns=True).select(*names)


def _registry_rows(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """The registry's rows of the documents that a plan touches; one with a chunk that has no vector is corrupted."""
    held = F.col("action") != "drop"
    stored = held & ((F.col("action") == "keep") | F.col("embedding").isNotNull())
    per = nodes.groupBy("doc_id").agg(F.count_if(held).alias("chunks"), F.count_if(stored).alias("stored"), F.max("embedding_error").alias("error"))
    rows, read = plan.join(per, "doc_id", "left").na.fill(0, ["chunks", "stored"]), F.col("text").isNotNull()
    whole = (F.col("chunks") == F.col("stored")) & read
    error = F.when(~read, F.when(F.col("kind") == "unsupported", "no parser for this kind of file").otherwise("text cannot be read")).when(~whole, F.coalesce("error", F.lit("no vector")))
    errors = (F.coalesce("errors_before", F.lit(0)) + F.when(whole, 0).otherwise(1)).cast("bigint")
    return rows.select("doc_id", "source", "metadata_hash", "size", F.when(whole, "indexed").otherwise("corrupted").alias("state"), F.col("chunks").alias("chunk_count"), whole.alias("vector_indexed"), read.alias("keyword_indexed"), errors.alias("error_count"), error.alias("last_error"), "pairs")


def _stage_rows(plan: DataFrame, nodes: DataFrame, steps: Steps) -> DataFrame:
    """doc_id, stage, items, failed, seconds of every stage that a document went through."""
    made, zero = F.col("action") == "embed", F.lit(0)
    per = nodes.groupBy("doc_id").agg(
        F.count("*").alias("all"),
        F.count_if(made).alias("n"),
        F.count_if(made & F.col("keywords_error").isNotNull()).alias("no_keywords"),
        F.sum("keywords_seconds").alias("keywords"),
        F.count_if(made & F.col("embedding").isNull()).alias("no_vector"),
        F.sum("embedding_seconds").alias("embedding"),
    )
    num = lambda c: F.coalesce(c, zero) if isinstance(c, str) else c
    row = lambda name, items, failed, seconds: F.struct(F.lit(name).alias("stage"), num(items).cast("bigint").alias("items"), num(failed).cast("bigint").alias("failed"), num(seconds).cast("double").alias("seconds"))
    stages = [row("parsing", F.lit(1), F.when(F.col("text").isNull(), 1).otherwise(0), zero), row("chunking", "all", zero, zero)]
    stages += [row("keywords", "n", "no_keywords", "keywords")] if steps.keywords is not None else []
    stages += [row("embedding", "n", "no_vector", "embedding")]
    return plan.select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", F.inline(F.array(*stages)))


@contextmanager
def _timed(times: dict[str, float], name: str) -> Iterator[None]:
    began = time.perf_counter()
    yield
    times[name] = round(time.perf_counter() - began, 3)


def _counts(rows: DataFrame, by: str) -> dict[str, int]:
    return {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}


def ingest(store: TableStore, docs: DataFrame, steps: Steps | None = None) -> Library:
    """Commits a batch (doc_id, source, text, perhaps modified) to a library and returns the version that has it.

    Unchanged documents are skipped, slightly changed ones keep equal chunks, others are indexed anew.  A document of which a
    chunk has no vector becomes corrupted and counts an error, but keeps what could be stored.  Nothing of other documents
    changes.  Several rows of an id: see ``fingerprinted``; rows without id are counted in the report and otherwise left out.
    Raises ``Conflict`` if another batch was committed meanwhile; nothing of this one is seen then.
    """
    tx = store.begin()
    try:
        ingest_into(tx, docs, steps or Steps())
    except Exception:
        tx.abandon()
        raise
    return Library(tx.commit())


def ingest_into(tx: Transaction, docs: DataFrame, steps: Steps, out: DataFrame | None = None) -> None:
    """The changes that a batch makes, in a transaction that the caller commits; documents ``out`` (doc_id) are removed with it."""
    store, before, times = tx.base.store, Library(tx.base), {}
    names, plan_folder = [c.split()[0] for c in NODES.split(", ")], f"data/work/{tx.version:08d}-{uuid.uuid4().hex}"
    with _timed(times, "planning"):
        tx.written.append(plan_folder)
        _read(planned(before.registry, docs), steps).write.option("compression", "zstd").parquet(f"{store.path}/{plan_folder}")
        plan = store.spark.read.parquet(f"{store.path}/{plan_folder}")
        todo = plan.where("strategy <> 'skip'")
        known = plan.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if(F.col("change_type") != "new_document").alias("old"), F.sum(F.octet_length("text")).alias("bytes")).collect()
        strategies, size = {r["strategy"]: r["n"] for r in known}, sum(r["bytes"] or 0 for r in known)
        replaced = any(r["old"] for r in known if r["strategy"] != "skip") or out is not None
        rejected = docs.where("doc_id is null").count()
    with _timed(times, "models"):
        segment = tx.append("nodes", _made(chunk_actions(before.nodes, todo, steps.width), steps), "node_id")
        nodes = Snapshot(store, tx.version, tx.tables).read("nodes", [segment]).select(*names)
        gone = nodes.where("held is not null and action <> 'keep'").select("node_id")
        if out is not None:
            gone = gone.unionByName(before.nodes.join(out.select("doc_id").distinct(), "doc_id", "left_semi").select("node_id")).distinct()
        if replaced:
            tx.delete("nodes", gone)
    with _timed(times, "index"):
        if replaced:
            KeywordIndex.remove(tx, gone)
        fields = {"text": plain_tokens(clean_text(F.col("text"))), "keywords": plain_tokens(F.array_join("keywords", " "))}
        KeywordIndex.add(tx, nodes.where("action = 'embed'"), "node_id", fields if steps.keywords is not None else {"text": fields["text"]}, size)
    with _timed(times, "registry"):
        if replaced:
            tx.delete("registry", todo.select("doc_id") if out is None else todo.select("doc_id").unionByName(out.select("doc_id")))
        rows = tx.append("registry", _registry_rows(todo, nodes), "doc_id")
        tx.append("stages", _stage_rows(todo, nodes, steps))
        states = _counts(Snapshot(store, tx.version, tx.tables).read("registry", [rows]), "state")
    report = {"version": tx.version, "documents": strategies, "without_id": rejected, "states": states, "chunks": _counts(nodes, "action"), "seconds": times}
    tx.append("runs", store.spark.createDataFrame([(tx.version, json.dumps(report, sort_keys=True))], RUNS))
    store.files.delete(f"{store.path}/{plan_folder}")  # the tables hold all that came of it
    tx.written.remove(plan_folder)


def remove(store: TableStore, gone: DataFrame) -> Library:
    """The library without some documents (doc_id), in one commit."""
    tx = store.begin()
    try:
        nodes = Library(tx.base).nodes.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("node_id")
        KeywordIndex.remove(tx, nodes)
        tx.delete("nodes", nodes)
        tx.delete("registry", gone.select("doc_id"))
    except Exception:
        tx.abandon()
        raise
    return Library(tx.commit())


def tidied(store: TableStore, most: int = 8, keep: int = 2) -> Library:
    """The library after small segments were merged and all but the newest versions deleted."""
    tx = store.begin()
    if KeywordIndex.merge(tx, most=most):
        tx.commit()
    for name in ("registry", "nodes"):
        store.compact(name, most)
    store.expire(keep)
    return Library(store.snapshot())


def maintained(registry: DataFrame, entries: DataFrame, least: float = 90.0) -> DataFrame:
    """The registry after maintenance: only if less than ``least`` percent of the documents agree with their entries do
    those that don't become stale."""
    found = lifecycle.index_consistency(registry, entries).select("doc_id", "consistent")
    score = found.agg((100.0 * F.count_if("consistent") / F.count("*")).alias("score"))
    rows = registry.join(found, "doc_id").crossJoin(F.broadcast(score))  # one row
    return rows.withColumn("state", F.when(~F.col("consistent") & (F.col("score") < least), "stale").otherwise(F.col("state"))).drop("consistent", "score")


def stage_averages(stages: DataFrame) -> DataFrame:
    """stage, documents, items, failed, mean seconds a document."""
    per = stages.groupBy("stage").agg(F.countDistinct("doc_id").alias("documents"), F.sum("items").alias("items"), F.sum("failed").alias("failed"), F.sum("seconds").alias("seconds"))
    return per.select("stage", "documents", "items", "failed", (F.col("seconds") / F.greatest(F.lit(1), F.col("documents"))).alias("mean_seconds"))


def dispatched(docs: DataFrame, cache: DataFrame, now: float, ttl: float, parser: PageParser = same_text) -> DataFrame:
    """doc_id, kind, route, parsed of documents (doc_id, source, text): cached results younger than ``ttl`` seconds are
    taken, Markdown is read as it is, PDFs go to the parser, anything else is an error."""
    live = cache.where(F.col("cached_at") > now - ttl).select("doc_id", F.col("parsed").alias("cached"))
    rows = docs.withColumn("kind", classify(F.col("source"))).join(live, "doc_id", "left")
    route = F.when(F.col("kind") == "unsupported", "error").when(F.col("cached").isNotNull(), "cache").when(F.col("kind") == "markdown", "read").otherwise("parse")
    text = F.when(route == "cache", F.col("cached")).when(route == "read", F.col("text")).when(route == "parse", parser(F.col("text")))
    return rows.select("doc_id", "kind", route.alias("route"), text.alias("parsed"))


def cache_put(cache: DataFrame, parsed: DataFrame, now: Column | float) -> DataFrame:
    """The cache (doc_id, parsed, cached_at) with freshly parsed rows (doc_id, parsed) in place of older ones."""
    fresh = parsed.where("parsed is not null").select("doc_id", "parsed", (now if isinstance(now, Column) else F.lit(now)).alias("cached_at"))
    return lifecycle.replace_rows(cache.select("doc_id", "parsed", "cached_at"), fresh)


def cache_clear(cache: DataFrame, now: float, older_than: float | None = None) -> DataFrame:
    """The cache without rows older than so many seconds, or without any."""
    return cache.where("false") if older_than is None else cache.where(F.col("cached_at") >= now - older_than)
