"""Document lifecycle: upserts, index maintenance, fingerprints, change detection, consistency and repair.

Tables are immutable; each operator returns the next version of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import fixed_chunks, set_jaccard, word_set

#: Thresholds of change classes and of chunk similarity.
REWRITE, STRUCTURE, MAJOR = 0.90, 0.70, 0.40
UNCHANGED, MODIFIED = 0.80, 0.50
#: Seconds of effort by change class.
BASE_EFFORT = {"no_change": 0.1, "minor_update": 5.0, "major_update": 15.0, "structure_change": 25.0, "complete_rewrite": 30.0, "new_document": 30.0, "deleted": 2.0}


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Whole-row replacement: of each key the row of the newest version; of equal versions a new row, then the one of
    largest content."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"), F.desc(F.to_json(F.struct(*old.columns))))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def upsert_documents(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """By source: known documents take the new hash, size and time, and metadata if given, and become stale if the hash
    differs; unknown ones are added as new."""
    r, i = registry.alias("r"), incoming.alias("i")
    pick = lambda c: F.coalesce(F.col(f"i.{c}"), F.col(f"r.{c}")).alias(c)
    state = F.when(F.col("r.source").isNull(), "new").when(F.col("i.content_hash") != F.col("r.content_hash"), "stale").otherwise(F.col("r.state"))
    return r.join(i, F.col("r.source") == F.col("i.source"), "full_outer").select(F.coalesce("r.source", "i.source").alias("source"), F.coalesce("r.doc_id", "i.doc_id").alias("doc_id"), pick("content_hash"), pick("size"), pick("modified_time"), pick("metadata"), state.alias("state"))


def update_states(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: doc_id, new_state, error (null: none); an error is counted and kept."""
    joined = registry.join(updates, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("new_state", "state").alias("state"), (F.col("error_count") + F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("error_count"), F.coalesce("error", "last_error").alias("last_error"))


def mark_indexed(registry: DataFrame, indexed: DataFrame) -> DataFrame:
    """indexed: doc_id, index_type (vector, keyword, both), chunks."""
    j = registry.join(indexed, "doc_id", "left")
    flag = lambda kind, c: (F.col(c) | F.coalesce(F.col("index_type").isin(kind, "both"), F.lit(False))).alias(c)
    return j.select("doc_id", flag("vector", "vector_indexed"), flag("keyword", "keyword_indexed"), F.coalesce("chunks", "chunk_count").alias("chunk_count"), F.when(F.col("index_type").isNotNull(), "indexed").otherwise(F.col("state")).alias("state"))


def without(df: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def replace_rows(df: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Remove the keys of the fresh rows, then add these."""
    return without(df, fresh.select(key).distinct(), key).unionByName(fresh)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Of the new rows the first of each key that is not there yet."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def remove_index_type(registry: DataFrame, kind: str) -> DataFrame:
    """Clears the flags of one index, or of both; documents in no index become new."""
    v = F.col("vector_indexed") & F.lit(kind not in ("vector", "both"))
    k = F.col("keyword_indexed") & F.lit(kind not in ("keyword", "both"))
    return registry.select("doc_id", v.alias("vector_indexed"), k.alias("keyword_indexed"), F.when(~v & ~k, "new").otherwise(F.col("state")).alias("state"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def metadata_hash(name: Column, size: Column, modified: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", name, size.cast("string"), modified.cast("string"), content), 256)


def change_class(stored_hash: Column, current_hash: Column, stored_size: Column, current_size: Column) -> Column:
    """By the relative change of size, once the hashes differ; nothing stored is new, nothing current is deleted.

    The hashes are those of the metadata (name, size, time, content), so a touched file counts as changed.
    """
    delta = F.abs(current_size - stored_size) / F.greatest(stored_size, F.lit(1))
    by_size = F.when(delta > REWRITE, "complete_rewrite").when(delta > STRUCTURE, "structure_change").when(delta > MAJOR, "major_update").otherwise("minor_update")
    return F.when(current_hash.isNull(), "deleted").when(stored_hash.isNull(), "new_document").when(stored_hash == current_hash, "no_change").otherwise(by_size)


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, similarity, label): chunks side by side by position."""
    o, n = (x.select("doc_id", "chunk_index", F.col("text").alias(t)) for x, t in ((old, "old_text"), (new, "new_text")))
    j = o.join(n, ["doc_id", "chunk_index"], "full_outer")
    similarity = F.when(F.col("old_text").isNotNull() & F.col("new_text").isNotNull(), set_jaccard(word_set(F.col("old_text")), word_set(F.col("new_text"))))
    label = F.when(F.col("old_text").isNull(), "added").when(F.col("new_text").isNull(), "removed").when(F.col("similarity") >= UNCHANGED, "unchanged").when(F.col("similarity") >= MODIFIED, "modified").otherwise("replaced")
    return j.withColumn("similarity", similarity).withColumn("label", label).select("doc_id", "chunk_index", "similarity", "label")


def document_diff(old: DataFrame, new: DataFrame, width: int = 1000) -> DataFrame:
    """``chunk_diff`` of whole texts (doc_id, text): one join by document, chunks side by side inside it, and words are
    compared only where the chunks differ.  A null text has no chunks."""
    pieces = lambda df, name: df.where("text is not null").select("doc_id", fixed_chunks(F.col("text"), width).alias(name))
    none = F.array().cast("array<string>")
    joined = pieces(old, "old").join(pieces(new, "new"), "doc_id", "full_outer")
    rows = joined.select("doc_id", F.posexplode(F.arrays_zip(F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))).alias("chunk_index", "c"))
    both = F.col("c.old").isNotNull() & F.col("c.new").isNotNull()
    similarity = F.when(F.col("c.old") == F.col("c.new"), 1.0).when(both, set_jaccard(word_set(F.col("c.old")), word_set(F.col("c.new"))))
    label = F.when(F.col("c.old").isNull(), "added").when(F.col("c.new").isNull(), "removed").when(F.col("similarity") >= UNCHANGED, "unchanged").when(F.col("similarity") >= MODIFIED, "modified").otherwise("replaced")
    return rows.withColumn("similarity", similarity).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "similarity", label.alias("label"))


def refine(diff: DataFrame) -> DataFrame:
    """Per document: chunks, changed ones, their ratio, refined class and confidence."""
    per = diff.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.count_if(F.col("label") != "unchanged").alias("changed_chunks"))
    ratio = F.col("changed_chunks") / F.col("total_chunks")
    kind = F.when(ratio >= REWRITE, "complete_rewrite").when(ratio >= STRUCTURE, "structure_change").when(ratio >= MAJOR, "major_update").when(ratio > 0, "minor_update").otherwise("no_change")
    return per.withColumn("change_ratio", ratio).withColumn("change_type", kind).withColumn("confidence", F.least(F.lit(1.0), 0.7 + 0.3 * F.least(F.col("total_chunks") / 10, F.lit(1.0))))


def strategy(change: Column) -> Column:
    return F.when(change == "no_change", "skip").when(change == "minor_update", "incremental").when(change == "deleted", "remove").otherwise("full_reindex")


def priority(change: Column) -> Column:
    """1 urgent, 2 normal, 3 low."""
    return F.when(change.isin("major_update", "minor_update"), 2).when(change == "no_change", 3).otherwise(1)


def job_priority(p: Column) -> Column:
    return F.when(p == 1, "HIGH").when(p == 3, "LOW").otherwise("NORMAL")


def effort(change: Column, length: Column, affected: Column) -> Column:
    """Seconds, to two places: base x (1 + length share up to 3 + chunk share up to 2)."""
    base = F.lit(30.0)
    for kind, seconds in BASE_EFFORT.items():
        base = F.when(change == kind, seconds).otherwise(base)
    return F.round(base * (1 + F.least(length / 10000, F.lit(3.0)) + F.least(affected / 10, F.lit(2.0))), 2)


def within_budget(analyses: DataFrame, budget: float, key: str = "doc_id") -> DataFrame:
    """In order of priority and effort, the analyses up to the first that would pass the budget.

    The candidates are a bounded list (at most ``max_documents`` of the caller), so one ordered window is right here.
    """
    order = Window.orderBy("priority", "effort", key).rowsBetween(Window.unboundedPreceding, 0)
    return analyses.withColumn("used", F.sum("effort").over(order)).where(F.col("used") <= budget)


def orphaned_entries(entries: DataFrame, registry: DataFrame) -> DataFrame:
    return entries.join(registry.select("doc_id"), "doc_id", "left_anti")


def inconsistent_documents(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents flagged as indexed that have no entry of that kind."""
    kinds = entries.groupBy("doc_id").agg(F.count_if(F.col("index_type") == "vector").alias("nv"), F.count_if(F.col("index_type") == "keyword").alias("nk"))
    j = registry.join(kinds, "doc_id", "left").na.fill(0, ["nv", "nk"])
    return j.where("(vector_indexed and nv = 0) or (keyword_indexed and nk = 0)").select("doc_id", "state")


def index_consistency(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Per document: entries expected by chunk count and found, of each kind, and whether they agree."""
    kinds = entries.groupBy("doc_id").agg(F.count_if(F.col("index_type") == "vector").alias("vector_found"), F.count_if(F.col("index_type") == "keyword").alias("keyword_found"))
    j = registry.join(kinds, "doc_id", "left").na.fill(0, ["vector_found", "keyword_found"])
    want = lambda c: F.when(F.col(c), F.col("chunk_count")).otherwise(0)
    out = j.select("doc_id", want("vector_indexed").alias("vector_expected"), "vector_found", want("keyword_indexed").alias("keyword_expected"), "keyword_found")
    return out.withColumn("consistent", (F.col("vector_expected") == F.col("vector_found")) & (F.col("keyword_expected") == F.col("keyword_found")))


def health(issues: Column, weight: int) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - weight * issues)


def health_word(score: Column) -> Column:
    return F.when(score >= 90, "healthy").when(score >= 70, "degraded").otherwise("unhealthy")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per content: hash, smallest key, copies."""
    return docs.groupBy(content_hash(F.col(text)).alias("content_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def safe_analysis(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, change_type, strategy, confidence, effort of whole documents (doc_id, text); a document whose text cannot be
    read is rewritten as a whole, with confidence 0 and an effort of 60 seconds; one without a chunk on either side is unchanged."""
    diff = refine(document_diff(old, new.where("text is not null")))
    rows = new.join(diff, "doc_id", "left").na.fill({"change_type": "no_change", "changed_chunks": 0, "confidence": 0.7})
    c, lost = F.col("change_type"), F.col("text").isNull()
    cost = effort(c, F.length("text"), F.col("changed_chunks"))
    return rows.select("doc_id", F.when(lost, "complete_rewrite").otherwise(c).alias("change_type"), F.when(lost, "full_reindex").otherwise(strategy(c)).alias("strategy"), F.when(lost, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.when(lost, 60.0).otherwise(cost).alias("effort"))
