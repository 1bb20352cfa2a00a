"""Registry, index, fingerprint and job queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import filters, jobs, lifecycle
from docweave.plans.base import NOW, Tables, with_tables
from docweave.plans.catalog import ORACLES, query

# ---- lookups, pages, filters


@query(with_tables("SELECT doc_id, source, state, size FROM registry WHERE doc_id = 7", "registry"))
def doc_lookup(t: Tables) -> DataFrame:
    return t.registry.where("doc_id = 7").select("doc_id", "source", "state", "size")


@query(with_tables("SELECT doc_id, state, updated_at FROM registry WHERE state = 'stale' ORDER BY updated_at DESC, doc_id LIMIT 20 OFFSET 10", "registry"))
def list_documents_page(t: Tables) -> DataFrame:
    return jobs.page(t.registry.where("state = 'stale'"), [F.desc("updated_at"), F.col("doc_id")], 20, 10).select("doc_id", "state", "updated_at")


@query(with_tables("SELECT job_id, priority, created_at FROM jobs WHERE status = 'pending' ORDER BY priority, created_at, job_id LIMIT 50 OFFSET 20", "jobs"))
def list_jobs_page(t: Tables) -> DataFrame:
    return jobs.page(t.jobs.where("status = 'pending'"), [F.col("priority"), F.col("created_at"), F.col("job_id")], 50, 20).select("job_id", "priority", "created_at")


@query(with_tables("SELECT source, last_seen FROM fingerprints ORDER BY last_seen DESC, source LIMIT 25", "registry", "fingerprints"))
def recent_fingerprints(t: Tables) -> DataFrame:
    return jobs.page(t.fingerprints, [F.desc("last_seen"), F.col("source")], 25).select("source", "last_seen")


@query(with_tables("SELECT node_id, chunk_index, length(text) AS n FROM chunks WHERE doc_id = 3 ORDER BY chunk_index", "chunks"))
def document_chunks(t: Tables) -> DataFrame:
    return t.chunks.where("doc_id = 3").orderBy("chunk_index").select("node_id", "chunk_index", F.length("text").cast("bigint").alias("n"))


@query(with_tables("SELECT job_id, worker_id, updated_at FROM jobs WHERE status = 'processing' AND updated_at < 1706500000 - 300", "jobs"))
def stale_jobs(t: Tables) -> DataFrame:
    return jobs.stale(t.jobs, NOW).select("job_id", "worker_id", "updated_at")


@query(with_tables("SELECT job_id, priority, created_at, row_number() OVER (PARTITION BY source ORDER BY priority, created_at, job_id) AS place FROM jobs WHERE status = 'pending'", "jobs"))
def queue_order(t: Tables) -> DataFrame:
    """Order of pending jobs in the queue of each source."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("source").orderBy("priority", "created_at", "job_id")
    return t.jobs.where("status = 'pending'").select("job_id", "priority", "created_at", F.row_number().over(order).cast("bigint").alias("place"))


def _filtered(name: str, spec: dict, where: str) -> None:
    def run(t: Tables) -> DataFrame:
        return t.registry.where(filters.predicate(spec)).select("doc_id", "source")

    run.__name__ = name
    query(with_tables(f"SELECT doc_id, source FROM registry WHERE {where}", "registry"))(run)


_filtered("filter_doc_ids", {"doc_ids": [1, 5, 9, 77, 500]}, "doc_id IN (1, 5, 9, 77, 500)")
_filtered("filter_source_contains", {"source": {"contains": "SRC1", "not_contains": "-ds"}}, "contains(lower(source), 'src1') AND NOT contains(lower(source), '-ds')")
_filtered("filter_source_glob", {"source": {"pattern": "library/src?/*.PDF"}}, r"lower(source) SIMILAR TO 'library/src./.*\.pdf'")
_filtered("filter_json_eq", {"metadata": {"source_type": "fr", "parse_method": "text"}}, "json_extract_string(metadata, '$.source_type') = 'fr' AND json_extract_string(metadata, '$.parse_method') = 'text'")
_filtered("filter_size_range", {"metadata": {"file_size": {"min": 500, "max": 1500}}}, "size BETWEEN 500 AND 1500")
_filtered("filter_pairs_text", {"pairs": {"contains": "pm7k"}}, "contains(lower(pair_model), 'pm7k') OR contains(lower(pair_part), 'pm7k')")
_filtered("filter_text_contains", {"content": {"text_contains": "With", "keywords_contain": "KW"}}, "contains(lower(text), 'with') AND contains(lower(keywords), 'kw')")
_filtered("filter_dates", {"dates": {"created_after": 1690010000, "created_before": 1690040000, "modified_after": 1700500000}}, "created_at >= 1690010000 AND created_at <= 1690040000 AND modified_time >= 1700500000")
_filtered("filter_indexed", {"processing": {"indexed": False}}, "NOT (vector_indexed AND keyword_indexed)")
_filtered("filter_chunk_count", {"processing": {"chunk_count": {"min": 2, "max": 4}}}, "chunk_count BETWEEN 2 AND 4")
_filtered("filter_has_keywords", {"processing": {"has_keywords": True}}, "coalesce(keywords, '') <> ''")


@query(with_tables("SELECT doc_id FROM registry WHERE contains(pair_model, 'PM1') AND contains(pair_part, '00')", "registry"))
def filter_pairs_struct(t: Tables) -> DataFrame:
    return t.registry.where(filters.pair_predicate("PM1", "00")).select("doc_id")


@query(with_tables("SELECT doc_id FROM registry WHERE coalesce(json_extract_string(metadata, '$.source_type'), '') = 'en' AND coalesce(json_extract_string(metadata, '$.absent'), '') = ''", "registry"))
def filter_metadata_kv(t: Tables) -> DataFrame:
    return t.registry.where(filters.metadata_predicate({"source_type": "en", "absent": ""})).select("doc_id")


@query(with_tables("SELECT DISTINCT doc_id, source FROM registry WHERE contains(lower(pair_part), '00012')", "registry"))
def search_by_part_number(t: Tables) -> DataFrame:
    return t.registry.where(filters.predicate({"pairs": {"part_contains": "00012"}})).select("doc_id", "source").distinct()


@query("SELECT page_id, CASE WHEN (starts_with(url, 'http://') OR starts_with(url, 'https://')) THEN CASE WHEN length(url) > 40 THEN 'url_too_long' END WHEN NOT regexp_matches(lower(url), '\\.(pdf|txt|md)$') THEN 'bad_extension' END AS problem FROM pages")
def validate_inputs(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", filters.input_problem(F.col("url"), F.lit(0), longest_url=40).alias("problem"))


# ---- upserts and deletes


@query(with_tables("""SELECT source, coalesce(r.doc_id, i.doc_id) AS doc_id, coalesce(i.content_hash, r.content_hash) AS content_hash, coalesce(i.size, r.size) AS size,
  CASE WHEN r.source IS NULL THEN 'new' WHEN i.content_hash <> r.content_hash THEN 'stale' ELSE r.state END AS state
  FROM (SELECT * FROM registry WHERE doc_id % 6 <> 0) r FULL OUTER JOIN
  (SELECT source, doc_id, CASE WHEN doc_id % 5 < 3 THEN content_hash ELSE sha256(text || 'x') END AS content_hash, size + 1 AS size FROM registry WHERE doc_id % 4 = 0) i USING (source)""", "registry"))
def registry_upsert(t: Tables) -> DataFrame:
    new = t.registry.where("doc_id % 4 = 0").selectExpr("source", "doc_id", "case when doc_id % 5 < 3 then content_hash else sha2(concat(text, 'x'), 256) end as content_hash", "size + 1 as size", "modified_time", "cast(null as string) as metadata")
    return lifecycle.upsert_documents(t.registry.where("doc_id % 6 <> 0"), new).select("source", "doc_id", "content_hash", "size", "state")


@query(with_tables("SELECT DISTINCT ON (source) source, size, last_seen FROM (SELECT source, size, last_seen FROM fingerprints UNION ALL SELECT source, size + 5, last_seen + 1000 FROM fingerprints WHERE doc_id % 3 = 0) ORDER BY source, last_seen DESC", "registry", "fingerprints"))
def latest_wins_upsert(t: Tables) -> DataFrame:
    old = t.fingerprints.select("source", "size", "last_seen")
    new = t.fingerprints.where("doc_id % 3 = 0").selectExpr("source", "size + 5 as size", "last_seen + 1000 as last_seen")
    return lifecycle.latest_wins(old, new, ["source"], "last_seen")


@query(with_tables("SELECT doc_id, index_type, chunk_index, CASE WHEN doc_id % 8 = 1 THEN 2 ELSE 1 END::BIGINT AS version FROM entries", "entries"))
def index_entry_upsert(t: Tables) -> DataFrame:
    old = t.entries.select("doc_id", "index_type", "chunk_index", F.lit(1).cast("bigint").alias("version"))
    new = old.where("doc_id % 8 = 1").withColumn("version", F.lit(2).cast("bigint"))
    return lifecycle.latest_wins(old, new, ["doc_id", "index_type", "chunk_index"], "version")


@query(with_tables("""SELECT doc_id, CASE WHEN quality = 0 THEN 'corrupted' WHEN quality = 1 THEN 'indexed' ELSE state END AS state,
  error_count + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS error_count, CASE WHEN quality = 0 THEN 'low quality' ELSE last_error END AS last_error
  FROM registry LEFT JOIN labels USING (doc_id)""", "registry"))
def document_state_update(t: Tables) -> DataFrame:
    updates = t.raw("labels").selectExpr("doc_id", "case when quality = 0 then 'corrupted' else 'indexed' end as new_state", "case when quality = 0 then 'low quality' end as error")
    return lifecycle.update_states(t.registry, updates)


@query(with_tables("""SELECT doc_id, vector_indexed OR coalesce(kind IN ('vector', 'both'), false) AS vector_indexed, keyword_indexed OR coalesce(kind IN ('keyword', 'both'), false) AS keyword_indexed,
  coalesce(chunks, chunk_count) AS chunk_count, CASE WHEN kind IS NOT NULL THEN 'indexed' ELSE state END AS state
  FROM registry LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'vector' WHEN quality = 1 THEN 'both' ELSE 'keyword' END AS kind, doc_id % 4 AS chunks FROM labels) USING (doc_id)""", "registry"))
def mark_indexed(t: Tables) -> DataFrame:
    done = t.raw("labels").selectExpr("doc_id", "case when toxic = 1 then 'vector' when quality = 1 then 'both' else 'keyword' end as index_type", "doc_id % 4 as chunks")
    return lifecycle.mark_indexed(t.registry, done)


_FLAGGED = "(SELECT doc_id FROM labels WHERE toxic = 1)"


@query(with_tables(f"SELECT 'documents' AS tab, count(*) AS n FROM registry WHERE doc_id NOT IN {_FLAGGED} UNION ALL SELECT 'entries', count(*) FROM entries WHERE doc_id NOT IN {_FLAGGED}", "registry", "entries"))
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.raw("labels").where("toxic = 1").select("doc_id")
    count = lambda df, name: lifecycle.without(df.select("doc_id"), gone).agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
    return count(t.registry, "documents").unionByName(count(t.entries, "entries"))


@query(with_tables("SELECT doc_id, false AS vector_indexed, keyword_indexed, CASE WHEN NOT keyword_indexed THEN 'new' ELSE state END AS state FROM registry", "registry"))
def remove_index_type(t: Tables) -> DataFrame:
    return lifecycle.remove_index_type(t.registry, "vector")


@query(with_tables("SELECT doc_id, index_type, node_id FROM entries WHERE doc_id IN (SELECT doc_id FROM registry)", "registry", "entries"))
def orphan_cleanup(t: Tables) -> DataFrame:
    return t.entries.join(t.registry.select("doc_id"), "doc_id", "left_semi").select("doc_id", "index_type", "node_id")


@query(with_tables("SELECT source, last_seen FROM fingerprints WHERE last_seen >= 1706500000 - 75 * 86400", "registry", "fingerprints"))
def fingerprint_retention(t: Tables) -> DataFrame:
    return t.fingerprints.where(F.col("last_seen") >= NOW - 75 * 86400).select("source", "last_seen")


@query(with_tables("SELECT job_id, status FROM jobs WHERE NOT coalesce(status IN ('completed', 'failed', 'cancelled') AND completed_at < 1706500000 - 7 * 86400, false)", "jobs"))
def job_retention(t: Tables) -> DataFrame:
    return jobs.retention(t.jobs, NOW, 7).select("job_id", "status")


@query(with_tables("SELECT doc_id, count(*) AS n, max(v)::BIGINT AS version FROM (SELECT doc_id, 1 AS v FROM chunks WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 2 FROM chunks WHERE doc_id % 3 = 0) GROUP BY doc_id", "chunks"))
def index_replace(t: Tables) -> DataFrame:
    v = lambda n: F.lit(n).cast("bigint").alias("version")
    fresh = t.chunks.where("doc_id % 3 = 0").select("doc_id", "node_id", v(2))
    return lifecycle.replace_rows(t.chunks.select("doc_id", "node_id", v(1)), fresh).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("version").alias("version"))


@query(with_tables(f"SELECT index_type, count(*) AS n FROM entries WHERE doc_id NOT IN {_FLAGGED} GROUP BY index_type", "entries"))
def index_remove(t: Tables) -> DataFrame:
    return lifecycle.without(t.entries, t.raw("labels").where("toxic = 1")).groupBy("index_type").agg(F.count("*").alias("n"))


@query("SELECT id, min(pos) AS pos FROM (SELECT doc_id AS id, doc_id AS pos FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, doc_id + 5000000 FROM labels) GROUP BY id")
def insert_or_ignore(t: Tables) -> DataFrame:
    old = t.documents.where("doc_id % 3 <> 0").selectExpr("doc_id as id", "doc_id as pos")
    return lifecycle.insert_or_ignore(old, t.raw("labels").selectExpr("doc_id as id", "doc_id + 5000000 as pos"), "id", "pos")


@query(with_tables("SELECT r.doc_id, f.source IS NOT NULL AND f.last_seen > 1700000000 + 100000 AS hit FROM registry r LEFT JOIN fingerprints f ON r.content_hash = f.content_hash AND r.source = f.source", "registry", "fingerprints"))
def parse_cache_probe(t: Tables) -> DataFrame:
    return _cache_probe(t).select("doc_id", "hit")


def _cache_probe(t: Tables) -> DataFrame:
    """The cache is keyed by source and content; entries older than the time to live do not count."""
    cache = t.fingerprints.select("source", "content_hash", "last_seen")
    probe = t.registry.join(cache, ["source", "content_hash"], "left")
    return probe.withColumn("hit", F.coalesce(F.col("last_seen") > 1_700_100_000, F.lit(False)))


@query(with_tables("SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit) / greatest(1, count(*)) AS hit_rate FROM (SELECT f.source IS NOT NULL AND f.last_seen > 1700100000 AS hit FROM registry r LEFT JOIN fingerprints f ON r.content_hash = f.content_hash AND r.source = f.source)", "registry", "fingerprints"))
def cache_stats(t: Tables) -> DataFrame:
    return _cache_probe(t).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), (F.count_if("hit") / F.greatest(F.lit(1), F.count("*"))).alias("hit_rate"))


# ---- joins


@query(with_tables("SELECT doc_id, index_type, node_id FROM entries WHERE doc_id NOT IN (SELECT doc_id FROM registry)", "registry", "entries"))
def orphaned_entries(t: Tables) -> DataFrame:
    return lifecycle.orphaned_entries(t.entries, t.registry).select("doc_id", "index_type", "node_id")


_INCONSISTENT = """SELECT doc_id, state FROM registry r WHERE (vector_indexed AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.doc_id = r.doc_id AND index_type = 'vector'))
  OR (keyword_indexed AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.doc_id = r.doc_id AND index_type = 'keyword'))"""


@query(with_tables(_INCONSISTENT, "registry", "entries"))
def inconsistent_documents(t: Tables) -> DataFrame:
    return lifecycle.inconsistent_documents(t.registry, t.entries)


@query(with_tables("SELECT r.doc_id, f.source IS NULL OR f.content_hash <> r.content_hash AS changed FROM registry r LEFT JOIN fingerprints f USING (source)", "registry", "fingerprints"))
def fingerprint_changed(t: Tables) -> DataFrame:
    stored = t.fingerprints.select("source", F.col("content_hash").alias("stored"))
    return t.registry.join(stored, "source", "left").select("doc_id", (F.col("stored").isNull() | (F.col("stored") != F.col("content_hash"))).alias("changed"))


_CONSISTENCY = """SELECT r.doc_id, CASE WHEN vector_indexed THEN chunk_count ELSE 0 END AS vector_expected, coalesce(nv, 0) AS vector_found, CASE WHEN keyword_indexed THEN chunk_count ELSE 0 END AS keyword_expected, coalesce(nk, 0) AS keyword_found,
  CASE WHEN vector_indexed THEN chunk_count ELSE 0 END = coalesce(nv, 0) AND CASE WHEN keyword_indexed THEN chunk_count ELSE 0 END = coalesce(nk, 0) AS consistent
  FROM registry r LEFT JOIN (SELECT doc_id, count(*) FILTER (index_type = 'vector') AS nv, count(*) FILTER (index_type = 'keyword') AS nk FROM entries GROUP BY doc_id) USING (doc_id)"""


@query(with_tables(_CONSISTENCY, "registry", "entries"))
def index_consistency(t: Tables) -> DataFrame:
    return lifecycle.index_consistency(t.registry, t.entries)


@query(with_tables(f"SELECT doc_id, 'reindex' AS action FROM ({_CONSISTENCY}) WHERE NOT consistent UNION ALL SELECT DISTINCT doc_id, 'delete_entries' FROM entries WHERE doc_id NOT IN (SELECT doc_id FROM registry)", "registry", "entries"))
def repair_plan(t: Tables) -> DataFrame:
    """Orphans go, documents whose indexes disagree become stale and are indexed again."""
    stale = lifecycle.index_consistency(t.registry, t.entries).where("not consistent").select("doc_id", F.lit("reindex").alias("action"))
    gone = lifecycle.orphaned_entries(t.entries, t.registry).select("doc_id").distinct().select("doc_id", F.lit("delete_entries").alias("action"))
    return stale.unionByName(gone)


# ---- statistics


@query(with_tables("SELECT state, count(*) AS n, coalesce(avg(chunk_count), 0) AS avg_chunks FROM registry GROUP BY state", "registry"))
def registry_stats_by_state(t: Tables) -> DataFrame:
    return t.registry.groupBy("state").agg(F.count("*").alias("n"), F.coalesce(F.avg("chunk_count"), F.lit(0.0)).alias("avg_chunks"))


@query(with_tables("SELECT index_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM entries GROUP BY index_type", "entries"))
def index_stats_by_type(t: Tables) -> DataFrame:
    return t.entries.groupBy("index_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(with_tables("SELECT count(*) AS entries, count(DISTINCT doc_id) AS docs, count(DISTINCT node_id) AS nodes FROM entries", "entries"))
def index_stats(t: Tables) -> DataFrame:
    return t.entries.agg(F.count("*").alias("entries"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("node_id").alias("nodes"))


@query(with_tables("SELECT count(DISTINCT doc_id) AS docs, count(*) AS n, count(*) FILTER (coalesce(keywords, '') <> '') AS with_keywords FROM registry", "registry"))
def keyword_index_stats(t: Tables) -> DataFrame:
    return t.registry.agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"), F.count_if(F.coalesce("keywords", F.lit("")) != "").alias("with_keywords"))


@query(with_tables("SELECT status, count(*) AS jobs, round(avg(CASE WHEN started_at IS NOT NULL AND completed_at IS NOT NULL THEN completed_at - started_at END), 6) AS avg_seconds, sum(retry_count)::BIGINT AS retries FROM jobs GROUP BY status", "jobs"))
def job_stats(t: Tables) -> DataFrame:
    return jobs.stats_by_status(t.jobs).withColumn("avg_seconds", F.round("avg_seconds", 6))


@query(with_tables("SELECT min(created_at) AS first_created, max(created_at) AS last_created, count(*) AS n FROM jobs", "jobs"))
def job_time_bounds(t: Tables) -> DataFrame:
    return t.jobs.agg(F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"), F.count("*").alias("n"))


@query(with_tables("SELECT count(*) AS n, count(*) FILTER (processing_status = 'processed') AS processed, count(*) FILTER (processing_status = 'failed') AS failed, count(*) FILTER (processing_status = 'pending') AS pending, trunc(avg(size))::BIGINT AS avg_size, min(size) AS min_size, max(size) AS max_size FROM fingerprints", "registry", "fingerprints"))
def fingerprint_stats(t: Tables) -> DataFrame:
    one = lambda s: F.count_if(F.col("processing_status") == s).alias(s)
    return t.fingerprints.agg(F.count("*").alias("n"), one("processed"), one("failed"), one("pending"), F.avg("size").cast("bigint").alias("avg_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))


_ISSUES = f"(SELECT count(*) FROM ({_INCONSISTENT})) AS inconsistent, (SELECT count(*) FROM entries WHERE doc_id NOT IN (SELECT doc_id FROM registry)) AS orphaned"


@query(with_tables(f"SELECT inconsistent, orphaned, greatest(0, 100 - 10 * (inconsistent + orphaned))::BIGINT AS health FROM (SELECT {_ISSUES})", "registry", "entries"))
def registry_health(t: Tables) -> DataFrame:
    return _issues(t).withColumn("health", lifecycle.health(F.col("inconsistent") + F.col("orphaned"), 10).cast("bigint"))


def _issues(t: Tables) -> DataFrame:
    a = lifecycle.inconsistent_documents(t.registry, t.entries).agg(F.count("*").alias("inconsistent"))
    return a.crossJoin(lifecycle.orphaned_entries(t.entries, t.registry).agg(F.count("*").alias("orphaned")))


@query(with_tables(f"SELECT *, CASE WHEN score >= 90 THEN 'healthy' WHEN score >= 70 THEN 'degraded' ELSE 'unhealthy' END AS word FROM (SELECT inconsistent + orphaned + drift AS issues, greatest(0, 100 - 5 * (inconsistent + orphaned + drift))::BIGINT AS score FROM (SELECT {_ISSUES}, (SELECT count(*) FROM ({_CONSISTENCY}) WHERE NOT consistent) AS drift))", "registry", "entries"))
def overall_health(t: Tables) -> DataFrame:
    drift = lifecycle.index_consistency(t.registry, t.entries).agg(F.count_if(~F.col("consistent")).alias("drift"))
    out = _issues(t).crossJoin(drift).select((F.col("inconsistent") + F.col("orphaned") + F.col("drift")).alias("issues"))
    return out.withColumn("score", lifecycle.health(F.col("issues"), 5).cast("bigint")).withColumn("word", lifecycle.health_word(F.col("score")))


@query(with_tables("SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS submitted, round(avg(CASE WHEN status = 'completed' THEN completed_at - started_at END), 6) AS average_processing_time, round(count(*) FILTER (status = 'completed') / greatest(1, count(*)) * 100, 6) AS success_rate FROM jobs", "jobs"))
def queue_status(t: Tables) -> DataFrame:
    return jobs.queue_counters(t.jobs).withColumns({c: F.round(c, 6) for c in ("average_processing_time", "success_rate")})


@query(with_tables("SELECT p AS processed, n AS total, f AS failed, round(p / n * 100, 6) AS percentage, round(p / 3600 * 60, 6) AS rate_per_minute, round(3600 / p * (n - p), 6) AS eta_seconds FROM (SELECT count(*) FILTER (status = 'completed') AS p, count(*) AS n, count(*) FILTER (status = 'failed') AS f FROM jobs)", "jobs"))
def progress_snapshot(t: Tables) -> DataFrame:
    return jobs.progress(t.jobs, 3600.0).withColumns({c: F.round(c, 6) for c in ("percentage", "rate_per_minute", "eta_seconds")})


@query(with_tables("SELECT count(*) FILTER (state = 'indexed') AS success, count(*) FILTER (state = 'corrupted') AS error, count(*) FILTER (state NOT IN ('indexed', 'corrupted')) AS skipped FROM registry", "registry"))
def batch_outcomes(t: Tables) -> DataFrame:
    s = F.col("state")
    return t.registry.agg(F.count_if(s == "indexed").alias("success"), F.count_if(s == "corrupted").alias("error"), F.count_if(~s.isin("indexed", "corrupted")).alias("skipped"))


@query(with_tables("SELECT 'registry' AS section, state AS metric, count(*) AS value FROM registry GROUP BY state UNION ALL SELECT 'index', index_type, count(*) FROM entries GROUP BY index_type UNION ALL SELECT 'jobs', status, count(*) FROM jobs GROUP BY status UNION ALL SELECT 'fingerprints', processing_status, count(*) FROM fingerprints GROUP BY processing_status", "registry", "entries", "jobs", "fingerprints"))
def system_status(t: Tables) -> DataFrame:
    part = lambda df, section, c: df.groupBy(F.col(c).alias("metric")).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "metric", "value")
    return part(t.registry, "registry", "state").unionByName(part(t.entries, "index", "index_type")).unionByName(part(t.jobs, "jobs", "status")).unionByName(part(t.fingerprints, "fingerprints", "processing_status"))


@query(with_tables("SELECT count(DISTINCT source) AS files, count(DISTINCT source) FILTER (state = 'indexed') AS parsed, count(DISTINCT source) - count(DISTINCT source) FILTER (state = 'indexed') AS failed FROM registry", "registry"))
def parse_run_summary(t: Tables) -> DataFrame:
    done = F.countDistinct(F.when(F.col("state") == "indexed", F.col("source")))
    return t.registry.agg(F.countDistinct("source").alias("files"), done.alias("parsed"), (F.countDistinct("source") - done).alias("failed"))


@query(with_tables("SELECT job_id, CASE WHEN a THEN CASE WHEN r + 1 <= 3 THEN 'pending' ELSE 'failed' END ELSE status END AS status, r + CASE WHEN a THEN 1 ELSE 0 END AS retry_count FROM (SELECT job_id, status, retry_count AS r, status = 'failed' OR (status = 'processing' AND updated_at < 1706500000 - 300) AS a FROM jobs)", "jobs"))
def job_retry(t: Tables) -> DataFrame:
    return jobs.retry(t.jobs, NOW)


@query("""SELECT user_id AS job_id, max_by(s, event_id) AS status, min(CASE WHEN s = 'processing' THEN event_id END) AS first_started, count(*) AS changes
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS s FROM events) GROUP BY user_id""")
def job_state_fold(t: Tables) -> DataFrame:
    changes = t.jobs.join(t.raw("events").select(F.col("event_id").alias("job_id"), "user_id"), "job_id").select(F.col("user_id").alias("job_id"), F.col("job_id").alias("seq"), "status")
    return jobs.fold_states(changes)


_PARTS = {"registry": "registry_health", "health": "overall_health", "queue": "queue_status", "bounds": "job_time_bounds", "fingerprints": "fingerprint_stats", "keywords": "keyword_index_stats", "index": "index_stats", "outcomes": "batch_outcomes", "progress": "progress_snapshot"}


def _unpivoted(section: str, name: str) -> str:
    skip = ", ".join(c for c in ("word",) if section == "health")
    columns = f"COLUMNS(* EXCLUDE ({skip}))" if skip else "COLUMNS(*)"
    return f"SELECT '{section}' AS section, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT {columns}::DOUBLE FROM ({ORACLES[name]})) ON COLUMNS(*) INTO NAME metric VALUE value)"


@query(" UNION ALL ".join(_unpivoted(*p) for p in _PARTS.items()) + " UNION ALL SELECT 'states', state, n::DOUBLE FROM (" + ORACLES["registry_stats_by_state"] + ") UNION ALL SELECT 'jobs', status, round(avg_seconds, 6) FROM (" + ORACLES["job_stats"] + ") WHERE avg_seconds IS NOT NULL")
def comprehensive_status(t: Tables) -> DataFrame:
    """Health, rates, bounds and counts of every part of a library in one table: section, metric, value."""
    made = {"registry": registry_health, "health": overall_health, "queue": queue_status, "bounds": job_time_bounds, "fingerprints": fingerprint_stats, "keywords": keyword_index_stats, "index": index_stats, "outcomes": batch_outcomes, "progress": progress_snapshot}
    value = lambda c: F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value"))
    parts = [df.select(F.lit(s).alias("section"), F.inline(F.array(*[value(c) for c in df.columns if c != "word"]))) for s, df in ((s, f(t)) for s, f in made.items())]
    parts.append(registry_stats_by_state(t).select(F.lit("states").alias("section"), F.col("state").alias("metric"), F.col("n").cast("double").alias("value")))
    parts.append(job_stats(t).where("avg_seconds is not null").select(F.lit("jobs").alias("section"), F.col("status").alias("metric"), F.round("avg_seconds", 6).alias("value")))
    return reduce(DataFrame.unionByName, parts)
