"""Ingest, incremental updates, maintenance, parsing with a cache, plug-ins, payloads and the job state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.operators import filters, ingest, jobs, lifecycle, plugins, retrieval
from docweave.plans.base import NOW, Tables, with_tables
from docweave.plans.catalog import query
from docweave.plans.retrieval_queries import _BM25, _VEC, QUERY
from docweave.sources.storage import scratch, stored_once
from docweave.sources.versions import TableStore

# ---- ingest


class _Failing(plugins.HashedEmbedder):
    """An embedder that fails for some texts, and with them for their whole batch, as remote ones do."""

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        if any(len(t) % 53 == 7 for t in texts):
            raise TimeoutError("no answer")
        return super().__call__(texts)


_STEPS = ingest.Steps(embedder=_Failing())


def _before(t: Tables) -> TableStore:
    """A store with a library that holds the older texts, committed once a session."""
    old = t.documents.select("doc_id", "source", t.old_text().alias("text")).where("text is not null")
    return TableStore(t.spark, stored_once(t.spark, "library", t.sf_dir, lambda path: ingest.ingest(TableStore(t.spark, path), old, _STEPS)))


_OLD = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, (length(text) // 2)::BIGINT) WHEN 2 THEN text || ' appendix of the older version' WHEN 3 THEN substring(text, 1, 500) || ' zz yy xx ' || substring(text, 900) END"
_WORDS = r"len(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')) > 0 AND length({0}) % 53 <> 7"
_CUT = "SELECT doc_id, i AS chunk_index, substring(t, (i * 1000 + 1)::BIGINT, 1000) AS c FROM (SELECT doc_id, t, unnest(range(0, ceil(length(t) / 1000.0)::BIGINT)) AS i FROM {0} WHERE t IS NOT NULL)"
_INGEST = f"""old AS (SELECT doc_id, {_OLD} AS t FROM documents), now AS (SELECT doc_id, text AS t FROM documents),
 oc AS ({_CUT.format('old')}), nc AS ({_CUT.format('now')}),
 kind AS (SELECT n.doc_id, CASE WHEN n.t IS NULL THEN 'complete_rewrite' WHEN o.t IS NULL THEN 'new_document' WHEN o.t = n.t THEN 'no_change' WHEN d > 0.9 THEN 'complete_rewrite' WHEN d > 0.7 THEN 'structure_change' WHEN d > 0.4 THEN 'major_update' ELSE 'minor_update' END AS k
  FROM now n JOIN old o USING (doc_id), LATERAL (SELECT abs(length(n.t) - length(o.t)) / greatest(length(o.t), 1) AS d)),
 plan AS (SELECT doc_id, k, CASE k WHEN 'no_change' THEN 'skip' WHEN 'minor_update' THEN 'incremental' ELSE 'full_reindex' END AS strategy FROM kind),
 act AS (SELECT doc_id, strategy, chunk_index, n.c AS c, CASE WHEN n.c IS NULL THEN 'drop' WHEN strategy = 'incremental' AND o.c = n.c AND ({_WORDS.format('o.c')}) THEN 'keep' ELSE 'embed' END AS action
  FROM (SELECT * FROM nc FULL OUTER JOIN (SELECT doc_id, chunk_index, c AS oc FROM oc) o USING (doc_id, chunk_index)) x JOIN plan USING (doc_id), LATERAL (SELECT x.oc AS c) o, LATERAL (SELECT x.c AS c) n WHERE strategy <> 'skip')"""


@query(f"WITH {_INGEST} SELECT doc_id, strategy, chunk_index, action FROM act")
def incremental_update(t: Tables) -> DataFrame:
    """What an update does to each chunk: equal ones in both indexes stay, others are embedded, vanished ones go."""
    held = ingest.Library(_before(t).snapshot(1))
    plan = ingest.planned(held.registry, t.documents.select("doc_id", "source", "text")).where("strategy <> 'skip'")
    return ingest.chunk_actions(held.nodes, plan).select("doc_id", "strategy", "chunk_index", "action")


@query(f"""WITH {_INGEST}, made AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (action = 'keep' OR ({_WORDS.format('c')})) AS vectors FROM act WHERE action <> 'drop' GROUP BY doc_id),
 was AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER ({_WORDS.format('c')}) AS vectors FROM oc GROUP BY doc_id)
 SELECT p.doc_id, coalesce(f.chunks, 0) AS keyword_entries, coalesce(f.vectors, 0) AS vector_entries, CASE WHEN coalesce(f.chunks, 0) = coalesce(f.vectors, 0) THEN 'indexed' ELSE 'corrupted' END AS state,
  (CASE WHEN o.t IS NOT NULL AND coalesce(w.chunks, 0) <> coalesce(w.vectors, 0) THEN 1 ELSE 0 END + CASE WHEN strategy <> 'skip' AND coalesce(f.chunks, 0) <> coalesce(f.vectors, 0) THEN 1 ELSE 0 END)::BIGINT AS error_count
  FROM plan p JOIN old o USING (doc_id) LEFT JOIN was w USING (doc_id) LEFT JOIN made m USING (doc_id), LATERAL (SELECT CASE WHEN strategy = 'skip' THEN w.chunks ELSE m.chunks END AS chunks, CASE WHEN strategy = 'skip' THEN w.vectors ELSE m.vectors END AS vectors) f""")
def ingest_commit(t: Tables) -> DataFrame:
    """Two commits, read back from disk: a second version of every document came in after the first; entries of both indexes,
    state and errors."""
    old = t.documents.select("doc_id", "source", t.old_text().alias("text")).where("text is not null")
    store = TableStore(t.spark, scratch(t.spark, "library"))
    ingest.ingest(store, old, _STEPS)
    after = ingest.ingest(TableStore(t.spark, store.path), t.documents.select("doc_id", "source", "text"), _STEPS)
    per = after.entries.groupBy("doc_id").agg(F.count_if(F.col("index_type") == "keyword").alias("keyword_entries"), F.count_if(F.col("index_type") == "vector").alias("vector_entries"))
    rows = after.registry.join(per, "doc_id", "left").na.fill(0, ["keyword_entries", "vector_entries"])
    return rows.select("doc_id", "keyword_entries", "vector_entries", "state", "error_count")


@query(f"WITH {_INGEST} SELECT strategy, count(*) AS n, sum(CASE strategy WHEN 'skip' THEN 0 ELSE coalesce(length(t), 0) END)::BIGINT AS chars FROM plan JOIN now USING (doc_id) GROUP BY strategy")
def ingest_plan(t: Tables) -> DataFrame:
    plan = ingest.planned(ingest.Library(_before(t).snapshot(1)).registry, t.documents.select("doc_id", "source", "text"))
    return plan.groupBy("strategy").agg(F.count("*").alias("n"), F.sum(F.when(F.col("strategy") == "skip", 0).otherwise(F.coalesce("size", F.lit(0)))).alias("chars"))


_HELD = "(SELECT doc_id, count(*) FILTER (index_type = 'vector') AS v, count(*) FILTER (index_type = 'keyword') AS k FROM entries GROUP BY doc_id)"


@query(with_tables(f"SELECT doc_id, CASE WHEN (SELECT 100.0 * count(*) FILTER (ok) / count(*) FROM c) < 90 AND NOT ok THEN 'stale' ELSE state END AS state FROM c", "registry", "entries").replace("\nSELECT", f",\n c AS (SELECT doc_id, state, CASE WHEN vector_indexed THEN chunk_count ELSE 0 END = coalesce(v, 0) AND CASE WHEN keyword_indexed THEN chunk_count ELSE 0 END = coalesce(k, 0) AS ok FROM registry LEFT JOIN {_HELD} USING (doc_id))\nSELECT", 1))
def maintenance(t: Tables) -> DataFrame:
    """Documents that disagree with their entries become stale, as less than nine in ten agree."""
    return ingest.maintained(t.registry, t.entries).select("doc_id", "state")


@query(with_tables("SELECT doc_id, state FROM registry", "registry"))
def maintenance_above_threshold(t: Tables) -> DataFrame:
    """Where more documents agree with their entries than maintenance asks for, nothing changes."""
    return ingest.maintained(t.registry, t.entries, least=1.0).select("doc_id", "state")


_HELD_OLD = f"WITH {_INGEST}, made AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({_WORDS.format('c')}) AS fine FROM oc GROUP BY doc_id)"


@query(f"{_HELD_OLD} SELECT doc_id, coalesce(n, 0) AS nodes, coalesce(fine, 0) AS vector_nodes, coalesce(n, 0) AS keyword_nodes, coalesce(n, 0) AS chunk_count FROM old LEFT JOIN made USING (doc_id) WHERE t IS NOT NULL")
def index_build(t: Tables) -> DataFrame:
    """What a commit wrote for each document, from the tables on disk: chunks, vectors, keyword nodes in the index, chunk count."""
    library = ingest.Library(_before(t).snapshot(1))
    per = library.nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count("embedding").alias("vector_nodes"))
    indexed = library.index.nodes().groupBy(F.substring_index("key", "_", 1).cast("bigint").alias("doc_id")).agg(F.count("*").alias("keyword_nodes"))
    rows = library.registry.select("doc_id", "chunk_count").join(per, "doc_id", "left").join(indexed, "doc_id", "left")
    return rows.na.fill(0).select("doc_id", "nodes", "vector_nodes", "keyword_nodes", "chunk_count")


@query(f"{_HELD_OLD}, d AS (SELECT count(*) AS docs, sum(coalesce(n, 0))::BIGINT AS chunks, sum(coalesce(n - fine, 0))::BIGINT AS bad FROM old LEFT JOIN made USING (doc_id) WHERE t IS NOT NULL) SELECT 'parsing' AS stage, docs AS documents, docs AS items, 0::BIGINT AS failed, true AS timed FROM d UNION ALL SELECT 'chunking', docs, chunks, 0, true FROM d UNION ALL SELECT 'embedding', docs, chunks, bad, true FROM d")
def stage_averages(t: Tables) -> DataFrame:
    """What a commit's stages did, from the table of stages that it wrote; seconds differ from run to run."""
    rows = ingest.stage_averages(ingest.Library(_before(t).snapshot(1)).stages)
    return rows.select("stage", "documents", "items", "failed", (F.col("mean_seconds") >= 0).alias("timed"))


@query(f"{_HELD_OLD}, d AS (SELECT coalesce(n, 0) AS n, coalesce(n - fine, 0) AS bad FROM old LEFT JOIN made USING (doc_id) WHERE t IS NOT NULL) SELECT 1::BIGINT AS version, count(*) AS full_reindex, 0::BIGINT AS without_id, count(*) FILTER (bad = 0) AS indexed, count(*) FILTER (bad > 0) AS corrupted, sum(n)::BIGINT AS embedded, true AS timed FROM d")
def run_report(t: Tables) -> DataFrame:
    """The report that a commit left of its run, read back: what was done, what became of it, and how long its steps took."""
    number = lambda path: F.coalesce(F.get_json_object("report", path).cast("bigint"), F.lit(0))
    rows = ingest.Library(_before(t).snapshot(1)).runs
    timed = F.forall(F.map_values(F.from_json(F.get_json_object("report", "$.seconds"), "map<string,double>")), lambda x: x >= 0)
    return rows.select("version", number("$.documents.full_reindex").alias("full_reindex"), number("$.without_id").alias("without_id"), number("$.states.indexed").alias("indexed"), number("$.states.corrupted").alias("corrupted"), number("$.chunks.embed").alias("embedded"), timed.alias("timed"))


_TEXT = r"CASE WHEN regexp_matches(text, '\S') THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE concat('Metadata: {''pairs'': [(''M', doc_id, ''', ''p'')]}', chr(10), text) END"


@query(rf"""WITH r AS (SELECT doc_id, {_TEXT} AS t FROM documents), c AS ({_CUT.format('r')}),
 n AS (SELECT doc_id, len(regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]+')) > 0 AS whole, least(5, len(list_distinct(list_filter(regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 5)))) AS keywords FROM c)
 SELECT doc_id, CASE WHEN bool_and(whole) THEN 'indexed' ELSE 'corrupted' END AS state, 1::BIGINT AS pairs, 'M' || doc_id AS model, count(*) AS chunk_count, sum(keywords)::BIGINT AS keywords FROM n GROUP BY doc_id""")
def ingest_loop(t: Tables) -> DataFrame:
    """Every document through the whole loop in one commit: read by its kind, pairs taken out, chunks enhanced and embedded."""
    docs = t.registry.select("doc_id", "source", F.concat(F.lit("Metadata: {'pairs': [('M"), "doc_id", F.lit("', 'p')]}\n"), "text").alias("text"))
    steps = ingest.Steps(parser=plugins.same_text, pairs=True, keywords=plugins.CommonWords())
    library = ingest.ingest(TableStore(t.spark, scratch(t.spark, "loop")), docs, steps)
    per = library.nodes.groupBy("doc_id").agg(F.sum(F.size("keywords")).alias("keywords"))
    rows = library.registry.join(per, "doc_id", "left")
    return rows.select("doc_id", "state", F.size("pairs").cast("bigint").alias("pairs"), F.get("pairs", F.lit(0))["model"].alias("model"), "chunk_count", "keywords")


# ---- parsing with a cache


def _cache(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 3 = 0").selectExpr("doc_id", "concat('cached ', substring(text, 1, 40)) as parsed", f"{NOW}D - (doc_id % 5) * 40000 as cached_at")


_KIND = "regexp_extract(source, '\\.([a-z]+)$', 1)"


@query(with_tables(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND (doc_id % 5) * 40000 < 86400 THEN 'cache' WHEN {_KIND} IN ('md', 'txt') THEN 'read' ELSE 'parse' END AS route, CASE WHEN doc_id % 3 = 0 AND (doc_id % 5) * 40000 < 86400 THEN concat('cached ', substring(text, 1, 40)) ELSE text END AS parsed FROM registry", "registry"))
def parse_dispatch(t: Tables) -> DataFrame:
    return ingest.dispatched(t.registry.select("doc_id", "source", "text"), _cache(t), NOW, 86400).select("doc_id", "route", "parsed")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 30) ELSE concat('cached ', substring(text, 1, 40)) END AS parsed, CASE WHEN doc_id % 2 = 0 THEN {NOW}::DOUBLE ELSE {NOW}::DOUBLE - (doc_id % 5) * 40000 END AS cached_at FROM documents WHERE doc_id % 2 = 0 OR (doc_id % 3 = 0 AND (doc_id % 5) * 40000 <= 100000)")
def parse_cache_put(t: Tables) -> DataFrame:
    """The cache after half the documents were parsed again and rows older than 100,000 seconds were cleared."""
    fresh = t.documents.where("doc_id % 2 = 0").select("doc_id", F.expr("left(text, 30)").alias("parsed"))
    return ingest.cache_clear(ingest.cache_put(_cache(t), fresh, NOW), NOW, 100_000)


@query("SELECT doc_id, replace(base64(encode(text)), chr(10), '') AS coded, sha256(text) AS back FROM documents")
def base64_roundtrip(t: Tables) -> DataFrame:
    coded = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    return t.documents.select("doc_id", coded.alias("coded"), F.sha2(F.decode(F.unbase64(coded), "UTF-8"), 256).alias("back"))


@query(with_tables("SELECT state, '{\"state\":\"' || state || '\",\"documents\":' || count(*) || ',\"chunks\":' || sum(chunk_count)::BIGINT || ',\"errors\":' || sum(error_count)::BIGINT || '}' AS report FROM registry GROUP BY state", "registry"))
def report_json(t: Tables) -> DataFrame:
    """A run report, one JSON object a state."""
    rows = t.registry.groupBy("state").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"), F.sum("error_count").alias("errors"))
    return rows.select("state", F.to_json(F.struct("state", "documents", "chunks", "errors")).alias("report"))


@query()
def storage_inventory(t: Tables) -> DataFrame:
    """Files and bytes of the stored keyword index by component."""
    from docweave.sources.storage import inventory

    return inventory(t.spark, t.keyword_index.snapshot.store.path + "/data")


# ---- plug-ins, payloads, filters of vector tables


@query(with_tables(r"SELECT node_id, list_sum(c)::BIGINT AS words, list_max(c)::BIGINT AS most FROM (SELECT node_id, list_transform(range(16), lambda i: len(list_filter(w, lambda x: ('0x' || substring(md5(x), 1, 1))::INT = i))) AS c FROM (SELECT node_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM chunks) WHERE len(w) > 0)", "chunks"))
def embed_nodes(t: Tables) -> DataFrame:
    """Chunks through the offline embedder: how many words its counts hold and the largest of them."""
    rows = plugins.embed(t.chunks, "node_id", "text")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("node_id", total.cast("bigint").alias("words"), F.array_max("embedding").cast("bigint").alias("most"))


_COMMON = r"""w AS (SELECT node_id, term, count(*) AS n FROM (SELECT node_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM chunks) WHERE length(term) >= 5 GROUP BY node_id, term),
 k AS (SELECT node_id, count(*) AS keywords, string_agg(term, ', ' ORDER BY place) AS line FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, term) AS place FROM w) WHERE place <= 5 GROUP BY node_id)"""


@query(with_tables("", "chunks").rstrip() + f", {_COMMON} SELECT node_id, coalesce(keywords, 0) AS keywords, md5(text || coalesce(chr(10) || chr(10) || 'Keywords: ' || line, '')) AS digest FROM chunks LEFT JOIN k USING (node_id)")
def keyword_blocks(t: Tables) -> DataFrame:
    """Chunks enhanced by the offline keyword model, ten a call: how many keywords each got, and its text with their block."""
    rows = plugins.with_keywords(t.chunks.select("node_id", "text"), "text")
    return rows.select("node_id", F.size("keywords").cast("bigint").alias("keywords"), F.md5("text").alias("digest"))


@query()
def origin_nodes(t: Tables) -> DataFrame:
    """Every document split at sentences and enhanced: what a library's nodes start from."""
    return plugins.origin_nodes(t.documents, 128, 16).select("doc_id", "node_id", "chunk_index", "text", F.array_join("keywords", ", ").alias("keywords"))


@query(f"WITH {_INGEST} SELECT doc_id, count(*) AS points, count(*) AS fitting FROM oc WHERE len(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}_]+')) > 0 GROUP BY doc_id")
def vector_collection_rebuild(t: Tables) -> DataFrame:
    """A committed library's vectors made anew where they are missing; what still fails is left out, and dimensions are checked."""
    rows = plugins.rebuilt_vectors(ingest.Library(_before(t).snapshot(1)).nodes, "node_id", "text", 16)
    return rows.groupBy("doc_id").agg(F.count("*").alias("points"), F.count_if("fitting").alias("fitting"))


_TOP = f"WITH {_BM25}, hits AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20)"


def _hits(t: Tables) -> DataFrame:
    return retrieval.bm25_top(t.keyword_index, "doc_id", QUERY, 20)


@query(f"{_TOP} SELECT doc_id, rank, round(score, 6) AS score, source, lang, substring(text, 1, 120) AS preview FROM hits JOIN documents USING (doc_id)")
def search_payload(t: Tables) -> DataFrame:
    """Hits with what the library knows of them; the cut list is broadcast, as it holds twenty rows."""
    rows = t.documents.join(F.broadcast(_hits(t)), "doc_id")
    return rows.select("doc_id", "rank", F.round("score", 6).alias("score"), "source", "lang", F.substring("text", 1, 120).alias("preview"))


_OVER = "len(list_filter(['that', 'with', 'tion', 'heen'], lambda w: list_contains(regexp_split_to_array(lower(text), '\\s+'), w)))"


@query(f"{_TOP} SELECT doc_id, rank, {_OVER}::DOUBLE AS rerank_score, row_number() OVER (ORDER BY {_OVER} DESC, rank) AS new_rank FROM hits JOIN documents USING (doc_id)")
def rerank_hits(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text").join(F.broadcast(_hits(t)), "doc_id").select("doc_id", "rank", "text")
    return plugins.rerank(rows, QUERY, "text").drop("text")


@query(f"{_TOP} SELECT doc_id, rank, rank AS new_rank FROM hits")
def rerank_fallback(t: Tables) -> DataFrame:
    """Without a model the order stays."""
    return plugins.rerank(_hits(t).select("doc_id", "rank", F.lit("").alias("text")), QUERY, "text", None).select("doc_id", "rank", "new_rank")


@query(f"{_TOP}, w AS (SELECT doc_id, rank, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words FROM hits JOIN documents USING (doc_id)) SELECT * FROM (SELECT doc_id, rank, words, sum(words) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS held FROM w) WHERE held <= 3900")
def chat_context(t: Tables) -> DataFrame:
    """The best hits that fit a context of 3,900 words, in their order."""
    rows = t.documents.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint").alias("words")).join(F.broadcast(_hits(t).select("doc_id", "rank")), "doc_id")
    return rows.withColumn("held", F.sum("words").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).where("held <= 3900").select("doc_id", "rank", "words", "held")


_SPEC = {"doc_ids": list(range(0, 400, 2)), "source": {"contains": "src"}, "metadata": {"source_type": "en"}}


@query(f"WITH {_VEC} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v0 JOIN documents d ON d.doc_id = id WHERE id % 2 = 0 AND id < 400 AND contains(source, 'src') AND lang = 'en' ORDER BY score DESC, id LIMIT 10")
def vector_filter_spec(t: Tables) -> DataFrame:
    """A filter in the form that vector tables take, applied before the cut."""
    points = t.vectors.join(t.documents.select(F.col("doc_id").alias("id"), "doc_id", "source", F.col("lang").alias("source_type")), "id")
    scores = retrieval.vector_scores(points.where(filters.spec_predicate(filters.vector_spec(_SPEC))), "id", "embedding", t.query_vector)
    return retrieval.top(scores, "id", F.desc("score"), 10).withColumn("score", F.round("score", 6))


@query(with_tables("SELECT doc_id FROM registry WHERE contains(pair_model, 'PM1') AND contains(pair_part, '00') AND NOT (CASE WHEN doc_id % 4 = 0 THEN 0 ELSE size END <> 0 AND CASE WHEN doc_id % 4 = 0 THEN 0 ELSE size END > 2000) AND contains(text, 'th') AND contains(coalesce(keywords, ''), 'kw')", "registry"))
def post_vector_filters(t: Tables) -> DataFrame:
    """Conditions on hits: case counts, a size of 0 is not judged, keywords are a list."""
    rows = t.registry.withColumn("file_size", F.expr("case when doc_id % 4 = 0 then 0 else size end")).withColumn("keywords", F.split("keywords", " "))
    spec = {"pairs": {"model_contains": "PM1", "part_contains": "00"}, "metadata": {"file_size": {"max": 2000}}, "content": {"text_contains": "th", "keywords_contain": "kw"}}
    return rows.where(filters.after_vectors(spec)).select("doc_id")


# ---- jobs


@query(with_tables(f"SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'pending' WHEN job_id % 5 = 0 AND status IN ('pending', 'processing') THEN 'cancelled' ELSE status END AS status, CASE WHEN job_id % 3 = 0 THEN 0 ELSE retry_count END AS retry_count, CASE WHEN job_id % 3 = 0 THEN NULL ELSE worker_id END AS worker_id, CASE WHEN job_id % 3 <> 0 AND job_id % 5 = 0 AND status IN ('pending', 'processing') THEN {NOW}::DOUBLE ELSE completed_at END AS completed_at FROM jobs", "jobs"))
def job_requeue_cancel(t: Tables) -> DataFrame:
    """Every fifth job is cancelled where it can be, then every third is queued again with its retries reset."""
    ids = lambda n: t.jobs.where(F.col("job_id") % n == 0).select("job_id")
    some = jobs.cancel(t.jobs, t.jobs.where("job_id % 5 = 0 and job_id % 3 <> 0").select("job_id"), NOW)
    return jobs.requeue(some, ids(3), NOW, reset_retries=True).select("job_id", "status", "retry_count", "worker_id", "completed_at")


_STEP = "CASE " + " ".join(f"WHEN a.s = '{was}' AND x = '{does}' THEN '{then}'" for (was, does), then in jobs.TRANSITIONS.items()) + " END"
_ACTION = "case event_type when 'click' then 'start' when 'view' then 'start' when 'purchase' then 'complete' when 'error' then 'fail' else (case when event_id % 2 = 0 then 'requeue' else 'cancel' end) end"


@query(f"""WITH RECURSIVE o AS (SELECT user_id AS job_id, {_ACTION} AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 a AS (SELECT DISTINCT job_id, 0::BIGINT AS i, 'pending' AS s, 0::BIGINT AS m FROM o UNION ALL SELECT o.job_id, o.i, coalesce({_STEP}, a.s), a.m + CASE WHEN {_STEP} IS NULL THEN 0 ELSE 1 END FROM a JOIN o ON o.job_id = a.job_id AND o.i = a.i + 1)
 SELECT job_id, arg_max(s, i) AS status, max(m) AS moves FROM a GROUP BY job_id""")
def job_machine(t: Tables) -> DataFrame:
    """Jobs (one a user) after all that happened to them, by the table of transitions."""
    actions = t.raw("events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action"))
    return jobs.run_machine(actions)


_TURN = "row_number() OVER (ORDER BY doc_id % 3 + 1, doc_id)"


@query(f"""WITH j AS (SELECT doc_id, doc_id % 10 = 9 AS gone, {_TURN} AS turn, count(*) OVER () AS n, ceil(length(text) / 1000.0)::BIGINT AS chunks FROM documents),
 b AS (SELECT doc_id FROM ({_CUT.format('(SELECT doc_id, text AS t FROM documents)')}) WHERE NOT ({_WORDS.format('c')}) GROUP BY doc_id)
 SELECT doc_id AS job_id, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN turn > n // 4 AND turn <= 2 * (n // 4) AND NOT bad THEN 'b' ELSE 'c' END AS worker_id, (CASE WHEN turn <= n // 4 OR bad THEN 1 ELSE 0 END)::BIGINT AS retry_count, CASE WHEN gone THEN 0 ELSE chunks END AS chunks
 FROM (SELECT j.*, NOT gone AND b.doc_id IS NOT NULL AS bad FROM j LEFT JOIN b USING (doc_id))""")
def queue_with_a_dead_worker(t: Tables) -> DataFrame:
    """A job a document: worker a claims a quarter and dies, b does the next quarter, c takes over what a left, when its lease
    has ended, and all the rest.  Every job ends once, and the library holds what the jobs brought."""
    from docweave.operators.job_queue import JobQueue

    queue = JobQueue(TableStore(t.spark, scratch(t.spark, "queue")))
    docs = t.documents.select("doc_id", "source", "text")
    jobs_ = docs.select(F.col("doc_id").alias("job_id"), "doc_id", F.when(F.col("doc_id") % 10 == 9, "remove").otherwise("add").alias("job_type"), (F.col("doc_id") % 3 + 1).alias("priority"))
    queue.add(jobs_, 0.0, max_retries=1)
    n = docs.count()
    queue.claim("a", 10.0, n // 4)
    queue.claim("b", 20.0, n // 4)
    queue.work("b", docs, 30.0, _STEPS)
    queue.run("c", docs, 400.0, n, _STEPS)
    after = ingest.Library(queue.store.snapshot())
    chunks = after.nodes.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    ended = queue.jobs().join(chunks, "doc_id", "left").na.fill(0, ["chunks"])
    return ended.select("job_id", "status", "worker_id", "retry_count", "chunks")
