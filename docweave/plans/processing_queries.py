"""Sources, parsing, chunking, change detection and event-time queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as T
from docweave.operators import lifecycle, parsing
from docweave.plans.base import Tables, with_tables
from docweave.plans.catalog import query

# ---- sources and artefacts


@query("SELECT url, min(page_id) AS first_page FROM pages GROUP BY url")
def resolve_sources_dedup(t: Tables) -> DataFrame:
    return t.raw("pages").groupBy("url").agg(F.min("page_id").alias("first_page"))


@query("SELECT url AS path, CASE WHEN min(page_id) FILTER (page_id % 3 = 0) IS NULL THEN 1 ELSE 0 END::INT AS list, coalesce(min(page_id) FILTER (page_id % 3 = 0), min(page_id)) AS at FROM pages GROUP BY url")
def resolve_order(t: Tables) -> DataFrame:
    """Two lists one behind the other, each path once, where it came first."""
    from docweave.sources.files import resolved

    pages = t.raw("pages").select(F.col("url").alias("path"), F.col("page_id").alias("place"))
    return resolved([pages.where("place % 3 = 0"), pages])


@query("SELECT doc_id, text || '(' AS text, md5(text || '(x') AS digest FROM documents")
def decode_leniently(t: Tables) -> DataFrame:
    """Texts with bytes that are no UTF-8 before, behind and inside: these alone go."""
    from docweave.sources.files import decoded_leniently

    raw = F.concat(F.unhex(F.lit("FF80")), F.encode("text", "UTF-8"), F.unhex(F.lit("C328")))
    more = F.concat(raw, F.unhex(F.lit("E282")), F.encode(F.lit("x"), "UTF-8"))
    return t.documents.select("doc_id", decoded_leniently(raw).alias("text"), F.md5(decoded_leniently(more)).alias("digest"))


@query(with_tables("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substring(sha256('https://x/' || source), 1, 16) ELSE regexp_replace(split_part(source, '/', 3), '\\.[a-z]+$', '') || '_' || substring(content_hash, 1, 8) || '_' || substring(sha256(source), 1, 8) END AS identity FROM registry", "registry"))
def doc_identity(t: Tables) -> DataFrame:
    from docweave.sources.files import file_identity, url_identity

    url = url_identity(F.concat(F.lit("https://x/"), F.col("source")))
    return t.registry.select("doc_id", F.when(F.col("doc_id") % 3 == 0, url).otherwise(file_identity(F.col("source"), F.col("content_hash"))).alias("identity"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_sha256(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", lifecycle.content_hash(F.col("text")).alias("content_hash"))


@query(with_tables("SELECT doc_id, source, size AS markdown_length, 1::BIGINT AS pairs_count, pair_model AS model, pair_part AS part FROM registry", "registry"))
def artefact_projection(t: Tables) -> DataFrame:
    from docweave.sources.files import artefacts

    rows = artefacts(t.registry)
    return rows.select("doc_id", "source", "markdown_length", "pairs_count", F.col("pairs")[0]["model"].alias("model"), F.col("pairs")[0]["part"].alias("part"))


@query(with_tables("SELECT doc_id, source, length(text) AS n, pair_model AS model FROM registry", "registry"))
def artefact_roundtrip(t: Tables) -> DataFrame:
    """Artefacts as JSON lines and parsed back by their schema."""
    from docweave.sources.files import artefact_from_json, artefact_to_json, artefacts

    back = artefact_from_json(artefact_to_json(artefacts(t.registry, keep_text=True)))
    return back.select("doc_id", "source", F.length("markdown").cast("bigint").alias("n"), F.col("pairs")[0]["model"].alias("model"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'document' AS kind FROM documents UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'turn' FROM conversations) GROUP BY kind")
def merge_by_type(t: Tables) -> DataFrame:
    tag = lambda name, kind: t.raw(name).select(F.lit(kind).alias("kind"), *([F.col("text")] if name != "pages" else [F.col("html")]))
    rows = tag("documents", "document").unionByName(tag("pages", "page"), allowMissingColumns=True).unionByName(tag("conversations", "turn"), allowMissingColumns=True)
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


# ---- parsing


@query(with_tables("SELECT * FROM (WITH r AS (SELECT doc_id, lower(split_part(source, '/', 3)) AS name FROM registry), k AS (SELECT *, len(list_filter(['datasheet', 'ds.pdf', 'spec', 'specification', 'product_brief', 'technical_data', 'sensor', 'laser', 'manual', 'model', 'part_number'], lambda p: contains(name, p))) > 0 AS d, len(list_filter(['report', 'paper', 'article', 'research', 'white_paper', 'guide', 'tutorial', 'documentation', 'readme'], lambda p: contains(name, p))) > 0 AS g FROM r) SELECT doc_id, CASE WHEN regexp_matches(name, '\\.(md|markdown|txt)$') THEN 'markdown' WHEN NOT ends_with(name, '.pdf') THEN 'unsupported' WHEN d AND NOT g THEN 'datasheet_pdf' ELSE 'generic_pdf' END AS kind FROM k)", "registry"))
def classify_documents(t: Tables) -> DataFrame:
    return t.registry.select("doc_id", parsing.classify(F.col("source"), datasheet_mode=False).alias("kind"))


_NAMES = "CASE doc_id % 5 WHEN 0 THEN 'laser-sensor-' || doc_id || '.pdf' WHEN 1 THEN 'annual_report_' || doc_id || '.pdf' WHEN 2 THEN source || '-datasheet-spec.pdf' WHEN 3 THEN source || '.txt' ELSE source || '.docx' END"


@query(f"""WITH n AS (SELECT doc_id, lower({_NAMES}) AS name FROM documents), f AS (SELECT *, len(list_filter(['datasheet', 'ds.pdf', 'spec', 'specification', 'product_brief', 'technical_data', 'sensor', 'laser', 'manual', 'model', 'part_number'], lambda p: contains(name, p))) AS d, len(list_filter(['report', 'paper', 'article', 'research', 'white_paper', 'guide', 'tutorial', 'documentation', 'readme'], lambda p: contains(name, p))) AS g,
 len(list_filter(['datasheet', 'ds.pdf', 'spec', 'specification', 'product_brief', 'technical_data', 'sensor', 'laser'], lambda p: contains(name, p))) AS sd, len(list_filter(['report', 'paper', 'article', 'research', 'white_paper'], lambda p: contains(name, p))) AS sg FROM n)
 SELECT doc_id, round(CASE WHEN ends_with(name, '.txt') THEN 1.0 WHEN NOT ends_with(name, '.pdf') THEN 0.5 WHEN g > 0 AND d = 0 THEN least(0.9, 0.5 + sg * 0.2) ELSE least(0.9, 0.5 + sd * 0.2) END, 6)::DOUBLE AS confidence FROM f""")
def classification_confidence(t: Tables) -> DataFrame:
    """Names with two, one and no telling part, plain text, and a kind that nothing parses."""
    rows = t.documents.select("doc_id", F.expr(_NAMES).alias("source"))
    return rows.select("doc_id", F.round(parsing.confidence(F.col("source"), parsing.classify(F.col("source"))), 6).alias("confidence"))


@query("SELECT doc_id, (60 + (n_chars // 3000 + 1) * 30)::BIGINT AS timeout FROM documents")
def parse_timeouts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", parsing.parse_timeout(F.expr("n_chars div 3000 + 1")).alias("timeout"))




@query("SELECT doc_id, 1::BIGINT AS n, 'M' || doc_id AS model, (1000000 + doc_id)::VARCHAR AS part FROM documents")
def extract_pairs_json(t: Tables) -> DataFrame:
    head = F.concat(F.lit("Metadata: {'pairs': [['M"), "doc_id", F.lit("', '"), F.col("doc_id") + 1_000_000, F.lit("']]}\n---\n"), "text")
    rows = t.documents.select("doc_id", parsing.pairs_from_json(head).alias("pairs"))
    return rows.select("doc_id", F.size("pairs").cast("bigint").alias("n"), F.get("pairs", F.lit(0))["model"].alias("model"), F.get("pairs", F.lit(0))["part"].alias("part"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN doc_id % 2 = 0 THEN 'M' || doc_id END AS model, doc_id % 2 <> 0 OR length(regexp_replace(text, '\\s', '', 'g')) = 0 AS has_block FROM documents")
def extract_pairs_regex(t: Tables) -> DataFrame:
    """Two text tuples are taken out with their block; a block of another shape stays, and one with nothing behind it too."""
    good = F.concat(F.lit("Metadata: {'pairs': [('M"), "doc_id", F.lit("', 'a'), ('N', 'b')]}\n"), "text")
    odd = F.concat(F.lit("Metadata: {'pairs': [('M', 'a', 'c')]}\n"), "text")
    pairs, rest = parsing.pairs_from_literal(F.when(F.col("doc_id") % 2 == 0, good).otherwise(odd))
    rows = t.documents.select("doc_id", pairs.alias("pairs"), rest.alias("rest"))
    return rows.select("doc_id", F.size("pairs").cast("bigint").alias("n"), F.get("pairs", F.lit(0))["model"].alias("model"), F.contains("rest", F.lit("Metadata: {")).alias("has_block"))


@query()
def sentence_chunks(t: Tables) -> DataFrame:
    return parsing.sentence_chunks(t.documents, 128, 16)


@query(r"SELECT doc_id, i - 1 AS section_index, body FROM (SELECT doc_id, unnest(b) AS body, unnest(range(1, len(b) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS b FROM documents))")
def paragraph_lines(t: Tables) -> DataFrame:
    return parsing.paragraphs(t.documents)


_PAGE = "'intro ' || doc_id || chr(10) || '# Part ' || lang || chr(10) || substring(text, 1, 700) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '##  Rest  ' || chr(10) || substring(text, 701, 100000000)"


@query(rf"""WITH l AS (SELECT doc_id, i, line, sum(CASE WHEN regexp_matches(ltrim(line, ' ' || chr(9) || chr(13)), '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split({_PAGE}, chr(10)) AS s FROM documents))),
 h AS (SELECT *, NOT fenced AND regexp_matches(line, '^#{{1,6}}\s+') AS head FROM l), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM h),
 p AS (SELECT doc_id, part, coalesce(max(trim(regexp_replace(line, '^#{{1,6}}\s+', ''), ' ' || chr(9) || chr(13))) FILTER (head), '') AS heading, coalesce(trim(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), ' ' || chr(9) || chr(10) || chr(13)), '') AS body FROM g GROUP BY doc_id, part)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS section_index, heading, body FROM p WHERE heading <> '' OR body <> ''""")
def markdown_sections(t: Tables) -> DataFrame:
    """Sections by heading; a line like a heading inside a code fence is none."""
    return parsing.markdown_sections(t.documents.select("doc_id", F.expr(_PAGE).alias("text")))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[#*`\[\]()]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


_MARKED = r"CASE doc_id % 3 WHEN 0 THEN 'Keywords:  ' || lang || ', ' || doc_id || ' ' || chr(10) || text WHEN 1 THEN 'Context:' || chr(10) || chr(10) || ' ' || lang || chr(10) || text ELSE text END"


@query(rf"SELECT doc_id, rtrim(regexp_extract({_MARKED}, '(?:Context|Keywords):\s*([^\n]*)', 1)) AS keywords FROM documents")
def context_keywords(t: Tables) -> DataFrame:
    """A marker with its line behind it, one with an empty line between, and texts as they are."""
    return t.documents.select("doc_id", T.context_keywords(F.expr(_MARKED)).alias("keywords"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 2 END::BIGINT AS n, CASE WHEN doc_id % 3 <> 2 THEN lang END AS first_keyword FROM documents")
def parse_keyword_json(t: Tables) -> DataFrame:
    body = F.concat(F.lit("[' "), "lang", F.lit("', '', 'x"), "doc_id", F.lit("']"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, body).otherwise("no list at all")
    rows = t.documents.select("doc_id", T.keyword_list(answer).alias("k"))
    return rows.select("doc_id", F.size("k").cast("bigint").alias("n"), F.get("k", F.lit(0)).alias("first_keyword"))


@query("SELECT doc_id, lang AS type, source AS origin FROM documents")
def metadata_kv(t: Tables) -> DataFrame:
    m = T.metadata_pairs(F.concat(F.lit("type="), "lang", F.lit(",origin="), "source"))
    return t.documents.select("doc_id", m["type"].alias("type"), m["origin"].alias("origin"))


@query("""SELECT doc_id, 'string' AS kind_lang, lang, 'number' AS kind_size, n_chars::VARCHAR AS size, 'boolean' AS kind_flag, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, 'array' AS kind_list, '[' || doc_id || ',2]' AS list, 'string' AS kind_odd, '{x' || doc_id AS odd, 'null' AS kind_none FROM documents""")
def metadata_typed(t: Tables) -> DataFrame:
    """Values that are JSON are read as such, others are strings; the last of equal keys counts."""
    one = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    items = F.array(one("lang = x"), one("lang = ", F.col("lang")), one("size=", F.col("n_chars").cast("string")), one("flag=", F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false")), one("list=[", F.col("doc_id").cast("string"), ", 2]"), one("odd={x", F.col("doc_id").cast("string")), one("none=null"))
    m = T.typed_metadata(items)
    value, kind = (lambda k: m[k]["value"]), (lambda k: m[k]["kind"].alias(f"kind_{k}"))
    return t.documents.select("doc_id", *[x for k in ("lang", "size", "flag", "list", "odd") for x in (kind(k), value(k).alias(k))], kind("none"))


_DURATION = "SELECT doc_id, CASE WHEN n_chars < 60 THEN printf('%.1fs', n_chars::DOUBLE) WHEN n_chars < 3600 THEN printf('%.1fm', n_chars / 60.0::DOUBLE) ELSE printf('%.1fh', n_chars / 3600.0::DOUBLE) END AS duration FROM documents"


@query(_DURATION)
def format_duration(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.format_duration(F.col("n_chars").cast("double")).alias("duration"))


_SIZE = "SELECT doc_id, CASE WHEN z < 1024 THEN printf('%.1fB', z) WHEN z < 1048576 THEN printf('%.1fKB', z / 1024) WHEN z < 1073741824 THEN printf('%.1fMB', z / 1048576) ELSE printf('%.1fGB', z / 1073741824) END AS size_text FROM (SELECT doc_id, (n_chars * n_chars + 1)::DOUBLE AS z FROM documents)"


@query(_SIZE)
def format_file_size(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.format_file_size(F.col("n_chars") * F.col("n_chars") + 1).alias("size_text"))


@query(_DURATION)
def format_duration_whole(t: Tables) -> DataFrame:
    """The former name of the query over every document."""
    return t.documents.select("doc_id", T.format_duration(F.col("n_chars").cast("double")).alias("duration"))


@query(_SIZE)
def format_file_size_whole(t: Tables) -> DataFrame:
    """The former name of the query over every document."""
    return t.documents.select("doc_id", T.format_file_size(F.col("n_chars") * F.col("n_chars") + 1).alias("size_text"))


# ---- chunks


@query(with_tables("SELECT doc_id, chunk_index, text FROM chunks", "chunks"))
def fixed_chunks(t: Tables) -> DataFrame:
    return t.chunks.select("doc_id", "chunk_index", "text")


@query(with_tables("SELECT node_id, chunk_index, total_chunks, doc_id % 2 = 0 AS has_keywords FROM chunks", "chunks"))
def chunk_positions(t: Tables) -> DataFrame:
    return t.chunks.select("node_id", "chunk_index", "total_chunks", (F.col("doc_id") % 2 == 0).alias("has_keywords"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS doc_num, count(*) OVER (PARTITION BY conv_id) AS total_docs FROM conversations")
def section_numbering(t: Tables) -> DataFrame:
    by = Window.partitionBy("conv_id")
    return t.raw("conversations").select("conv_id", "turn", F.row_number().over(by.orderBy("turn")).cast("bigint").alias("doc_num"), F.count("*").over(by).alias("total_docs"))


@query("SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 5)) WHERE place <= 3")
def sections_per_file(t: Tables) -> DataFrame:
    """The first three documents of the first five sources."""
    first = t.documents.select("source").distinct().orderBy("source").limit(5)
    rows = t.documents.join(F.broadcast(first), "source", "left_semi")
    return rows.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint").alias("place")).where("place <= 3")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_dedup(t: Tables) -> DataFrame:
    return lifecycle.exact_dedup(t.documents)


# ---- change detection

_OLD = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, (length(text) // 2)::BIGINT) WHEN 2 THEN text || ' appendix of the older version' WHEN 3 THEN substring(text, 1, 500) || ' zz yy xx ' || substring(text, 900) END"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> ''))"
_DIFF = f"""old AS (SELECT doc_id, {_OLD} AS t FROM documents),
 oc AS (SELECT doc_id, i AS chunk_index, substring(t, (i * 1000 + 1)::BIGINT, 1000) AS a FROM (SELECT doc_id, t, unnest(range(0, ceil(length(t) / 1000.0)::BIGINT)) AS i FROM old WHERE t IS NOT NULL)),
 diff AS (SELECT doc_id, chunk_index, similarity, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN similarity >= 0.8 THEN 'unchanged' WHEN similarity >= 0.5 THEN 'modified' ELSE 'replaced' END AS label FROM
 (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.chunk_index, n.chunk_index) AS chunk_index, a, n.text AS b,
 CASE WHEN a IS NOT NULL AND n.text IS NOT NULL THEN CASE WHEN len({_WORDS.format('a')}) + len({_WORDS.format('n.text')}) = 0 THEN 1 ELSE len(list_intersect({_WORDS.format('a')}, {_WORDS.format('n.text')}))::DOUBLE / len(list_distinct(list_concat({_WORDS.format('a')}, {_WORDS.format('n.text')}))) END END AS similarity
 FROM oc o FULL OUTER JOIN chunks n ON o.doc_id = n.doc_id AND o.chunk_index = n.chunk_index))"""


def _diff(t: Tables) -> DataFrame:
    old = t.documents.select("doc_id", t.old_text().alias("text"))
    return lifecycle.document_diff(old, t.documents.select("doc_id", "text"))


def _kept_diff(t: Tables) -> DataFrame:
    """The comparison that several analyses start from, stored once."""
    return t.kept("chunk-diff", lambda: _diff(t))


def _diff_sql(sql: str) -> str:
    return with_tables("", "chunks").rstrip() + ", " + _DIFF + " " + sql


@query(_diff_sql("SELECT doc_id, chunk_index, round(similarity, 6) AS similarity, label FROM diff"))
def chunk_diff(t: Tables) -> DataFrame:
    return _diff(t).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT a.doc_id, round(len(list_intersect({_WORDS.format('a.text')}, {_WORDS.format('b.text')}))::DOUBLE / greatest(1, len(list_distinct(list_concat({_WORDS.format('a.text')}, {_WORDS.format('b.text')})))), 6) AS similarity FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def jaccard_similarity(t: Tables) -> DataFrame:
    """Word sets of each document and the next."""
    a, b = t.documents.select("doc_id", "text"), t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.set_jaccard(T.word_set(F.col("text")), T.word_set(F.col("other"))), 6).alias("similarity"))


_REFINED = "refined AS (SELECT doc_id, count(*) AS total_chunks, count(*) FILTER (label <> 'unchanged') AS changed_chunks, count(*) FILTER (label <> 'unchanged') / count(*) AS change_ratio FROM diff GROUP BY doc_id), kinds AS (SELECT *, CASE WHEN change_ratio >= 0.9 THEN 'complete_rewrite' WHEN change_ratio >= 0.7 THEN 'structure_change' WHEN change_ratio >= 0.4 THEN 'major_update' WHEN change_ratio > 0 THEN 'minor_update' ELSE 'no_change' END AS change_type FROM refined)"


@query(_diff_sql("").rstrip() + f", {_REFINED} SELECT doc_id, total_chunks, changed_chunks, round(change_ratio, 6) AS change_ratio, change_type, round(least(1.0, 0.7 + 0.3 * least(total_chunks / 10, 1.0)), 6)::DOUBLE AS confidence FROM kinds")
def change_refinement(t: Tables) -> DataFrame:
    return lifecycle.refine(_kept_diff(t)).withColumns({"change_ratio": F.round("change_ratio", 6), "confidence": F.round("confidence", 6)})


_STRATEGY = "CASE change_type WHEN 'no_change' THEN 'skip' WHEN 'minor_update' THEN 'incremental' ELSE 'full_reindex' END"
_PRIORITY = "CASE WHEN change_type IN ('major_update', 'minor_update') THEN 2 WHEN change_type = 'no_change' THEN 3 ELSE 1 END"
_EFFORT = "round((CASE change_type WHEN 'no_change' THEN 0.1 WHEN 'minor_update' THEN 5.0 WHEN 'major_update' THEN 15.0 WHEN 'structure_change' THEN 25.0 ELSE 30.0 END::DOUBLE * (1 + least(n_chars / 10000, 3.0::DOUBLE) + least(changed_chunks / 10, 2.0::DOUBLE)))::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE"


def _analysis(t: Tables) -> DataFrame:
    rows = lifecycle.refine(_kept_diff(t)).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    c = F.col("change_type")
    return rows.select("doc_id", "change_type", lifecycle.strategy(c).alias("strategy"), lifecycle.priority(c).alias("priority"), lifecycle.effort(c, F.col("n_chars"), F.col("changed_chunks")).alias("effort"))


_ANALYSIS = _diff_sql("").rstrip() + f", {_REFINED}, analysis AS (SELECT doc_id, change_type, {_STRATEGY} AS strategy, {_PRIORITY} AS priority, {_EFFORT} AS effort FROM kinds JOIN documents USING (doc_id)) "


_LOST = "(SELECT d.doc_id, n_chars, d.doc_id % 7 = 3 AS lost, coalesce(change_type, 'no_change') AS change_type, coalesce(changed_chunks, 0) AS changed_chunks, coalesce(total_chunks, 0) AS total_chunks FROM documents d LEFT JOIN kinds USING (doc_id))"


@query(_diff_sql("").rstrip() + f", {_REFINED} SELECT doc_id, CASE WHEN lost THEN 'complete_rewrite' ELSE change_type END AS change_type, CASE WHEN lost THEN 'full_reindex' ELSE {_STRATEGY} END AS strategy, CASE WHEN lost THEN 0.0 ELSE round(least(1.0, 0.7 + 0.3 * least(total_chunks / 10, 1.0)), 6) END::DOUBLE AS confidence, CASE WHEN lost THEN 60.0 ELSE {_EFFORT} END::DOUBLE AS effort FROM {_LOST}")
def safe_analysis(t: Tables) -> DataFrame:
    """Documents compared with their older texts; those whose text cannot be read get the safe answer."""
    old = t.documents.select("doc_id", t.old_text().alias("text"))
    new = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 != 3, F.col("text")).alias("text"))
    return lifecycle.safe_analysis(old, new).withColumn("confidence", F.round("confidence", 6))


@query(_ANALYSIS + "SELECT doc_id, strategy, priority FROM analysis")
def update_strategy(t: Tables) -> DataFrame:
    return _analysis(t).select("doc_id", "strategy", "priority")


@query(_ANALYSIS + "SELECT doc_id, effort FROM analysis")
def effort_estimate(t: Tables) -> DataFrame:
    return _analysis(t).select("doc_id", "effort")


@query(_ANALYSIS + "SELECT * FROM analysis")
def batch_change_analysis(t: Tables) -> DataFrame:
    return _analysis(t)


@query(_ANALYSIS + "SELECT strategy, count(*) AS n, round(sum(effort), 4) AS effort FROM analysis GROUP BY strategy")
def reindex_plan(t: Tables) -> DataFrame:
    return _analysis(t).groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.sum("effort"), 4).alias("effort"))


@query(_ANALYSIS + "SELECT doc_id, CASE priority WHEN 1 THEN 'HIGH' WHEN 3 THEN 'LOW' ELSE 'NORMAL' END AS job_priority FROM analysis WHERE strategy <> 'skip'")
def job_priority(t: Tables) -> DataFrame:
    return _analysis(t).where("strategy <> 'skip'").select("doc_id", lifecycle.job_priority(F.col("priority")).alias("job_priority"))


_CANDIDATES = "(SELECT doc_id FROM (SELECT doc_id, state, row_number() OVER (PARTITION BY state ORDER BY updated_at DESC, doc_id) AS place FROM registry WHERE state IN ('stale', 'new')) WHERE place <= 100)"


def _candidates(t: Tables) -> DataFrame:
    """Up to a hundred stale and a hundred new documents, the latest first: the limit is the operator's own."""
    page = lambda s: t.registry.where(F.col("state") == s).orderBy(F.desc("updated_at"), "doc_id").limit(100).select("doc_id", "state")
    return page("stale").unionByName(page("new"))


@query(with_tables(f"SELECT doc_id, state FROM registry WHERE doc_id IN {_CANDIDATES}", "registry"))
def update_candidates(t: Tables) -> DataFrame:
    return _candidates(t)


@query(_ANALYSIS.replace("WITH ", "WITH " + with_tables("", "registry")[5:].rstrip() + ", ", 1) + f"SELECT doc_id, priority, effort, used FROM (SELECT doc_id, priority, effort, sum(effort) OVER (ORDER BY priority, effort, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM analysis WHERE strategy <> 'skip' AND doc_id IN {_CANDIDATES}) WHERE used <= 300")
def update_recommendations(t: Tables) -> DataFrame:
    some = _analysis(t).where("strategy <> 'skip'").join(F.broadcast(_candidates(t).select("doc_id")), "doc_id", "left_semi")
    return lifecycle.within_budget(some, 300.0).select("doc_id", "priority", "effort", "used")


@query(with_tables("SELECT doc_id, content_hash, sha256(source || '|' || size || '|' || (1700000000 + doc_id * 3600) || '|' || content_hash) AS metadata_hash FROM registry", "registry"))
def fingerprints(t: Tables) -> DataFrame:
    r = t.registry
    return r.select("doc_id", "content_hash", lifecycle.metadata_hash(F.col("source"), F.col("size"), F.col("modified_time").cast("bigint"), F.col("content_hash")).alias("metadata_hash"))


@query(with_tables("""SELECT doc_id, CASE WHEN f.source IS NULL THEN 'new_document' WHEN f.metadata_hash = r.metadata_hash THEN 'no_change'
  WHEN abs(r.size - f.size) / greatest(f.size, 1) > 0.9 THEN 'complete_rewrite' WHEN abs(r.size - f.size) / greatest(f.size, 1) > 0.7 THEN 'structure_change' WHEN abs(r.size - f.size) / greatest(f.size, 1) > 0.4 THEN 'major_update' ELSE 'minor_update' END AS change_type
  FROM registry r LEFT JOIN (SELECT source, metadata_hash, size FROM fingerprints) f USING (source)""", "registry", "fingerprints"))
def change_classification(t: Tables) -> DataFrame:
    stored = t.fingerprints.select("source", F.col("metadata_hash").alias("stored"), F.col("size").alias("old_size"))
    kind = lifecycle.change_class(F.col("stored"), F.col("metadata_hash"), F.col("old_size"), F.col("size"))
    return t.registry.join(stored, "source", "left").select("doc_id", kind.alias("change_type"))


# ---- chat and events


@query("SELECT conv_id, turn, words, held FROM (SELECT conv_id, turn, words, sum(words) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS held FROM (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM conversations)) WHERE held <= 200")
def chat_memory_window(t: Tables) -> DataFrame:
    """The last turns of each conversation that fit a memory of 200 words."""
    rows = t.raw("conversations").select("conv_id", "turn", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint").alias("words"))
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("held", F.sum("words").over(last)).where("held <= 200")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(t: Tables) -> DataFrame:
    from docweave.streaming.feeds import tumbling

    return tumbling(t.raw("events"), "1 day").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def events_sliding(t: Tables) -> DataFrame:
    from docweave.streaming.feeds import sliding

    return sliding(t.raw("events"), "2 hours", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
  (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, session""")
def events_session(t: Tables) -> DataFrame:
    from docweave.streaming.feeds import sessions

    return sessions(t.raw("events"), "12 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
