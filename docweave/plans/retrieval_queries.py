"""Keyword, vector and hybrid retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as T
from docweave.operators import fusion, parsing, postings, retrieval
from docweave.plans.base import CTE, Tables, with_tables
from docweave.plans.catalog import query
from docweave.plans.engine import Engine
from docweave.sources.storage import scratch
from docweave.sources.versions import TableStore

#: The query texts of the fixed retrieval queries.
QUERY = "that with tion heen that"
TERMS = ["that", "with", "tion"]
PHRASE = "of the"

_TOK = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) > 2 AND t NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for'))"
_PLAIN = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id, {_TOK} AS tokens FROM documents")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY doc_id, term")
def term_frequencies(t: Tables) -> DataFrame:
    return retrieval.term_frequencies(t.documents, "doc_id", T.tokenize(F.col("text")))


@query(with_tables(f"SELECT term, count(*) AS nodes, sum(tf)::BIGINT AS occurrences FROM (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest({_TOK}) AS term FROM chunks) GROUP BY node_id, term) GROUP BY term", "chunks"))
def postings_build(t: Tables) -> DataFrame:
    """Words are counted inside ranges of chunks; the one shuffle, by term, carries counts of counts."""
    found = postings.node_blocks(t.chunks, "node_id", {"text": T.tokenize(F.col("text"))})
    occurrences = F.aggregate("tfs", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.where("term is not null").groupBy("term").agg(F.sum("n").cast("bigint").alias("nodes"), F.sum(occurrences).alias("occurrences"))


@query(f"SELECT doc_id, term, count(*) AS tf, min(place)::BIGINT AS first_place, (SELECT count(DISTINCT doc_id) FROM (SELECT doc_id, unnest({_PLAIN}) AS x FROM documents) WHERE x = term) AS df FROM (SELECT doc_id, term, place FROM (SELECT doc_id, unnest({_PLAIN}) AS term, generate_subscripts({_PLAIN}, 1) - 1 AS place FROM documents) WHERE term IN ('that', 'thanea', 'tion')) GROUP BY doc_id, term")
def stored_postings(t: Tables) -> DataFrame:
    """What the stored index knows of three terms: reads only the buckets of these."""
    index, wanted = t.keyword_index, ["that", "thanea", "tion"]
    rows = index.matched("doc_id", wanted, every_word=True).select("doc_id", "term", "tf", "df")
    places = index.postings(index.blocks(wanted)).select(F.col("key").alias("doc_id"), "term", F.array_min("positions").cast("bigint").alias("first_place"))
    return rows.join(places, ["doc_id", "term"])


@query(f"SELECT count(*) AS n, round(avg(len({_TOK})), 6) AS avgdl FROM documents")
def bm25_corpus_stats(t: Tables) -> DataFrame:
    stats = retrieval.corpus_stats(retrieval.node_lengths(t.documents, "doc_id", T.tokenize(F.col("text"))))
    return stats.withColumn("avgdl", F.round("avgdl", 6))


_BM25 = f"""bm AS (WITH d AS (SELECT doc_id, {_TOK} AS tok FROM documents), q AS (SELECT * FROM (VALUES ('that', 2.0), ('with', 1.0), ('tion', 1.0), ('heen', 1.0)) q(term, w)),
 s AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM d), p AS (SELECT doc_id, len(tok) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tok, unnest(tok) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
 SELECT doc_id, round(sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 12) AS score FROM p JOIN f USING (term) JOIN q USING (term) CROSS JOIN s GROUP BY doc_id)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_search(t: Tables) -> DataFrame:
    """Read best first: only ranges of documents that can hold one of the ten best are scored."""
    return retrieval.bm25_top(t.keyword_index, "doc_id", QUERY, 10).withColumn("score", F.round("score", 6))


_FTS = f"""f0 AS (WITH d AS (SELECT doc_id, {_PLAIN} AS tok FROM documents), s AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM d),
 p AS (SELECT doc_id, len(tok) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tok, unnest(tok) AS term FROM d) WHERE term IN ('that', 'with', 'tion') GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY term), x AS (SELECT *, ln((n - df + 0.5) / (df + 0.5)) AS i FROM p JOIN f USING (term) CROSS JOIN s)
 SELECT doc_id, round(-sum(CASE WHEN i > 0 THEN i ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 12) AS score, count(*) AS found FROM x GROUP BY doc_id)"""


def _fts(t: Tables, every: bool = True) -> DataFrame:
    return retrieval.fts_scores(t.keyword_index, "doc_id", retrieval.plain_tokens(F.col("text")), TERMS, every)


@query(f"WITH {_FTS} SELECT doc_id, round(score, 6) AS score FROM f0")
def bm25_fts_scores(t: Tables) -> DataFrame:
    return _fts(t, every=False).withColumn("score", F.round("score", 6))


@query(f"WITH {_FTS} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM f0 WHERE found = 3 ORDER BY score, doc_id LIMIT 10")
def keyword_search_fts(t: Tables) -> DataFrame:
    return retrieval.fts_top(t.keyword_index, "doc_id", TERMS, 10).withColumn("score", F.round("score", 6))


@query()
def keyword_search_porter(t: Tables) -> DataFrame:
    """Chunks by stems in all fields, from the stored index: the lexicon gives the words of a stem, and only their folders are read."""
    return retrieval.fts_top(t.chunk_index, "node_id", ["thaneas", "with"], 10, stems=True)


_PHRASE = f"""o AS (SELECT doc_id, dl, CAST((length(p) - length(replace(p, ' of  the ', ''))) / 9 AS BIGINT) AS occurrences FROM (SELECT doc_id, len({_PLAIN}) AS dl, ' ' || array_to_string({_PLAIN}, '  ') || ' ' AS p FROM documents)),
 s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (occurrences > 0) AS df FROM o),
 h AS (SELECT doc_id, occurrences, round(CASE WHEN n - df > df THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * occurrences * 2.2 / (occurrences + 1.2 * (0.25 + 0.75 * dl / avgdl)), 12) AS gain FROM o, s WHERE occurrences > 0)"""


@query(f"WITH {_PHRASE} SELECT doc_id, occurrences, row_number() OVER (ORDER BY gain DESC, doc_id) AS rank, 1.0::DOUBLE / (row_number() OVER (ORDER BY gain DESC, doc_id) + 1) AS score FROM h ORDER BY gain DESC, doc_id LIMIT 15")
def phrase_search(t: Tables) -> DataFrame:
    """By positions in the stored index, ranked as full-text search ranks a phrase."""
    return retrieval.phrase_hits(t.keyword_index, "doc_id", "text", PHRASE, 15)


@query()
def phrase_search_stemmed(t: Tables) -> DataFrame:
    """Each word of the phrase matches by its stem."""
    return retrieval.phrase_hits(t.chunk_index, "node_id", "text", "ofs the", 15, stems=True)


_TWO = r"regexp_extract_all(lower(trim(regexp_replace(regexp_replace(text, '[#*`\[\]()]', ' ', 'g'), '\s+', ' ', 'g'))), '[\p{L}\p{N}_]+') || regexp_extract_all(lower(regexp_extract(text, '(?:Context|Keywords):\s*([^\n]*)', 1)), '[\p{L}\p{N}_]+')"


_HELD = f"""x AS (SELECT node_id, doc_id, chunk_index, len(tok) AS dl, len(list_filter(tok, lambda w: w = 'thanea')) AS tf FROM (SELECT node_id, doc_id, chunk_index, {_TWO} AS tok FROM chunks)),
 s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM x)"""


@query(f"WITH {CTE['chunks']}, {_HELD} SELECT node_id, lang, chunk_index, round(-CASE WHEN n - df > df THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM x JOIN documents USING (doc_id) CROSS JOIN s WHERE tf > 0")
def fts_join_nodes(t: Tables) -> DataFrame:
    """Hits in two fields of the chunks' index joined with what the library knows of the chunks, which reads no text."""
    hits = retrieval.fts_scores(t.chunk_index, "node_id", F.lit(None), ["thanea"])
    nodes = t.documents.where("n_chars > 0").select("doc_id", "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n_chars - 1) div 1000"))).alias("chunk_index"))
    rows = nodes.withColumn("node_id", F.concat_ws("_", "doc_id", "chunk_index")).join(hits, "node_id")
    return rows.select("node_id", "lang", "chunk_index", F.round("score", 6).alias("score"))


_CHANGED = "changed AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN text || ' thanea that with appended' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"


@query(f"WITH {_CHANGED}, {_BM25.replace('FROM documents', 'FROM changed')} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def index_after_updates(t: Tables) -> DataFrame:
    """An index that took three commits: all documents, a fifth of them changed, and every eleventh deleted.  A search scores as
    on an index of what is left, and reads no text of documents that did not change."""
    words = {"text": retrieval.plain_tokens(F.col("text"))}
    store = TableStore(t.spark, scratch(t.spark, "index-updates"))
    size = t.documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = postings.KeywordIndex.build(t.documents, "doc_id", words, store.path, size)
    tx = store.begin()
    changed = t.documents.where("doc_id % 5 = 1").select("doc_id", F.concat("text", F.lit(" thanea that with appended")).alias("text"))
    postings.KeywordIndex.remove(tx, changed.select("doc_id"))
    postings.KeywordIndex.add(tx, changed, "doc_id", words, size // 5)
    tx.commit()
    tx = store.begin()
    postings.KeywordIndex.remove(tx, t.documents.where("doc_id % 11 = 0").select("doc_id"))
    index = postings.KeywordIndex(tx.commit())
    return retrieval.bm25_top(index, "doc_id", QUERY, 50).withColumn("score", F.round("score", 6))


# ---- vectors

_VEC = "v0 AS (SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)"


def _vector_scores(t: Tables, where: str = "true") -> DataFrame:
    return retrieval.vector_scores(t.vectors.where(where), "id", "embedding", t.query_vector)


@query(f"WITH {_VEC} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v0 ORDER BY score DESC, id LIMIT 10")
def vector_topk(t: Tables) -> DataFrame:
    return retrieval.top(_vector_scores(t), "id", F.desc("score"), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v0 WHERE label IN (1, 3) ORDER BY score DESC, id LIMIT 10")
def vector_prefiltered(t: Tables) -> DataFrame:
    return retrieval.top(_vector_scores(t, "label in (1, 3)"), "id", F.desc("score"), 10).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS points, count(*) FILTER (len(embedding) = 64) AS fitting, count(*) FILTER (embedding IS NULL) AS missing FROM embeddings")
def vector_collection_verify(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.vectors.agg(F.count("*").alias("points"), F.count_if(F.size(e) == 64).alias("fitting"), F.count_if(e.isNull()).alias("missing"))


# ---- fusion of a vector and a keyword list

_LISTS = f"""{_VEC}, {_FTS}, v AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v0 ORDER BY score DESC, id LIMIT 30),
 k AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM f0 ORDER BY score, doc_id LIMIT 400)"""
_FLIP = ", kf AS (SELECT id, -score AS score, rank FROM k)"
_NORM = lambda src, out: f"{out} AS (SELECT id, CASE WHEN min(score) OVER () < 0 THEN CASE WHEN min(score) OVER () = max(score) OVER () THEN 0.5 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE 0 END AS s FROM {src})"


def _lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = retrieval.top(_vector_scores(t), "id", F.desc("score"), 30)
    k = retrieval.fts_top(t.keyword_index, "id", TERMS, 400, every=False)
    return v, k


def _last(fused: str) -> str:
    return f"SELECT id, round(fused, 6) AS fused, row_number() OVER (ORDER BY round(fused, 9) DESC, id) AS rank FROM ({fused}) ORDER BY rank LIMIT 20"


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("fused", F.round("fused", 6))


def _fused(build):  # noqa: ANN001, ANN202
    """Sums of the same numbers in another order differ in the last bits; ranks follow nine places in both engines."""
    order = Window.orderBy(F.desc(F.round("fused", 9)), "id")
    return build.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 20").withColumn("fused", F.round("fused", 6))


@query(f"WITH {_LISTS} SELECT id, round(fused, 9) AS fused, vector_rank, keyword_rank, search_type, row_number() OVER (ORDER BY round(fused, 12) DESC, id) AS rank FROM (SELECT coalesce(v.id, k.id) AS id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) AS fused, v.rank AS vector_rank, k.rank AS keyword_rank, CASE WHEN k.id IS NULL THEN 'vector' WHEN v.id IS NULL THEN 'keyword' ELSE 'hybrid' END AS search_type FROM v FULL OUTER JOIN k ON v.id = k.id) ORDER BY rank LIMIT 20")
def fusion_rrf(t: Tables) -> DataFrame:
    return fusion.rrf(*_lists(t), 20).withColumn("fused", F.round("fused", 9))


def _weighted_sql(keyword: str, wv: str = "0.7", wk: str = "0.3", more: str = "") -> str:
    both = f"SELECT coalesce(a.id, b.id) AS id, ({wv} * coalesce(a.s, 0) + {wk} * coalesce(b.s, 0)) * CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1.1 ELSE 1 END AS fused FROM nv a FULL OUTER JOIN nk b ON a.id = b.id {more}"
    return f"WITH {_LISTS}{_FLIP}, {_NORM('v', 'nv')}, {_NORM(keyword, 'nk')} " + _last(both)


@query(_weighted_sql("kf"))
def fusion_weighted(t: Tables) -> DataFrame:
    return _fused(fusion.weighted(*_lists(t), 1000))


@query(_weighted_sql("k"))
def fusion_weighted_compat(t: Tables) -> DataFrame:
    return _fused(fusion.weighted(*_lists(t), 1000, compat=True))


@query(_weighted_sql("kf", "(0.3 + o * 0.2)", "(0.7 - o * 0.2)", "CROSS JOIN (SELECT count(*) FILTER (v.id IS NOT NULL AND k.id IS NOT NULL) / count(*) AS o FROM v FULL OUTER JOIN k ON v.id = k.id)"))
def fusion_adaptive(t: Tables) -> DataFrame:
    return _fused(fusion.adaptive(*_lists(t), "pm10 power", 1000))


@query(f"WITH {_LISTS} SELECT count(*) FILTER (v.id IS NOT NULL AND k.id IS NOT NULL) AS both_lists, count(*) AS any_list, round(count(*) FILTER (v.id IS NOT NULL AND k.id IS NOT NULL) / count(*), 6) AS ratio FROM v FULL OUTER JOIN k ON v.id = k.id")
def result_overlap(t: Tables) -> DataFrame:
    return fusion.overlap(*_lists(t)).withColumn("ratio", F.round("ratio", 6))


def _alpha_sql(keyword: str) -> str:
    return f"WITH {_LISTS}{_FLIP} " + _last(f"SELECT coalesce(v.id, q.id) AS id, 0.5 * coalesce(v.score / (SELECT max(score) FROM v), 0) + 0.5 * coalesce(abs(q.score) / (SELECT max(score) FROM {keyword}), 0) AS fused FROM v FULL OUTER JOIN {keyword} q ON v.id = q.id")


@query(_alpha_sql("kf"))
def fusion_alpha(t: Tables) -> DataFrame:
    return _fused(fusion.alpha(*_lists(t), 1000))


@query(_alpha_sql("k"))
def fusion_alpha_compat(t: Tables) -> DataFrame:
    return _fused(fusion.alpha(*_lists(t), 1000, compat=True))


@query(f"WITH {_LISTS}{_FLIP}, a AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM v), b AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM kf) " + _last("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN (a.s + b.s) / 2 ELSE coalesce(a.s, b.s) END AS fused FROM a FULL OUTER JOIN b ON a.id = b.id"))
def fusion_relative(t: Tables) -> DataFrame:
    return _fused(fusion.relative(*_lists(t), 1000))


@query(f"WITH {_LISTS} " + _last("SELECT id, f / max(f) OVER () AS fused FROM (SELECT coalesce(v.id, k.id) AS id, 0.7 * coalesce(v.score, 0) + coalesce(0.3 / k.rank, 0) AS f FROM v FULL OUTER JOIN k ON v.id = k.id)"))
def fusion_rank_weighted(t: Tables) -> DataFrame:
    return _fused(fusion.rank_weighted(*_lists(t), 1000))


@query(f"""WITH {_VEC}, {_FTS}, v AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v0 JOIN documents d ON d.doc_id = id WHERE d.lang = 'en' ORDER BY score DESC, id LIMIT 30),
 k AS (SELECT f0.doc_id AS id, score, row_number() OVER (ORDER BY score, f0.doc_id) AS rank FROM f0 JOIN documents d USING (doc_id) WHERE found = 3 AND d.lang = 'en' ORDER BY score, id LIMIT 30)
 SELECT id, round(f, 9) AS fused, row_number() OVER (ORDER BY round(f, 12) DESC, id) AS rank FROM (SELECT coalesce(v.id, k.id) AS id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) AS f FROM v FULL OUTER JOIN k ON v.id = k.id) ORDER BY rank LIMIT 10""")
def hybrid_search_e2e(t: Tables) -> DataFrame:
    """Filtered hybrid search: both lists over-fetched three times, fused by reciprocal ranks, ten hits."""
    return Engine(t.documents, t.vectors, t.keyword_index).search(TERMS, t.query_vector, top_k=10, where=F.col("lang") == "en").select("id", F.round("fused", 9).alias("fused"), "rank")


_SHORT = _LISTS.replace("FROM f0 ORDER BY score, doc_id LIMIT 400", "FROM f0 WHERE found = 3 ORDER BY score, doc_id LIMIT 30")


@query(f"WITH {_SHORT}{_FLIP}, {_NORM('v', 'nv')}, {_NORM('kf', 'nk')}, w AS (SELECT coalesce(a.id, b.id) AS id, (0.7 * coalesce(a.s, 0) + 0.3 * coalesce(b.s, 0)) * CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1.1 ELSE 1 END AS fused FROM nv a FULL OUTER JOIN nk b ON a.id = b.id) SELECT 'vector' AS route, id, rank FROM v WHERE rank <= 10 UNION ALL SELECT 'keyword', id, rank FROM k WHERE rank <= 10 UNION ALL (SELECT 'weighted', id, row_number() OVER (ORDER BY round(fused, 9) DESC, id) AS rank FROM w ORDER BY rank LIMIT 10) UNION ALL SELECT 'vector, filtered hits', id, rank FROM v JOIN documents d ON d.doc_id = id WHERE rank <= 10 AND d.lang = 'en'")
def search_routes(t: Tables) -> DataFrame:
    """The engine's routes beside reciprocal ranks: one list alone, weighted fusion, and filters on the hits."""
    engine = Engine(t.documents, t.vectors, t.keyword_index)
    route = lambda name, df: df.select(F.lit(name).alias("route"), "id", "rank")
    rows = route("vector", engine.search(TERMS, t.query_vector, "vector")).unionByName(route("keyword", engine.search(TERMS, kind="keyword")))
    rows = rows.unionByName(route("weighted", engine.search(TERMS, t.query_vector, fuse="weighted")))
    return rows.unionByName(route("vector, filtered hits", engine.search(TERMS, t.query_vector, "vector", where=F.col("lang") == "en", post=True)))


@query(r"SELECT item_id, regexp_matches(text, '\d{7}|\d{2}-\d{3}-\d{3}') AS has_part_number, contains(lower(text), 'matrix') OR contains(lower(text), 'model') OR contains(lower(text), 'laser') OR contains(lower(text), 'series') AS has_model_reference, CASE WHEN regexp_matches(text, '\d{7}|\d{2}-\d{3}-\d{3}') THEN 'part_number' WHEN contains(lower(text), 'matrix') OR contains(lower(text), 'model') OR contains(lower(text), 'laser') OR contains(lower(text), 'series') THEN 'model' ELSE 'general' END AS query_type, len(regexp_extract_all(text, '\d{7}|\d{2}-\d{3}-\d{3}')) AS part_numbers FROM (SELECT doc_id AS item_id, text FROM documents)")
def query_analysis(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("item_id"), *parsing.analyse_query(F.col("text")))
    return rows.select("item_id", "has_part_number", "has_model_reference", "query_type", F.size("detected_part_numbers").cast("bigint").alias("part_numbers"))


@query(with_tables("SELECT node_id, substring(text, 1, 200) AS preview, substring(content_hash, 1, 16) AS hash FROM chunks JOIN registry USING (doc_id) WHERE chunk_index = 0".replace("substring(text", "substring(chunks.text"), "registry", "chunks"))
def search_preview(t: Tables) -> DataFrame:
    rows = t.chunks.where("chunk_index = 0").select("doc_id", "node_id", F.substring("text", 1, 200).alias("preview"))
    return rows.join(t.registry.select("doc_id", "content_hash"), "doc_id").select("node_id", "preview", F.substring("content_hash", 1, 16).alias("hash"))


@query(f"""WITH w AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM w GROUP BY term)
 SELECT doc_id, term, rank FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln((SELECT count(*) FROM documents) / df), 9) DESC, term) AS rank FROM w JOIN f USING (term)) WHERE rank <= 5""")
def keyword_enrichment(t: Tables) -> DataFrame:
    """The offline keyword model: the five terms of highest tf-idf of each document."""
    index = t.keyword_index
    kept = (F.length("term") > 2) & ~F.col("term").isin(*T.STOP_WORDS)
    blocks = index.snapshot.read("keyword_postings", index.snapshot.segments("keyword_postings")).where(kept)
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    each = blocks.select("term", "docs", "tfs").join(df, "term").select("term", "df", F.explode(F.arrays_zip("docs", "tfs")).alias("p"))
    scored = each.select(F.col("p.docs").alias("doc_id"), "term", F.round(F.col("p.tfs") * F.log(index.n / F.col("df")), 9).alias("w"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("w"), "term")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 5").select("doc_id", "term", "rank")
