"""Registry, chunks, entries, fingerprints and jobs derived from the given tables.

The driver's documents, labels, embeddings and events stand in for a document library: every derived column is a plain
function of the ids, so that both engines and every size agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import clean_text, context_keywords, fixed_chunks
from docweave.operators.postings import KeywordIndex
from docweave.operators.retrieval import plain_tokens
from docweave.sources.storage import stored_once
from docweave.sources.versions import TableStore

#: Instant that all rules of age count from, in epoch seconds.
NOW = 1_706_500_000.0
CHUNK = 1000


class Tables:
    """The given tables and the library tables derived from them, each read or built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @property
    def registry(self) -> DataFrame:
        """Documents as the registry knows them; the text rides along and is pruned where it is not used."""
        return self.documents.selectExpr(
            "doc_id",
            "concat('library/', source, '/doc', doc_id, case doc_id % 4 when 0 then '.pdf' when 1 then '.md' when 2 then '.txt' else '-ds.pdf' end) as source",
            "sha2(text, 256) as content_hash",
            "n_chars as size",
            "sha2(concat_ws('|', concat('library/', source, '/doc', doc_id), n_chars, 1700000000 + doc_id * 3600, sha2(text, 256)), 256) as metadata_hash",
            "1700000000D + doc_id * 3600 as modified_time",
            "1690000000D + doc_id * 60 as created_at",
            "1700000000D + (doc_id * 7919) % 100000 as updated_at",
            "case doc_id % 5 when 0 then 'new' when 1 then 'updating' when 2 then 'indexed' when 3 then 'stale' else 'corrupted' end as state",
            "doc_id % 3 <> 0 as vector_indexed",
            "doc_id % 4 <> 0 as keyword_indexed",
            "cast(ceil(n_chars / 1000D) as bigint) as chunk_count",
            "cast(case when doc_id % 7 = 0 then 1 else 0 end as bigint) as error_count",
            "case when doc_id % 7 = 0 then 'parse failed' end as last_error",
            """concat('{"source_type":"', lang, '","file_size":', n_chars, ',"parse_method":"', case doc_id % 2 when 0 then 'vision' else 'text' end, '"}') as metadata""",
            "array(named_struct('model', concat('PM', doc_id % 50, 'K'), 'part', cast(1000000 + doc_id as string))) as pairs",
            "case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then concat('kw', doc_id % 9, ', ', lang) end as keywords",
            "lang",
            "text",
        )

    @property
    def chunks(self) -> DataFrame:
        """Fixed-width chunks: doc_id, chunk_index, total_chunks, node_id, text."""
        pieces = self.documents.select("doc_id", fixed_chunks(F.col("text"), CHUNK).alias("pieces"))
        rows = pieces.select("doc_id", F.size("pieces").cast("bigint").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "text"))
        return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "total_chunks", F.concat_ws("_", "doc_id", "chunk_index").alias("node_id"), "text")

    @property
    def entries(self) -> DataFrame:
        """Index entries: one for each chunk of the indexes that hold a document; some lack, some have no document."""
        r = self.registry.where("chunk_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("chunk_index"))
        kind = lambda k, rule: r.where(rule).select("doc_id", F.lit(k).alias("index_type"), "chunk_index")
        lost = self.documents.where("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("vector").alias("index_type"), F.lit(0).cast("bigint").alias("chunk_index"))
        rows = kind("vector", "doc_id % 3 <> 0").unionByName(kind("keyword", "doc_id % 4 <> 0 and doc_id % 10 <> 5")).unionByName(lost)
        return rows.withColumn("node_id", F.concat_ws("_", "doc_id", "chunk_index"))

    @property
    def fingerprints(self) -> DataFrame:
        """Stored fingerprints of most documents, some of another content and size than now."""
        return self.registry.where("doc_id % 6 <> 0").selectExpr(
            "source",
            "case when doc_id % 5 < 3 then content_hash else sha2(concat(text, 'x'), 256) end as content_hash",
            "case when doc_id % 7 in (0, 6) and doc_id % 5 < 3 and doc_id % 11 <> 0 then metadata_hash else sha2(concat(metadata_hash, 'x'), 256) end as metadata_hash",
            "case doc_id % 7 when 1 then size * 90 div 100 when 2 then size * 70 div 100 when 3 then size * 50 div 100 when 4 then size * 5 div 100 when 5 then size * 180 div 100 else size end as size",
            "1700000000D + doc_id * 500 as last_seen",
            "1690000000D + doc_id * 60 as created_at",
            "doc_id",
            "case when doc_id % 9 = 0 then 'failed' when doc_id % 2 = 0 then 'processed' else 'pending' end as processing_status",
        )

    @property
    def jobs(self) -> DataFrame:
        epoch = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6
        rows = self.raw("events").select("event_id", "user_id", "event_type", epoch.alias("updated_at"))
        status = "case event_type when 'click' then 'pending' when 'view' then 'processing' when 'purchase' then 'completed' when 'error' then 'failed' else 'cancelled' end"
        return rows.selectExpr(
            "event_id as job_id",
            "concat('library/src', user_id % 20) as source",
            "case event_id % 3 when 0 then 'add' when 1 then 'update' else 'remove' end as job_type",
            "event_id % 4 + 1 as priority",
            "updated_at - 600 as created_at",
            "updated_at",
            "case when event_type <> 'click' then updated_at - (event_id % 500) end as started_at",
            "case when event_type in ('purchase', 'error') then updated_at end as completed_at",
            f"{status} as status",
            "event_id % 5 as retry_count",
            "3L as max_retries",
            "concat('w', user_id % 8) as worker_id",
        )

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    @property
    def query_vector(self) -> DataFrame:
        return self.raw("embeddings").where("vec_id = 0").select(F.col("embedding").alias("query"))

    def _index(self, name: str, nodes: Callable[[], DataFrame], key: str, fields: dict[str, Column]) -> KeywordIndex:
        def build(path: str) -> None:
            size = self.documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            KeywordIndex.build(nodes(), key, fields, path, size)

        return KeywordIndex(TableStore(self.spark, stored_once(self.spark, name, self.sf_dir, build)).snapshot())

    @property
    def keyword_index(self) -> KeywordIndex:
        """The stored keyword index over the documents, built when a session first asks for it."""
        return self._index("keyword-index", lambda: self.documents, "doc_id", {"text": plain_tokens(F.col("text"))})

    @property
    def chunk_index(self) -> KeywordIndex:
        """The stored index of chunks by two fields: the text without Markdown characters, and the line of keywords in it."""
        return self._index("chunk-index", lambda: self.chunks, "node_id", {"text": plain_tokens(clean_text(F.col("text"))), "keywords": plain_tokens(context_keywords(F.col("text")))})

    def kept(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several queries read, stored when a session first asks for it."""
        path = stored_once(self.spark, name, self.sf_dir, lambda path: rows().write.parquet(path))
        return self.spark.read.parquet(path)

    def old_text(self) -> Column:
        """The text an older version of the library held: unchanged, cut, longer, or with its middle replaced."""
        return F.expr("case doc_id % 5 when 0 then text when 1 then substring(text, 1, cast(length(text) div 2 as int)) when 2 then concat(text, ' appendix of the older version') when 3 then concat(substring(text, 1, 500), ' zz yy xx ', substring(text, 900, 100000000)) end")


#: The same tables for DuckDB, as common table expressions.
CTE: dict[str, str] = {
    "registry": """registry AS (SELECT doc_id,
  'library/' || source || '/doc' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' ELSE '-ds.pdf' END AS source,
  sha256(text) AS content_hash, n_chars AS size,
  sha256('library/' || source || '/doc' || doc_id || '|' || n_chars || '|' || (1700000000 + doc_id * 3600) || '|' || sha256(text)) AS metadata_hash,
  1700000000::DOUBLE + doc_id * 3600 AS modified_time, 1690000000::DOUBLE + doc_id * 60 AS created_at,
  1700000000::DOUBLE + (doc_id * 7919) % 100000 AS updated_at,
  CASE doc_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'updating' WHEN 2 THEN 'indexed' WHEN 3 THEN 'stale' ELSE 'corrupted' END AS state,
  doc_id % 3 <> 0 AS vector_indexed, doc_id % 4 <> 0 AS keyword_indexed,
  ceil(n_chars / 1000.0)::BIGINT AS chunk_count,
  (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS error_count,
  CASE WHEN doc_id % 7 = 0 THEN 'parse failed' END AS last_error,
  '{"source_type":"' || lang || '","file_size":' || n_chars || ',"parse_method":"' || CASE doc_id % 2 WHEN 0 THEN 'vision' ELSE 'text' END || '"}' AS metadata,
  'PM' || (doc_id % 50) || 'K' AS pair_model, (1000000 + doc_id)::VARCHAR AS pair_part,
  CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'kw' || (doc_id % 9) || ', ' || lang END AS keywords,
  lang, text FROM documents)""",
    "chunks": """chunks AS (SELECT doc_id, i AS chunk_index, ceil(length(text) / 1000.0)::BIGINT AS total_chunks,
  doc_id || '_' || i AS node_id, substring(text, (i * 1000 + 1)::BIGINT, 1000) AS text
  FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000.0)::BIGINT)) AS i FROM documents))""",
    "entries": """entries AS (WITH r AS (SELECT doc_id, unnest(range(0, ceil(n_chars / 1000.0)::BIGINT)) AS chunk_index FROM documents),
  e AS (SELECT doc_id, 'vector' AS index_type, chunk_index FROM r WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, 'keyword', chunk_index FROM r WHERE doc_id % 4 <> 0 AND doc_id % 10 <> 5
  UNION ALL SELECT doc_id + 1000000, 'vector', 0 FROM documents WHERE doc_id % 50 = 0)
  SELECT *, doc_id || '_' || chunk_index AS node_id FROM e)""",
    "fingerprints": """fingerprints AS (SELECT source, CASE WHEN doc_id % 5 < 3 THEN content_hash ELSE sha256(text || 'x') END AS content_hash,
  CASE WHEN doc_id % 7 IN (0, 6) AND doc_id % 5 < 3 AND doc_id % 11 <> 0 THEN metadata_hash ELSE sha256(metadata_hash || 'x') END AS metadata_hash,
  CASE doc_id % 7 WHEN 1 THEN size * 90 // 100 WHEN 2 THEN size * 70 // 100 WHEN 3 THEN size * 50 // 100 WHEN 4 THEN size * 5 // 100 WHEN 5 THEN size * 180 // 100 ELSE size END AS size,
  1700000000::DOUBLE + doc_id * 500 AS last_seen, 1690000000::DOUBLE + doc_id * 60 AS created_at, doc_id,
  CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 2 = 0 THEN 'processed' ELSE 'pending' END AS processing_status
  FROM registry WHERE doc_id % 6 <> 0)""",
    "jobs": """jobs AS (SELECT event_id AS job_id, 'library/src' || (user_id % 20) AS source,
  CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'remove' END AS job_type, event_id % 4 + 1 AS priority,
  u - 600 AS created_at, u AS updated_at, CASE WHEN event_type <> 'click' THEN u - (event_id % 500) END AS started_at,
  CASE WHEN event_type IN ('purchase', 'error') THEN u END AS completed_at,
  CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
  event_id % 5 AS retry_count, 3::BIGINT AS max_retries, 'w' || (user_id % 8) AS worker_id
  FROM (SELECT *, epoch_us(ts) / 1e6 AS u FROM events))""",
    "vectors": "vectors AS (SELECT vec_id AS id, embedding, label FROM embeddings)",
}


def with_tables(sql: str, *names: str) -> str:
    """A DuckDB query over derived tables."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + sql
