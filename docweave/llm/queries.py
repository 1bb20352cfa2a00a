"""The queries of this package's operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docweave.llm.ann import nearest_neighbours
from docweave.llm.bpe import encode_and_decode
from docweave.llm.common import table
from docweave.llm.katz import score_documents
from docweave.llm.langid import language_predictions
from docweave.llm.lexical import rank_documents
from docweave.llm.ngram_join import jaccard_components
from docweave.llm.packing import pack
from docweave.llm.quality_cnn import quality_scores
from docweave.llm.quality_rules import repetition_coverage
from docweave.llm.sharding import sharding_report
from docweave.llm.token_output import token_file_report
from docweave.llm.url_filter import filter_urls
from docweave.llm.whitening import whiten

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to ORC and read back; a null text has the end id alone, repeated rows repeat, an empty table gives none."""
    return token_file_report(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents; a null or empty text is its own, a null doc_id names none."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector; vectors that are null, zero or not finite take no part."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page; a null url is allowed, repeated rows repeat."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; null and letterless texts are ``und``, a null doc_id is not held out."""
    return language_predictions(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every text, null and empty ones too; a null doc_id is not held out."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of the text decoded from them; a null text is empty, repeated rows repeat."""
    return encode_and_decode(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of every text in exactly one piece; a null text has its end id alone."""
    return pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every text; a null text has its end alone, a null doc_id teaches."""
    return score_documents(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text; a null text has no words and fails."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return repetition_coverage(table(spark, sf_dir, "documents")).select(*columns)


def op11_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a slot of one of 16 shards, read back from the shards' files; null texts have size 1."""
    return sharding_report(table(spark, sf_dir, "documents"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every vector; vectors that are null or not finite take no part."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item; null texts are never found and find nothing."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_ngram_join,
        op3_learned_partitions,
        op4_url_filter,
        op5_language_id,
        op6_quality_classifier,
        op7_bpe,
        op8_lexical_packing,
        op9_katz_backoff,
        op10_quality_rules,
        op11_feistel_sharding,
        op12_exact_whitening,
        op13_block_max_maxscore,
    )
}

_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JOIN_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), e AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
 t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
 SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""

_SHARES = {3: 0.50, 5: 0.40, 8: 0.30, 12: 0.28}
_GRAMS = ", ".join(f"array_to_string(w[i + 1:i + {k}], ' ') AS g{k}" for k in _SHARES)
_AGAIN = ", ".join(f"CASE WHEN i + {k} <= n AND count(*) OVER (PARTITION BY doc_id, g{k}, i + {k} <= n) > 1 THEN 1 ELSE 0 END AS a{k}" for k in _SHARES)
_COVER = ", ".join(f"max(a{k}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}" for k in _SHARES)
_WITHIN = " AND ".join(f"coalesce(sum(z) FILTER (c{k} = 1), 0)::DOUBLE / sum(z) <= {share}" for k, share in _SHARES.items())

_RULES_SQL = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
 u AS (SELECT doc_id, len(w) AS n, i, length(w[i + 1]) AS z, {_GRAMS} FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w)),
 a AS (SELECT doc_id, i, z, {_AGAIN} FROM u), c AS (SELECT doc_id, z, {_COVER} FROM a),
 g AS (SELECT doc_id, sum(z)::BIGINT AS word_chars, sum(c8)::BIGINT AS n_repeat_words, {_WITHIN} AS fine FROM c GROUP BY doc_id),
 l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) - sum(length(line)) FILTER (first) AS dup FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) = 1 AS first FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORDS}')) GROUP BY doc_id),
 x AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(fine, true) AND coalesce(dup, 0)::DOUBLE / greatest(1, length(text)) <= 0.30 AS fine FROM w LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, fine AND NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS kept FROM x"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_SEARCH_SQL = f"""WITH d AS (SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents)),
 c AS (SELECT count(*) FILTER (n > 0)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d), p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, c),
 i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)) AS i FROM p, c),
 s AS (SELECT item_id, doc_id, sum(w * i)::BIGINT AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY item_id, doc_id HAVING sum(w * i) > 0)
 SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""

#: SQL for the operators that SQL expresses whole; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op2_ngram_join": _JOIN_SQL, "op10_quality_rules": _RULES_SQL, "op13_block_max_maxscore": _SEARCH_SQL}
