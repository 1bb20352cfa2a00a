"""Keyword, phrase and vector retrieval over plain tables: postings in, ranked hits out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import STOP_WORDS, tokenize
from docweave.operators.postings import DIGITS, IDF_FLOOR, K1, B, KeywordIndex, Term


def term_frequencies(nodes: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf)."""
    return nodes.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def node_lengths(nodes: DataFrame, key: str, tokens: Column) -> DataFrame:
    return nodes.select(key, F.size(tokens).cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of nodes and mean length."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(query: str) -> list[str]:
    """Tokens of a query, by the rule of the index."""
    import re

    return [t for t in re.findall(r"\w+", query.lower()) if len(t) > 2 and t not in STOP_WORDS]


def _matched(nodes: DataFrame, key: str, terms: list[str], tokens: Column) -> DataFrame:
    """Postings of the query's terms with lengths and corpus statistics; only those terms are ever exploded."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)]) if terms else F.array().cast("array<string>")
    tokenized = nodes.select(key, tokens.alias("_tokens"))
    lengths = tokenized.select(key, F.size("_tokens").cast("bigint").alias("dl"), F.filter("_tokens", lambda t: F.array_contains(wanted, t)).alias("_hits"))
    stats = corpus_stats(lengths)
    hits = lengths.select(key, "dl", F.explode("_hits").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))


def _terms(words: list[str]) -> list[Term]:
    """A term for each distinct word, which counts as often as it is there."""
    return [Term(w, (w,), float(words.count(w))) for w in dict.fromkeys(words)]


def bm25(nodes: DataFrame | KeywordIndex, key: str, text: str, query: str) -> DataFrame:
    """(key, score): nodes with any query term; a term counts as often as the query repeats it.

    ``nodes`` is a stored index, or a table whose ``text`` is searched without one.
    """
    terms = query_terms(query)
    if isinstance(nodes, KeywordIndex):
        return nodes.scored(_terms(terms), every_word=False, every_term=False).select(F.col("key").alias(key), F.col("gain").alias("score")).where("score > 0")
    weight = F.create_map(*[F.lit(x) for t in dict.fromkeys(terms) for x in (t, float(terms.count(t)))]) if terms else F.create_map().cast("map<string,double>")
    m = _matched(nodes, key, terms, tokenize(F.col(text)))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return m.groupBy(key).agg(F.round(F.sum(weight[F.col("term")] * part), DIGITS).alias("score")).where("score > 0")


def bm25_top(index: KeywordIndex, key: str, query: str, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """(key, score, rank): the first hits of ``bm25``, read best first from the index; ``allowed`` (key) are all that count."""
    hits = index.best(_terms(query_terms(query)), limit, every_word=False, every_term=False, allowed=allowed)
    return hits.select(F.col("key").alias(key), F.col("gain").alias("score"), "rank")


def fts_scores(nodes: DataFrame | KeywordIndex, key: str, tokens: Column, terms: list[str], every: bool = True) -> DataFrame:
    """(key, score) with better scores more negative; ``every``: all terms must occur.

    Frequent terms, whose weight would not be positive, weigh next to nothing.
    """
    if isinstance(nodes, KeywordIndex):
        return nodes.scored(_terms(list(dict.fromkeys(terms))), True, every).select(F.col("key").alias(key), (-F.col("gain")).alias("score"))
    m = _matched(nodes, key, terms, tokens)
    part = _fts_idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = m.groupBy(key).agg(F.round(-F.sum(part), DIGITS).alias("score"), F.count("*").alias("found"))
    return (scored.where(F.col("found") == len(dict.fromkeys(terms))) if every else scored).drop("found")


def _fts_idf(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(IDF_FLOOR)


def fts_top(index: KeywordIndex, key: str, words: list[str], limit: int, every: bool = True, stems: bool = False, weights: dict[str, float] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(key, score, rank): the first hits of a full-text search, better scores more negative.

    ``stems``: words match by their stems; ``weights``: how much occurrences in each field count, and which fields do.
    """
    terms = index.stemmed(words) if stems else _terms(list(dict.fromkeys(words)))
    hits = index.best(terms, limit, True, every, weights, allowed)
    return hits.select(F.col("key").alias(key), (-F.col("gain")).alias("score"), "rank")


def plain_tokens(text: Column) -> Column:
    """All lower-case word tokens, stop words and short ones too."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def phrase_hits(nodes: DataFrame | KeywordIndex, key: str, text: str, phrase: str, limit: int, stems: bool = False) -> DataFrame:
    """Nodes that hold the phrase's words one behind the other, by the phrase's full-text score: key, occurrences, rank, score.

    ``stems``, for an index: words match by their stems.
    """
    import re

    words = re.findall(r"\w+", phrase.lower())
    if isinstance(nodes, KeywordIndex):
        hits = nodes.phrase(key, [Term(t.name, t.words) for w in words for t in nodes.stemmed([w])] if stems else [Term(w, (w,)) for w in words])
    else:
        tokens = nodes.select(key, plain_tokens(F.col(text)).alias("_tokens"))
        at = lambda i: F.slice("_tokens", i, F.lit(len(words)))
        times = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("_tokens"), F.lit(1))), lambda i: at(i) == F.array(*[F.lit(w) for w in words])))
        counted = tokens.select(key, F.size("_tokens").alias("dl"), times.cast("bigint").alias("occurrences"))
        known = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.count_if(F.col("occurrences") > 0).alias("df"))
        part = _fts_idf(F.col("n"), F.col("df")) * F.col("occurrences") * (K1 + 1) / (F.col("occurrences") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        hits = counted.where("occurrences > 0").crossJoin(F.broadcast(known)).select(key, "occurrences", F.round(part, DIGITS).alias("gain"))  # one row
    return top(hits, key, F.desc("gain"), limit).select(key, "occurrences", "rank", (1.0 / (F.col("rank") + 1)).alias("score"))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm)


def vector_scores(vectors: DataFrame, key: str, vector: str, query: DataFrame) -> DataFrame:
    """(key, score) against a one-row query table whose column is ``query``; the query's norm is worked out once."""
    one = query.select(F.col("query").cast("array<double>").alias("_q")).withColumn("_norm", F.sqrt(_dot(F.col("_q"), F.col("_q"))))
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("_v")).crossJoin(F.broadcast(one))
    norm = F.sqrt(_dot(F.col("_v"), F.col("_v"))) * F.col("_norm")
    return rows.select(key, F.when(norm > 0, _dot(F.col("_v"), F.col("_q")) / norm).alias("score")).where("score is not null")


def top(hits: DataFrame, key: str, order: Column, limit: int) -> DataFrame:
    """The first ``limit`` hits with their rank from 1; ties go by key.  The cut comes before the ranking."""
    cut = hits.orderBy(order, key).limit(limit)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(order, key)).cast("bigint"))
