"""Fusion of a vector hit list and a keyword hit list, each (id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.retrieval import top

#: Constant of reciprocal ranks, weights, and the bonus of a hit in both lists.
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT, BOTH_BONUS = 60, 0.7, 0.3, 1.1
#: Terms that mark a technical query.
TECHNICAL = ("sensor", "laser", "power", "wavelength", "calibration", "measurement")


def _merge(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """id, v, vr, k, kr: the lists' scores and ranks side by side."""
    return vector.select("id", F.col("score").alias("v"), F.col("rank").alias("vr")).join(keyword.select("id", F.col("score").alias("k"), F.col("rank").alias("kr")), "id", "full_outer")


def _ranked(fused: DataFrame, limit: int) -> DataFrame:
    return top(fused, "id", F.desc("fused"), limit).select("id", "fused", "rank")


def rrf(vector: DataFrame, keyword: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Sum of reciprocal ranks; both ranks and the kind of match are kept."""
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    kind = F.when(F.col("kr").isNull(), "vector").when(F.col("vr").isNull(), "keyword").otherwise("hybrid")
    m = _merge(vector, keyword).select("id", (part("vr") + part("kr")).alias("fused"), F.col("vr").alias("vector_rank"), F.col("kr").alias("keyword_rank"), kind.alias("search_type"))
    return top(m, "id", F.desc("fused"), limit)


def _normalised(hits: DataFrame) -> DataFrame:
    """With any negative score min-max (a flat list gives 0.5), else divided by the largest (0 if that is not positive)."""
    stats = hits.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    ranged = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    scaled = F.when(F.col("hi") > 0, F.col("score") / F.col("hi")).otherwise(0.0)
    return hits.crossJoin(F.broadcast(stats)).withColumn("score", F.when(F.col("lo") < 0, ranged).otherwise(scaled)).drop("lo", "hi")


def _weigh(m: DataFrame, v: Column | float, k: Column | float) -> DataFrame:
    v, k = (x if isinstance(x, Column) else F.lit(x) for x in (v, k))
    total = v * F.coalesce("v", F.lit(0.0)) + k * F.coalesce("k", F.lit(0.0))
    return m.withColumn("fused", F.when(F.col("v").isNotNull() & F.col("k").isNotNull(), total * BOTH_BONUS).otherwise(total))


def flip(hits: DataFrame) -> DataFrame:
    """Scores of which less is better, turned round."""
    return hits.withColumn("score", -F.col("score"))


def weighted(vector: DataFrame, keyword: DataFrame, limit: int, v: float = VECTOR_WEIGHT, k: float = KEYWORD_WEIGHT, compat: bool = False) -> DataFrame:
    """Weighted sum of normalised scores; ``compat`` takes keyword scores as they come, best most negative."""
    return _ranked(_weigh(_merge(_normalised(vector), _normalised(keyword if compat else flip(keyword))), v, k), limit)


def overlap(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """One row: nodes in both lists, in either, and their ratio."""
    m = _merge(vector, keyword).agg(F.count_if(F.col("v").isNotNull() & F.col("k").isNotNull()).alias("both_lists"), F.count("*").alias("any_list"))
    return m.withColumn("ratio", F.when(F.col("any_list") > 0, F.col("both_lists") / F.col("any_list")).otherwise(0.0))


def adaptive(vector: DataFrame, keyword: DataFrame, query: str, limit: int) -> DataFrame:
    """Weights by the query's kind and the lists' overlap, then weighted fusion."""
    ratio, words = F.col("ratio"), query.split()
    if any(c.isdigit() for c in query) or len(words) <= 2:
        v, k = 0.3 + ratio * 0.2, 0.7 - ratio * 0.2
    elif any(t in query.lower() for t in TECHNICAL) and len(words) > 3:
        v, k = 0.8 - ratio * 0.1, 0.2 + ratio * 0.1
    else:
        v, k = F.lit(0.6), F.lit(0.4)
    m = _merge(_normalised(vector), _normalised(flip(keyword))).crossJoin(F.broadcast(overlap(vector, keyword).select("ratio")))
    return _ranked(_weigh(m, v, k), limit)


def alpha(vector: DataFrame, keyword: DataFrame, limit: int, a: float = 0.5, compat: bool = False) -> DataFrame:
    """alpha x vector score by its maximum + (1 - alpha) x keyword score by its maximum.

    ``compat`` divides the size of negative keyword scores by their largest, hence negative, value.
    """
    hi = lambda hits, name: hits.agg(F.max("score").alias(name))
    k = keyword if compat else flip(keyword)
    m = _merge(vector, k).crossJoin(F.broadcast(hi(vector, "vmax"))).crossJoin(F.broadcast(hi(k, "kmax")))
    fused = a * F.coalesce(F.col("v") / F.col("vmax"), F.lit(0.0)) + (1 - a) * F.coalesce(F.abs("k") / F.col("kmax"), F.lit(0.0))
    return _ranked(m.withColumn("fused", fused), limit)


def relative(vector: DataFrame, keyword: DataFrame, limit: int) -> DataFrame:
    """Each list min-max normalised (flat: 1 if positive, else 0); a hit in both gets the mean."""

    def spread(hits: DataFrame) -> DataFrame:
        stats = hits.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        flat = F.when(F.col("hi") > 0, 1.0).otherwise(0.0)
        return hits.crossJoin(F.broadcast(stats)).withColumn("score", F.when(F.col("hi") == F.col("lo"), flat).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")

    m = _merge(spread(vector), spread(flip(keyword)))
    fused = F.when(F.col("v").isNotNull() & F.col("k").isNotNull(), (F.col("v") + F.col("k")) / 2).otherwise(F.coalesce("v", "k"))
    return _ranked(m.withColumn("fused", fused), limit)


def rank_weighted(vector: DataFrame, keyword: DataFrame, limit: int) -> DataFrame:
    """0.7 x vector score + 0.3 / keyword rank, divided by the largest sum."""
    m = _merge(vector, keyword).withColumn("fused", VECTOR_WEIGHT * F.coalesce("v", F.lit(0.0)) + F.coalesce(KEYWORD_WEIGHT / F.col("kr"), F.lit(0.0)))
    most = m.agg(F.max("fused").alias("most"))
    return _ranked(m.crossJoin(F.broadcast(most)).withColumn("fused", F.col("fused") / F.col("most")), limit)
