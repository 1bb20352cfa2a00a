"""Approximate nearest neighbours through learned partitions.

A bounded sample gives a neighbour graph; a balanced partitioning of that graph keeps neighbours together; a small
classifier learns to tell a vector's partition and routes each query to its most probable partitions, whose vectors
are then ranked exactly.  How many partitions a query visits is measured on held-out sample vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import only


@dataclass(frozen=True)
class AnnFit:
    """Bounds of the index; every row is indexed whatever the sample.

    ``sample`` vectors at most (by a hash of their ids) fit the partitions, one for about ``rows_per_part`` rows, at least
    ``least_parts`` where each gets 16 of the fitted vectors, and at most ``max_parts``; ``target`` is the recall that
    held-out sample vectors must reach with the visited partitions, which hold at least ``least_rows`` rows.  A block of one task holds about ``block_rows`` candidates and ``block_queries`` queries.
    """

    sample: int = 8_192
    rows_per_part: int = 4_000
    least_parts: int = 8
    max_parts: int = 256
    graph_degree: int = 16
    hidden: int = 64
    epochs: int = 30
    target: float = 0.96
    least_rows: int = 512
    block_rows: int = 8_192
    block_queries: int = 2_048
    seed: int = 11


def nearest_in(queries: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each query; ties go to earlier rows."""
    out = np.empty((len(queries), min(k, len(rows))), np.int64)
    for i in range(0, len(queries), 1024):
        out[i : i + 1024] = np.argsort(-(queries[i : i + 1024] @ rows.T), axis=1, kind="stable")[:, :k]
    return out


def balanced_partition(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 11) -> np.ndarray:
    """Labels of a neighbour graph's nodes: equal bisections first, then moves that save cut edges within the slack."""
    n, rng = len(vectors), np.random.default_rng(seed)
    labels = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            labels[rows] = first
            continue
        left = count // 2
        axis = vectors[rows[rng.integers(len(rows))]] - vectors[rows[rng.integers(len(rows))]]
        for _ in range(4):  # power steps towards the main direction of the part
            axis = vectors[rows].T @ (vectors[rows] @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        order = rows[np.argsort(vectors[rows] @ axis, kind="stable")]
        at = len(rows) * left // count
        todo += [(order[:at], first, left), (order[at:], first + left, count - left)]
    cap = int(np.ceil(slack * n / parts))
    sizes = np.bincount(labels, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), labels[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(labels, graph.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), labels]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < cap:
                sizes[labels[i]] -= 1
                sizes[best[i]] += 1
                labels[i] = best[i]
                moved += 1
        if not moved:
            break
    return labels


class Router:
    """One hidden layer and a softmax over the partitions."""

    def __init__(self, dim: int, parts: int, fit: AnnFit):
        rng = np.random.default_rng(fit.seed)
        self.parts, self.probes, self.counts, self.least_rows = parts, parts, np.zeros(parts, np.int64), fit.least_rows
        self.w = [rng.normal(0, dim**-0.5, (dim, fit.hidden)), np.zeros(fit.hidden), rng.normal(0, fit.hidden**-0.5, (fit.hidden, parts)), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-30) * np.sqrt(x.shape[1])
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        return h, h @ self.w[2] + self.w[3]

    def train(self, x: np.ndarray, goal: np.ndarray, fit: AnnFit) -> None:
        """Adam on the cross-entropy with soft goals: where a vector and its neighbours lie."""
        rng, scaled = np.random.default_rng(fit.seed), x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-30) * np.sqrt(x.shape[1])
        m, v = ([np.zeros_like(w) for w in self.w] for _ in range(2))
        t = 0
        for epoch in range(fit.epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                pick, t = order[i : i + 256], t + 1
                h, z = self.logits(x[pick])
                p = np.exp(z - z.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - goal[pick]) / len(pick)
                dh = (d @ self.w[2].T) * (h > 0)
                for j, g in enumerate((scaled[pick].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] -= 0.01 * (1 - epoch / fit.epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-9)

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x)[1].argmax(1)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each query, most probable first."""
        return np.argsort(-self.logits(x)[1], axis=1, kind="stable")

    def visits(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """The partitions a query visits: ``probes``, and more where these hold too few rows."""
        out = []
        for row in self.ranked(x):
            held = np.cumsum(self.counts[row])
            out.append(row[: max(self.probes, int(np.searchsorted(held, min(max(k + 1, self.least_rows), held[-1]))) + 1)])
        return out


def usable(vec: Column, dim: int) -> Column:
    """Of the dimension asked for, finite, without nulls, not zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & fine & F.exists(vec, lambda v: v != 0)


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part, of the commonest dimension."""
    rows = only(embeddings, "vec_id", "embedding").selectExpr("cast(vec_id as bigint) vec_id", "cast(embedding as array<double>) vec").where("vec_id is not null and vec is not null")
    top = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(usable(F.col("vec"), top["dim"] if top else 0))


def fit_router(rows: DataFrame, k: int, fit: AnnFit = AnnFit()) -> Router | None:
    """Fit partitions and router on the bounded sample and measure how many partitions to visit; None without rows."""
    n = rows.count()
    if not n:
        return None
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < min(1.0, fit.sample / n) * 1_000_003).orderBy("vec_id").limit(2 * fit.sample).toArrow()
    vectors = np.array(picked["vec"].to_pylist(), float) if picked.num_rows else np.array([rows.first()["vec"]])
    half = len(vectors) // 2
    parts = int(np.clip(max(round(n / fit.rows_per_part), fit.least_parts), 1, min(fit.max_parts, max(1, half // 16))))
    router = Router(vectors.shape[1], parts, fit)
    if parts > 1:
        learn, check = vectors[::2], vectors[1::2]
        graph = nearest_in(learn, learn, fit.graph_degree + 1)[:, 1:]
        labels = balanced_partition(learn, graph, parts, seed=fit.seed)
        goal = np.zeros((len(learn), parts))
        np.add.at(goal, (np.arange(len(learn)), labels), 4.0)
        np.add.at(goal, (np.repeat(np.arange(len(learn)), graph.shape[1]), labels[graph].ravel()), 1.0)
        router.train(learn, goal / goal.sum(1, keepdims=True), fit)
        near = nearest_in(check[:1024], check, k + 1)[:, 1:]
        home, ranked = router.part(check), router.ranked(check[:1024])
        place = np.argsort(ranked, axis=1)  # of each partition in a query's order
        at = np.take_along_axis(place, home[near], 1)
        router.probes = int(next(m for m in range(1, parts + 1) if (at < m).mean() >= min(fit.target, 1.0)))
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float)


def rank_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> list[tuple]:
    """(query, vector, score) of each query's k best in a block, equal scores by vector id.

    The product of matrices only finds candidates; scores are sums over one pair, so equal vectors score the same.
    """
    order = np.argsort(vid, kind="stable")
    vid, v = vid[order], v[order]
    rough, out = q @ v.T, []
    rough[qid[:, None] == vid[None, :]] = -np.inf
    take = min(k, len(vid))
    margin = 1e-9 * (np.abs(rough[np.isfinite(rough)]).max() if np.isfinite(rough).any() else 1.0)
    least = np.partition(rough, len(vid) - take, axis=1)[:, len(vid) - take]
    for i in range(len(qid)):
        near = np.flatnonzero((rough[i] >= least[i] - margin) & np.isfinite(rough[i]))
        score = (q[i] * v[near]).sum(1)
        best = np.lexsort((vid[near], -score))[:k]
        out += [(int(qid[i]), int(vid[near[b]]), float(score[b])) for b in best]
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = 20, fit: AnnFit = AnnFit()) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest among the visited partitions of all rows.

    ``rows`` and ``queries`` hold vec_id and vec as ``usable_rows`` gives them.  The query's own id is no candidate.  With
    fewer candidates all are returned; equal scores go to the smaller vec_id, also between copies.  A partition, however
    full, is dealt out in blocks of bounded size, candidates by queries, so copies of one vector burden no single task.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    router = fit_router(rows, k, fit)
    if router is None:
        return empty
    shared = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.part(_matrix(b.column("vec"))).astype(np.int32))], names=["vec_id", "vec", "part"])

    placed = rows.select("vec_id", "vec").mapInArrow(place, "vec_id bigint, vec array<double>, part int")
    for r in placed.groupBy("part").count().collect():  # a row for each partition
        router.counts[r["part"]] = r["count"]
    routes = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                visits = routes.value.visits(_matrix(b.column("vec")), k)
                again = np.repeat(np.arange(b.num_rows), [len(x) for x in visits])
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(again)).columns, pa.array(np.concatenate(visits).astype(np.int32))], names=["vec_id", "vec", "part"])

    asked = queries.select("vec_id", "vec").mapInArrow(route, "vec_id bigint, vec array<double>, part int")
    wanted = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = [max(1, -(-int(c) // fit.block_rows)) for c in router.counts]
    chunks = [max(1, -(-wanted.get(p, 0) // fit.block_queries)) for p in range(router.parts)]
    of = lambda sizes: F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("part") + 1)
    own = lambda sizes: F.pmod(F.xxhash64("vec_id"), of(sizes)).cast("int")
    each = lambda sizes: F.explode(F.sequence(F.lit(0), of(sizes) - 1))
    left = asked.withColumn("chunk", own(chunks)).withColumn("block", each(blocks))
    right = placed.withColumn("block", own(blocks)).withColumn("chunk", each(chunks))

    def rank(q: pa.Table, v: pa.Table) -> pa.Table:
        found = rank_block(q["vec_id"].to_numpy(), _matrix(q["vec"]), v["vec_id"].to_numpy(), _matrix(v["vec"]), k) if q.num_rows and v.num_rows else []
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    key = ["part", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(embeddings: DataFrame, every: int = 20, k: int = 20, fit: AnnFit = AnnFit()) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``every``, among all usable rows.

    Rows without id, and vectors that are null, zero, of another dimension or hold null or non-finite components, take no
    part.  Of several vectors of one id the least is the query; all are candidates of other ids.  An empty table gives no
    rows, and further columns are ignored.
    """
    rows = usable_rows(embeddings)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return search(rows, queries, k, fit)
