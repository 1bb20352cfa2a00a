"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks that cover the whole document, each filter keeps its
highest response, and a small dense layer turns these into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import discard, only, remainder, small_batches, stored


@dataclass(frozen=True)
class CnnFit:
    """Shape of the network and bounds of the sample it is fitted on.

    About ``docs_per_label`` documents of each label, picked by a hash of their ids, teach with their whole texts, as far as
    these have at most ``longest`` bytes each and, in the order of the hash, ``sample_bytes`` in all.  So what the driver
    holds is bounded; texts of any length are scored whole.  Chunks are two ``half``-byte halves, so each byte lies in two
    chunks.
    """

    docs_per_label: int = 1_200
    longest: int = 256 << 10
    sample_bytes: int = 64 << 20
    half: int = 16
    width: int = 8
    filters: int = 32
    hidden: int = 16
    epochs: int = 14
    batch: int = 32
    rate: float = 0.004
    seed: int = 7


class ByteCnn:
    """The network's weights, and its scores of texts."""

    def __init__(self, fit: CnnFit):
        rng = np.random.default_rng(fit.seed)
        self.half, self.filters = fit.half, fit.filters
        self.w = {
            "emb": rng.normal(0, 0.5, (256, fit.width)).astype(np.float32),
            "conv": rng.normal(0, (fit.half * fit.width) ** -0.5, (fit.half * fit.width, 2 * fit.filters)).astype(np.float32),
            "cb": np.zeros(fit.filters, np.float32),
            "h": rng.normal(0, fit.filters**-0.5, (fit.filters, fit.hidden)).astype(np.float32),
            "hb": np.zeros(fit.hidden, np.float32),
            "o": rng.normal(0, fit.hidden**-0.5, fit.hidden).astype(np.float32),
            "ob": np.zeros(1, np.float32),
        }
        self.shift = 0.0  # from the balanced sample to the labels' own share

    def halves(self, text: bytes) -> np.ndarray:
        """The text's bytes, padded with zeros to two halves at least."""
        n = max(2, -(-len(text) // self.half))
        return np.frombuffer(text.ljust(n * self.half, b"\0"), np.uint8).reshape(n, self.half)

    def _respond(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.w["emb"][halves].reshape(len(halves), -1)
        y = a @ self.w["conv"]
        return a, y[:-1, : self.filters] + y[1:, self.filters :]

    def _pooled(self, text: bytes, block: int = 1 << 13) -> np.ndarray:
        """Highest responses over the whole text, worked through in blocks of bounded size."""
        halves = self.halves(text)
        top = np.full(self.filters, -np.inf, np.float32)
        for i in range(0, len(halves) - 1, block):
            np.maximum(top, self._respond(halves[i : i + block + 1])[1].max(0), out=top)
        return np.maximum(top + self.w["cb"], 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1; many short texts share one product of matrices."""
        pooled = np.zeros((len(texts), self.filters), np.float32)
        group, size = [], 0
        for i, t in enumerate([*texts, None]):
            if group and (t is None or size + len(t) > 1 << 17):
                parts = [self.halves(texts[j]) for j in group]
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                both = self._respond(np.concatenate([*parts, parts[-1][:1]]))[1]
                both[starts[1:-1] - 1] = -np.inf  # chunks across two texts
                both[-1] = -np.inf
                pooled[group] = np.maximum(np.maximum.reduceat(both, starts[:-1], axis=0) + self.w["cb"], 0)
                group, size = [], 0
            if t is not None and len(t) > 1 << 17:
                pooled[i] = self._pooled(t)
            elif t is not None:
                group.append(i)
                size += len(t)
        hid = np.maximum(pooled @ self.w["h"] + self.w["hb"], 0)
        return 1 / (1 + np.exp(-(hid @ self.w["o"] + self.w["ob"][0] + self.shift).astype(np.float64)))

    def step(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over a batch."""
        w, parts = self.w, [self.halves(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        halves = np.concatenate([*parts, parts[-1][:1]])
        a, both = self._respond(halves)
        both[starts[1:] - 1] = -np.inf
        place = np.stack([both[s : e - 1].argmax(0) + s for s, e in zip(starts[:-1], starts[1:])])
        top = np.take_along_axis(both, place, 0) + w["cb"]
        pooled = np.maximum(top, 0)
        pre = pooled @ w["h"] + w["hb"]
        hid = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-(hid @ w["o"] + w["ob"][0])))
        d = ((p - labels) / len(texts)).astype(np.float32)
        g = {"o": hid.T @ d, "ob": np.array([d.sum()], np.float32)}
        dh = np.outer(d, w["o"]) * (pre > 0)
        g |= {"h": pooled.T @ dh, "hb": dh.sum(0)}
        dt = (dh @ w["h"].T) * (top > 0)
        g["cb"] = dt.sum(0)
        g["conv"], g["emb"] = np.zeros_like(w["conv"]), np.zeros_like(w["emb"])
        da = np.zeros((len(halves), a.shape[1]), np.float32)
        for f in range(self.filters):
            at, v = place[:, f], dt[:, f]
            g["conv"][:, f] = v @ a[at]
            g["conv"][:, self.filters + f] = v @ a[at + 1]
            np.add.at(da, at, v[:, None] * w["conv"][:, f])
            np.add.at(da, at + 1, v[:, None] * w["conv"][:, self.filters + f])
        used = np.unique(np.concatenate([place.ravel(), place.ravel() + 1]))
        np.add.at(g["emb"], halves[used].ravel(), da[used].reshape(-1, w["emb"].shape[1]))
        return g


def train(texts: list[bytes], labels: np.ndarray, share: float, fit: CnnFit = CnnFit()) -> ByteCnn:
    """Adam on the bounded sample; ``share`` is the share of label 1 among all labelled rows."""
    net, rng = ByteCnn(fit), np.random.default_rng(fit.seed)
    labels = np.asarray(labels, np.float32)
    if not len(texts) or not 0 < share < 1:
        net.w["o"][:] = 0
        net.shift = 4.0 if share >= 0.5 else -4.0
        return net
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    t = 0
    order = np.arange(len(texts))
    for epoch in range(fit.epochs):
        rng.shuffle(order)
        rate = fit.rate * (1 - epoch / fit.epochs)
        for i in range(0, len(order), fit.batch):
            pick, t = order[i : i + fit.batch], t + 1
            for k, g in net.step([texts[j] for j in pick], labels[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
    seen = float(labels.mean())
    net.shift = float(np.log(share / (1 - share)) - np.log(seen / (1 - seen))) if 0 < seen < 1 else 0.0
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, fit: CnnFit = CnnFit()) -> ByteCnn:
    """Fit on a bounded sample of the labelled documents given; rows without text or label teach nothing.

    Of labels that contradict each other 1 counts; of rows that repeat a doc_id the one of the least text teaches.
    """
    marks = only(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    bound = F.when(F.col("quality") == 1, min(1.0, fit.docs_per_label / max(1, sizes.get(1, 0)))).otherwise(min(1.0, fit.docs_per_label / max(1, sizes.get(0, 0))))
    picked = marks.where(rank < bound * 1_000_003)
    texts = only(docs, "doc_id", "text").where("text is not null")
    texts = texts.where(F.octet_length("text") <= fit.longest).join(F.broadcast(picked), "doc_id")  # some 2,400 ids
    rows = stored(texts.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text")), "quality-sample")
    sizes, load, least = rows.select("doc_id", rank.alias("rank"), F.octet_length("text").alias("bytes")).collect(), 0, []
    for r in sorted(sizes, key=lambda r: (r["rank"], r["doc_id"])):
        load += r["bytes"]
        least += [r["doc_id"]] if load <= fit.sample_bytes else []
    got = (rows if len(least) == len(sizes) else rows.where(F.col("doc_id").isin(least))).orderBy("doc_id").toArrow().to_pydict()
    discard(rows)
    return train([t.encode() for t in got["text"]], np.array(got["quality"]), share, fit)


def score_quality(docs: DataFrame, net: ByteCnn) -> DataFrame:
    """doc_id and score of every whole text; null counts as empty, rows repeat as given, other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 256, 1 << 20):
            found = shared.value.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = only(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(work, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, fit: CnnFit = CnnFit(), folds: int = 5, held_out: int = 0, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: fit outside the held-out fold, score all.

    A null doc_id belongs to neither fold.  Null and empty texts get the score of an empty text, repeated rows one row
    each, an empty table none; without labels of both kinds all scores say which kind there is.  Further columns, whatever
    their names, are ignored.
    """
    fold = remainder(F.col("doc_id"), folds)
    net = fit_quality(docs, only(labels, "doc_id", "quality").where(fold != held_out), fit)
    scored = score_quality(docs, net)
    return scored.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
