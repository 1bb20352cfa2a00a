"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

Words and pairs of words are counted over all training texts in tables partitioned by a hash of their key; a token's
probability is the pair's discounted estimate where the pair was seen, else the backoff weight of the word before times
the word's own discounted estimate, and so on down to the mass left for unknown words.  Texts travel once, as blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import buckets, document_blocks, pack_arrays, unpack_arrays, with_answers
from docweave.llm.common import word_keys

#: Key of a text's end, which counts as a word; its start is a history only.
END = np.uint64(0x454E44)
#: Counts up to this are discounted.
CUT = 5


@dataclass(frozen=True)
class KatzFit:
    """Fold that the model does not learn from, and the share of tokens from which a history's followers are dealt out.

    A word that makes up more than ``1 / hot`` of the training tokens has its followers dealt to ``salts`` buckets.
    """

    folds: int = 7
    held_out: int = 2
    hot: int = 2_000
    salts: int = 16


def tokens_of(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of all texts, A-Z lower-cased, an end behind each text, and the number of tokens of each."""
    words, before = word_keys(text.combine_chunks())
    sizes = np.diff(before) + 1
    out = np.insert(words, before[1:], END)
    return out, sizes


def _spread(key: np.ndarray, n: int) -> np.ndarray:
    return (((key ^ (key >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(33)) % np.uint64(n)


def discounts(number: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing discount of the counts 0 to CUT, from ``number[r]`` of kinds counted r times, r to CUT + 1.

    Where the ratios give no discount between 0 and 1 (few data) half a count is taken off.
    """
    n = np.asarray(number, float)
    d = np.ones(CUT + 1)
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d[r] = (ratio - tail) / (1 - tail) if tail < 1 else 0.0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = counts.astype(float)
    return c * d[np.where(counts <= CUT, counts, 0)]


def word_probability(counts: np.ndarray, d: np.ndarray, total: int, number: np.ndarray) -> np.ndarray:
    """Probability of words by their count; that of count 0 is the mass left for all unknown words together."""
    r = np.arange(1, CUT + 1)
    left = 1.0 + float((r * np.asarray(number[1 : CUT + 1], float) * (1 - d[1:])).sum())
    return np.where(counts > 0, discounted(counts, d), left) / (total + 1.0)


def _crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


class Block:
    """Tokens of a block's texts, as places in the table of its distinct words; the commonest words come first."""

    def __init__(self, payload: bytes):
        ids, sizes, teaches, self.at, self.keys = unpack_arrays(payload[1:], "<i8", "<u4", "u1", "<u4", "<u8")
        self.nulls = payload[:1] == b"n"
        self.doc_id = pa.array(ids, mask=teaches > 1) if self.nulls else pa.array(ids)
        self.teaches = (teaches & 1).astype(bool)
        self.sizes = sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = self.at.astype(np.int64)
        self.teach = np.repeat(self.teaches, self.sizes)
        self.before = np.empty_like(self.at)  # place of the word before, behind the last word for a text's start
        self.before[1:] = self.at[:-1]
        self.before[self.starts] = len(self.keys)


def pack_block(fit: KatzFit, table: pa.Table) -> bytes:
    ids = table["doc_id"].to_pylist()
    teaches = np.array([3 if i is None else _crc(i) % fit.folds != fit.held_out for i in ids], np.uint8)
    tokens, sizes = tokens_of(table["text"])
    keys, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(keys), "<u4")
    rank[order] = np.arange(len(keys))
    data = pack_arrays(np.array([i or 0 for i in ids], "<i8"), sizes.astype("<u4"), teaches, rank[place], keys[order].astype("<u8"))
    return (b"n" if None in ids else b"-") + data


def word_requests(blocks: DataFrame) -> DataFrame:
    """bucket, block_id, asked: keys of a block's distinct words and their counts in teaching texts."""
    n = buckets(blocks.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch.column("block_id").to_pylist(), batch.column("payload")):
                block = Block(payload.as_py())
                count = np.bincount(block.at[block.teach], minlength=len(block.keys)).astype("<u4")
                each = _split(_spread(block.keys, n))
                yield pa.RecordBatch.from_arrays([pa.array([*each], pa.int32()), pa.array([block_id] * len(each), pa.int64()), pa.array([pack_arrays(block.keys[p], count[p]) for p in each.values()], pa.binary())], names=["bucket", "block_id", "asked"])

    return blocks.mapInArrow(work, "bucket int, block_id bigint, asked binary")


def _split(home: np.ndarray) -> dict[int, np.ndarray]:
    """Places by bucket, in order within each."""
    order = np.argsort(home, kind="stable")
    kinds, starts = np.unique(home[order], return_index=True)
    return dict(zip(kinds.tolist(), np.split(order, starts[1:])))


def count_words(requests: DataFrame, n: int) -> DataFrame:
    """Adds up a bucket's words and numbers them; answers each block, and a row without block holds the bucket's counts
    of counts.  Numbers start at 1; no two words of all buckets share one."""

    def work(rows: pa.Table) -> pa.Table:
        bucket, asked = rows["bucket"][0].as_py(), [unpack_arrays(a, "<u8", "<u4") for a in rows["asked"].to_pylist()]
        keys, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.bincount(place, np.concatenate([a[1] for a in asked]), len(keys)).astype("<u8")
        number = np.empty(len(keys), "<u8")
        number[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(keys), dtype=np.uint64) * np.uint64(n) + np.uint64(bucket + 1)
        edges = np.cumsum([len(a[0]) for a in asked])[:-1]
        answers = [pack_arrays(total[p], number[p]) for p in np.split(place, edges)]
        low = np.bincount(total[(total > 0) & (total <= CUT + 1)].astype(int), minlength=CUT + 2)[: CUT + 2]
        stats = [int(total.sum()), int((total > 0).sum()), *low.tolist()]
        return pa.table({"bucket": pa.array([bucket] * (len(answers) + 1), pa.int32()), "block_id": pa.chunked_array([*rows["block_id"].chunks, pa.nulls(1, pa.int64())]), "words": pa.array([*answers, None], pa.binary()), "stats": pa.array([None] * len(answers) + [stats], pa.list_(pa.int64()))})

    return requests.groupBy("bucket").applyInArrow(work, "bucket int, block_id bigint, words binary, stats array<bigint>")


def _totals(answers: DataFrame, size: int, name: str) -> DataFrame:
    """The one row that sums the buckets' statistics."""
    return answers.where("block_id is null").agg(F.array(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(size)]).alias(name))


class Pairs:
    """Counts and numbers of a block's words, its distinct pairs by bucket and history, and what each bucket is asked.

    Numbers stand for words from here on; 0 is a text's start, which counts as often as the end.
    """

    def __init__(self, block: Block, given: dict[int, dict], total: int, n: int, fit: KatzFit):
        self.n, self.fit, k = n, fit, len(block.keys)
        self.counts, self.number = np.zeros(k + 1, np.int64), np.zeros(k + 1, np.int64)
        for b, p in _split(_spread(block.keys, n)).items():
            self.counts[p], self.number[p] = unpack_arrays(given[b]["words"], "<u8", "<u8")
        self.counts[k] = self.counts[:k][block.keys == END][0] if (block.keys == END).any() else 0
        key = block.before * (k + 1) + block.at
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        first = np.flatnonzero(new)
        self.place = np.empty(len(key), np.int64)  # of each token's pair
        self.place[order] = np.cumsum(new) - 1
        self.count = np.add.reduceat(block.teach[order].astype(np.int64), first)
        self.h, self.w = block.before[order[first]], block.at[order[first]]
        self.hot = self.counts > max(1, total // fit.hot)
        base = _spread(self.number.astype(np.uint64), n).astype(np.int64)
        salt = _spread(self.number[self.w].astype(np.uint64) + np.uint64(7), min(fit.salts, n)).astype(np.int64)
        bucket = (base[self.h] + np.where(self.hot[self.h], salt, 0)) % n
        self.asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # bucket: pairs in order of history, histories
        parts, hot = _split(bucket), np.flatnonzero(self.hot)
        everywhere = (base[hot][:, None] + np.arange(min(fit.salts, n))) % n
        for b in sorted({*parts, *everywhere.ravel().tolist()}):
            p = parts.get(b, np.zeros(0, np.int64))
            self.asked[b] = p, np.union1d(self.h[p], hot[(everywhere == b).any(1)])


def pair_requests(blocks: DataFrame, words: DataFrame, fit: KatzFit) -> DataFrame:
    """bucket, block_id, asked, g0: histories and their distinct followers with counts and the followers' own counts."""
    n = buckets(blocks.sparkSession)

    def work(block_id: int, payload: bytes, given: dict[int, dict]) -> pa.Table:
        g0 = next(iter(given.values()))["g0"]
        pairs, packed = Pairs(Block(payload), given, g0[0], n, fit), []
        for p, hist in pairs.asked.values():
            followers = np.searchsorted(pairs.h[p], hist, "right") - np.searchsorted(pairs.h[p], hist, "left")
            w = pairs.w[p]
            packed.append(pack_arrays(pairs.number[hist].astype("<u8"), followers.astype("<u4"), pairs.number[w].astype("<u8"), pairs.count[p].astype("<u4"), pairs.counts[w].astype("<u8")))
        each = [*pairs.asked]
        return pa.table({"bucket": pa.array(each, pa.int32()), "block_id": pa.array([block_id] * len(each), pa.int64()), "asked": pa.array(packed, pa.binary()), "g0": pa.array([g0] * len(each), pa.list_(pa.int64()))})

    return with_answers(blocks, words, work, "bucket int, block_id bigint, asked binary, g0 array<bigint>")


def count_pairs(requests: DataFrame) -> DataFrame:
    """Adds up a bucket's pairs; answers counts of pairs, and of each history how many followers were seen 1 to CUT times
    and the probability that the followers seen have as words."""

    def work(rows: pa.Table) -> pa.Table:
        bucket, g0 = rows["bucket"][0].as_py(), rows["g0"][0].as_py()
        asked = [unpack_arrays(a, "<u8", "<u4", "<u8", "<u4", "<u8") for a in rows["asked"].to_pylist()]
        hist = np.unique(np.concatenate([a[0] for a in asked]))
        h = np.concatenate([np.repeat(np.searchsorted(hist, a[0]), a[1]) for a in asked])
        w = np.concatenate([a[2] for a in asked])
        words, w = np.unique(w, return_inverse=True)
        key = h * max(1, len(words)) + w
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        first, place = order[new], np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        total = np.bincount(place, np.concatenate([a[3] for a in asked]), len(first)).astype("<u8")
        own = np.concatenate([a[4] for a in asked])[first].astype(np.int64)
        number = np.array(g0[2:], np.int64)
        p = word_probability(own, discounts(number), g0[0], number)
        seen = total > 0
        sums = np.bincount(h[first][seen], p[seen], len(hist))
        low = np.stack([np.bincount(h[first][total == r], minlength=len(hist)) for r in range(1, CUT + 1)], 1).astype("<u4")
        edges, answers = np.cumsum([len(a[2]) for a in asked])[:-1], []
        for a, part in zip(asked, np.split(place, edges)):
            at = np.searchsorted(hist, a[0])
            answers.append(pack_arrays(total[part].astype("<u4"), np.ascontiguousarray(low[at].T).ravel(), sums[at]))
        counts = np.bincount(total[seen & (total <= CUT + 1)].astype(int), minlength=CUT + 2)[: CUT + 2].tolist()
        return pa.table({"bucket": pa.array([bucket] * (len(answers) + 1), pa.int32()), "block_id": pa.chunked_array([*rows["block_id"].chunks, pa.nulls(1, pa.int64())]), "pairs": pa.array([*answers, None], pa.binary()), "stats": pa.array([None] * len(answers) + [counts], pa.list_(pa.int64()))})

    return requests.groupBy("bucket").applyInArrow(work, "bucket int, block_id bigint, pairs binary, stats array<bigint>")


def pair_scores(pairs: Pairs, got: np.ndarray, low: np.ndarray, sums: np.ndarray, g0: list[int], d1: np.ndarray) -> np.ndarray:
    """log10 of the Katz probability of each distinct pair of a block."""
    number = np.array(g0[2:], np.int64)
    alone = word_probability(pairs.counts, discounts(number), g0[0], number)
    often = pairs.counts.astype(float)
    left = (low * (np.arange(1, CUT + 1) * (1 - d1[1:]))).sum(1)
    whole = np.where(left > 0, often, often + 1)  # a history without low counts leaves one more count to the unseen
    weight = np.where(often > 0, np.where(left > 0, left, 1.0) / np.maximum(whole, 1) / np.maximum(1 - sums, 1e-300), 1.0)
    return np.log10(np.where(got > 0, discounted(got, d1) / np.maximum(whole[pairs.h], 1), weight[pairs.h] * alone[pairs.w]))


def score_documents(docs: DataFrame, fit: KatzFit = KatzFit()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    A null text is empty and consists of its end.  A null doc_id teaches and is not held out.  Rows repeat as in the
    input, an empty table gives none, further columns are ignored.  All unknown words share one probability, as in the
    base.  With nothing to learn from every token has probability 1.
    """
    n = buckets(docs.sparkSession)
    blocks = document_blocks(docs, pack=lambda table: pack_block(fit, table))
    counted = count_words(word_requests(blocks), n)
    words = counted.where("block_id is not null").select("bucket", "block_id", "words").crossJoin(F.broadcast(_totals(counted, CUT + 4, "g0")))
    paired = count_pairs(pair_requests(blocks, words, fit))
    pairs = paired.where("block_id is not null").select("bucket", "block_id", "pairs").crossJoin(F.broadcast(_totals(paired, CUT + 2, "g1")))
    both = words.withColumn("pairs", F.lit(None).cast("binary")).withColumn("g1", F.lit(None).cast("array<bigint>")).unionByName(pairs.withColumn("words", F.lit(None).cast("binary")).withColumn("g0", F.lit(None).cast("array<bigint>")).withColumn("bucket", F.col("bucket") + n))

    def work(_: int, payload: bytes, given: dict[int, dict]) -> pa.Table:
        words_given = {b: r for b, r in given.items() if b < n}
        pairs_given = {b - n: r for b, r in given.items() if b >= n}
        g0, g1 = next(iter(words_given.values()))["g0"], next(iter(pairs_given.values()))["g1"]
        block = Block(payload)
        p = Pairs(block, words_given, g0[0], n, fit)
        got, low, sums = np.zeros(len(p.h), np.int64), np.zeros((len(p.counts), CUT)), np.zeros(len(p.counts))
        for b, (part, hist) in p.asked.items():
            got[part], lows, mass = unpack_arrays(pairs_given[b]["pairs"], "<u4", "<u4", "<f8")
            low[hist] += lows.reshape(CUT, -1).T
            sums[hist] += mass
        katz = pair_scores(p, got, low, sums, g0, discounts(np.array(g1)))[p.place]
        base = np.log10((p.counts + 1.0) / (g0[0] + g0[1] + 1.0))[block.at]
        known = (p.counts > 0).astype(np.int64)[block.at]
        per = lambda x: pa.array(np.add.reduceat(x, block.starts))
        return pa.table({"doc_id": block.doc_id, "held_out": pa.array(~block.teaches), "n_tokens": pa.array(block.sizes), "n_known": per(known), "train_tokens": pa.array(np.full(len(block.sizes), g0[0], np.int64)), "base_score": per(base), "score": per(katz)})

    return with_answers(blocks, both, work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
