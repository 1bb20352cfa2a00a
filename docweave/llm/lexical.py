"""Ranked lexical search with a sharded inverted index and Block-Max MaxScore.

Each task turns the documents of its part of the table into shards: a shard holds the documents' ids and lengths, and of
every term its postings in blocks of 128, compressed, each block with the largest impact that one of its postings has.  A
search brings the blocks of the queries' terms together by shard.  Inside a shard, a query's lists are ordered by the most
that they can add; those that can't reach the tenth score even together are not essential.  Candidates come from essential
lists alone; the block maxima of the others bound what a candidate can still get, and only blocks that hold a candidate whose
bound is good enough are decompressed.  Each shard gives ten documents a query, and these are merged in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from docweave.llm.blocks import pack_arrays, unpack_arrays
from docweave.llm.common import only, scratch, small_batches, stored, text_bytes

#: Postings of a block.
BLOCK = 128
#: term null: the shard's documents, in payload.
INDEX = "shard bigint, term binary, postings int, first_doc int, last_doc int, top bigint, payload binary"

_TERM = np.ones(256, bool)
for _range in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERM[_range[0] : _range[1] + 1] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


# ---- terms


def term_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes of texts are of terms, the terms' lengths, and how many terms stand before each text and in all."""
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    running = np.concatenate([[0], np.cumsum(inside)])
    return inside, np.diff(running[starts], append=running[-1]), np.searchsorted(starts, at)


def terms_of(text: pa.Array) -> pa.Array:
    """A list of each text's terms, as bytes, A-Z in lower case."""
    data, at = text_bytes(text)
    inside, sizes, before = term_spans(data, at)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(_FOLD[data[inside]])])
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words)


def _slices(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes that end at the end of a text or at a byte of no term."""
    i, n = 0, len(data)
    while i < n:
        j = min(n, i + size)
        if j < n:
            gaps = np.flatnonzero(~_TERM[data[i:j]])
            ends = at[(at > i) & (at <= j)]
            j = max(i + 1 + int(gaps[-1]) if len(gaps) else i, int(ends[-1]) if len(ends) else i)
            if j == i:  # one term longer than a stretch
                later = np.flatnonzero(~_TERM[data[i : int(at[np.searchsorted(at, i, "right")])]])
                j = i + 1 + int(later[0]) if len(later) else int(at[np.searchsorted(at, i, "right")])
        yield i, j
        i = j


def term_counts(text: pa.Array, size: int = 2 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """terms, and of each pair of a term and a text in them: the term's place, the text's place and how often it occurs there.

    Texts are worked through in stretches, so a very long one takes no more memory than others, but comes in several parts.
    """
    data, at = text_bytes(text)
    for i, j in _slices(data, at, size):
        first = int(np.searchsorted(at, i, "right")) - 1
        edges = np.clip(at[first : int(np.searchsorted(at, j, "left")) + 1], i, j) - i
        inside, sizes, before = term_spans(data[i:j], edges)
        if not len(sizes):
            continue
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(_FOLD[data[i:j][inside]])]).dictionary_encode()
        docs = len(edges) - 1
        pair = np.sort(words.indices.to_numpy().astype(np.int64) * docs + np.repeat(np.arange(docs), np.diff(before)))
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        yield words.dictionary, pair[new] // docs, pair[new] % docs + first, np.diff(new, append=len(pair))


# ---- compressed postings


def to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, low ones first, the last without the high bit; and where each value's bytes start."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        more = v >= np.uint64(1 << bits)
        if not more.any():
            break
        sizes += more
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[at[:-1][has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((sizes[has] > k + 1).astype(np.uint8) << 7)
    return out, at


def from_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = data[starts].astype(np.int64) & 127
    for k in range(1, int((ends - starts).max()) + 1):
        has = ends - starts >= k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def posting_blocks(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Blocks of postings sorted by term and doc: where each starts, its size, its largest impact, its last doc, its payload
    (gaps between docs, from the block's first on, then counts)."""
    n = len(term)
    new = np.concatenate([[True], term[1:] != term[:-1]])
    first = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(first, np.diff(first, append=n))
    start = np.flatnonzero(within % BLOCK == 0)
    size = np.diff(start, append=n)
    block = np.repeat(np.arange(len(start)), size)
    local = np.arange(n) - start[block]
    values = np.zeros(2 * n, np.int64)
    values[2 * start[block] + local] = np.where(local == 0, 0, doc - np.concatenate([[0], doc[:-1]]))
    values[2 * start[block] + size[block] + local] = tf
    data, at = to_varints(values)
    offsets = at[np.append(2 * start, 2 * n)].astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return start, size, np.maximum.reduceat(impact, start), doc[start + size - 1], payload


def open_blocks(payloads: list[bytes], sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Docs and counts of several blocks, one behind the other."""
    values, n = from_varints(np.frombuffer(b"".join(payloads), np.uint8)), int(sizes.sum())
    start = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(sizes)), sizes)
    gap = start[block] + np.arange(n)  # twice the start, and the place in the block
    running = np.cumsum(values[gap])
    before = running[start] - values[2 * start]
    return running - before[block] + first[block], values[gap + sizes[block]]


# ---- index


def length_norm(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents of n terms."""
    return 10 + (90 * n.astype(np.int64) * docs) // max(1, terms)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds for each unit of its term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class LexicalIndex:
    """An index below ``path``: blocks of postings by shard and term; docs counts those with a term, terms all their terms."""

    spark: SparkSession
    path: str
    docs: int
    terms: int

    def read(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/blocks")


class _ShardWriter:
    """Gathers documents and gives a shard's rows, sorted by term."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = self.load = 0

    def add(self, batch: pa.RecordBatch) -> None:
        for words, code, doc, tf in term_counts(batch.column("text")):
            self.parts.append((words, code.astype(np.int32), (doc + self.count).astype(np.int32), tf.astype(np.int32)))
        self.ids.append(batch.column("doc_id"))
        self.count += batch.num_rows
        self.load += batch.nbytes

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        lengths = np.zeros(self.count, np.int64)
        for _, _, doc, tf in self.parts:
            lengths += np.bincount(doc, tf, self.count).astype(np.int64)
        ids = pa.concat_arrays(self.ids)
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8)
        packed = pack_arrays(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), known, lengths)
        names = [c.split()[0] for c in INDEX.split(", ")]
        one = [pa.array([shard], pa.int64()), pa.array([None], pa.binary()), *(pa.array([v], t) for v, t in ((self.count, pa.int32()), (0, pa.int32()), (self.count - 1, pa.int32()), (0, pa.int64()), (packed, pa.binary())))]
        yield pa.RecordBatch.from_arrays(one, names=names)
        if not self.parts:
            return
        words = pa.chunked_array([p[0] for p in self.parts]).combine_chunks().dictionary_encode()
        place = np.empty(len(words.dictionary), np.int64)
        order = pc.array_sort_indices(words.dictionary)
        place[order.to_numpy()] = np.arange(len(order))
        codes, starts = place[words.indices.to_numpy()], np.cumsum([0, *(len(p[0]) for p in self.parts)])
        pair = np.concatenate([codes[s + p[1]] * self.count + p[2] for s, p in zip(starts, self.parts)])
        tf = np.concatenate([p[3] for p in self.parts]).astype(np.int64)
        self.parts = []
        by = np.argsort(pair, kind="stable")
        pair, tf = pair[by], tf[by]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, tf = pair[new], np.add.reduceat(tf, new)
        term, doc = pair // self.count, pair % self.count
        start, size, top, last, payload = posting_blocks(term, doc, tf, impacts(tf, length_norm(lengths, self.docs, self.terms)[doc]))
        sorted_words = words.dictionary.take(order).cast(pa.binary())
        out = pa.table([pa.array(np.full(len(start), shard)), sorted_words.take(pa.array(term[start])), *(pa.array(v.astype(np.int32)) for v in (size, doc[start], last)), pa.array(top), payload], names=names)
        yield from out.to_batches(max_chunksize=20_000)


def build_index(docs: DataFrame, shard_bytes: int = 12 << 20, path: str | None = None) -> LexicalIndex:
    """Indexes every whole text of a table with doc_id and text.  The table is read twice, once to count, and never shuffled.

    A shard holds about ``shard_bytes`` of text, and at least a document.  A null text has no terms, as an empty one; null
    and repeated ids are documents like others; an empty table gives an empty index.
    """
    spark = docs.sparkSession
    plain = only(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in small_batches(batches, "text"):
            before = np.diff(term_spans(*text_bytes(batch.column("text")))[2])
            n, total = n + int((before > 0).sum()), total + int(before.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    known = plain.select("text").mapInArrow(count, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    found, total = known[0] or 0, known[1] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId() << 32, _ShardWriter(found, total)
        for batch in small_batches(batches, "text", 4096, 2 << 20):
            if writer.count and writer.load + batch.nbytes > shard_bytes:
                yield from writer.rows(shard)
                shard, writer = shard + 1, _ShardWriter(found, total)
            writer.add(batch)
        if writer.count:
            yield from writer.rows(shard)

    path = path or scratch(spark, "lexical-index")
    plain.mapInArrow(write, INDEX).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return LexicalIndex(spark, path, found, total)


# ---- search


@dataclass
class Shard:
    """A shard's blocks of some terms, in memory and compressed; ``opened`` has those that were decompressed."""

    ids: np.ndarray
    known: np.ndarray
    norm: np.ndarray
    lists: dict[bytes, tuple[int, int]]
    size: np.ndarray
    first: np.ndarray
    last: np.ndarray
    top: np.ndarray
    payload: list[bytes]
    opened: set[int] = field(default_factory=set)
    kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    held: int = 0

    @classmethod
    def of(cls, rows: pa.Table, docs: int, terms: int) -> Shard:
        valid = pc.is_valid(rows["term"])
        about = rows.filter(pc.invert(valid))["payload"][0].as_py()
        ids, known, lengths = unpack_arrays(about, "<i8", "u1", "<i8")
        rows = rows.filter(valid)
        rows = rows.take(pc.sort_indices(rows, [("term", "ascending"), ("first_doc", "ascending")]))
        words = rows["term"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.binary()).dictionary_encode()
        codes = words.indices.to_numpy()
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        lists = dict(zip(words.dictionary.to_pylist(), zip(new.tolist(), np.append(new[1:], len(codes)).tolist())))
        number = lambda c: rows[c].to_numpy().astype(np.int64)
        return cls(ids, known.astype(bool), length_norm(lengths, docs, terms), lists, number("postings"), number("first_doc"), number("last_doc"), number("top"), rows["payload"].to_pylist())

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Docs and impacts of blocks, which lie behind each other; recent ones are kept for the next queries."""
        key = (int(blocks[0]), int(blocks[-1]) if len(blocks) == blocks[-1] - blocks[0] + 1 else -int(blocks.sum()) - 1)
        if key[1] >= 0 and key in self.kept:
            return self.kept[key]
        self.opened.update(blocks.tolist())
        doc, tf = open_blocks([self.payload[b] for b in blocks.tolist()], self.size[blocks], self.first[blocks])
        out = doc, impacts(tf, self.norm[doc])
        if key[1] >= 0:
            if self.held > 2_000_000:
                self.kept, self.held = {}, 0
            self.kept[key] = out
            self.held += len(doc)
        return out


def _first_threshold(shard: Shard, lists: list[tuple[np.ndarray, int]], k: int, short: int = 4) -> int:
    """A score that the k-th best document reaches at least: the k-th largest sum over lists of a few blocks."""
    found = [(shard.postings(blocks), w) for blocks, w in lists if len(blocks) <= short]
    if not found:
        return 1
    doc = np.concatenate([d for (d, _), _ in found])
    order = np.argsort(doc, kind="stable")
    doc, part = doc[order], np.concatenate([w * i for (_, i), w in found])[order]
    sums = np.add.reduceat(part, np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])))
    return max(1, int(np.partition(sums, -k)[-k])) if len(sums) >= k else 1


def best_documents(shard: Shard, weights: dict[bytes, int], k: int, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Docs and scores of the ``k`` best documents of a shard, ties to the smaller id (null ids last).

    Documents are passed in windows of ``width``; each window knows the k-th score of those before it, and the first what
    short lists alone give.
    """
    terms = sorted(((w * int(shard.top[slice(*shard.lists[t])].max()), t, w) for t, w in weights.items() if w > 0 and t in shard.lists), key=lambda x: x[:2])
    if not terms:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bound = np.cumsum([b for b, _, _ in terms])
    lists = [(np.arange(*shard.lists[t]), w) for _, t, w in terms]
    best, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), _first_threshold(shard, lists, k)
    for low in range(0, len(shard.ids), width):
        essential = int(np.searchsorted(bound, least))
        if essential == len(lists):
            break
        high = min(low + width, len(shard.ids))
        total = np.zeros(high - low, np.int64)
        for blocks, w in lists[essential:]:
            a, b = np.searchsorted(shard.last[blocks], low), np.searchsorted(shard.first[blocks], high)
            if a < b:
                doc, impact = shard.postings(blocks[a:b])
                i, j = np.searchsorted(doc, (low, high))
                total[doc[i:j] - low] += w * impact[i:j]
        cand = np.flatnonzero(total)
        if essential and len(cand):
            cand = cand[total[cand] + bound[essential - 1] >= least]
            where, most = [], np.zeros((essential + 1, len(cand)), np.int64)
            for i, (blocks, w) in enumerate(lists[:essential]):
                at = np.minimum(np.searchsorted(shard.last[blocks], cand + low), len(blocks) - 1)
                here = (shard.first[blocks[at]] <= cand + low) & (shard.last[blocks[at]] >= cand + low)
                where.append(np.where(here, blocks[at], -1))
                most[i + 1] = most[i] + np.where(here, w * shard.top[blocks[at]], 0)  # what lists up to i can add
            alive = np.arange(len(cand))
            for i in reversed(range(essential)):
                alive = alive[total[cand[alive]] + most[i + 1, alive] >= least]
                if not len(alive):
                    break
                blocks = np.unique(where[i][alive])
                blocks = blocks[blocks >= 0]
                if len(blocks):
                    doc, impact = shard.postings(blocks)
                    wanted = cand[alive] + low
                    at = np.minimum(np.searchsorted(doc, wanted), len(doc) - 1)
                    total[cand[alive]] += np.where(doc[at] == wanted, lists[i][1] * impact[at], 0)
            cand = cand[alive]
        cand = cand[total[cand] >= least]
        best, scores = np.concatenate([best, cand + low]), np.concatenate([scores, total[cand]])
        order = np.lexsort((shard.ids[best], ~shard.known[best], -scores))[:k]
        best, scores = best[order], scores[order]
        if len(best) == k:
            least = int(scores[-1])
    return best, scores


def _query_blocks(queries: DataFrame, items: int, size: int) -> Iterator[list[tuple]]:
    """The queries as (item, terms), in blocks of so many, or of so many bytes of text; the driver holds one block."""
    held, load = [], 0
    for row in queries.toLocalIterator():
        terms = sorted(set(terms_of(pa.array([row["text"]], pa.string()))[0].as_py()))
        held.append((row["item_id"], terms))
        load += sum(map(len, terms))
        if len(held) >= items or load >= size:
            yield held
            held, load = [], 0
    if held:
        yield held


def _search_block(index: LexicalIndex, block: list[tuple], kind, k: int) -> DataFrame:  # noqa: ANN001
    """item_id, rank, doc_id, score of a block of queries."""
    spark = index.spark
    distinct = sorted({t for _, terms in block for t in terms})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in distinct], "term binary"))  # bounded by the block's bytes
    rows = index.read()
    df = {bytes(r["term"]): r["df"] for r in rows.select("term", "postings").join(wanted, "term").groupBy("term").agg(F.sum("postings").alias("df")).collect()}
    weight = {t: term_weight(index.docs, n) for t, n in df.items()}
    asked = [{t: weight[t] for t in terms if t in weight} for _, terms in block]
    docs, terms = index.docs, index.terms

    def work(part: pa.Table) -> pa.Table:
        shard, numbers, best, scores = Shard.of(part, docs, terms), [], [], []
        for number, weights in enumerate(asked):
            doc, score = best_documents(shard, weights, k)
            numbers.append(np.full(len(doc), number))
            best.append(doc)
            scores.append(score)
        doc = np.concatenate(best)
        return pa.table([pa.array(np.concatenate(numbers).astype(np.int64)), pa.array(shard.ids[doc], mask=~shard.known[doc]), pa.array(np.concatenate(scores).astype(np.int64))], names=["number", "doc_id", "score"])

    needed = rows.where("term is null").unionByName(rows.join(wanted, "term", "left_semi").select(*rows.columns))
    hits = needed.groupBy("shard").applyInArrow(work, "number bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], StructType([StructField("number", LongType()), kind]))
    return ranked.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def search(index: LexicalIndex, queries: DataFrame, k: int = 10, items: int = 1000, size: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 of each row of ``queries`` (item_id, text).

    Queries are taken in blocks against all shards, so their number is not bounded; hits of blocks are stored.  Repeated
    and null item ids are queries of their own, each with ranks from 1; a null or empty text finds nothing.  Equal scores
    rank by ascending doc_id, null ids last.
    """
    plain = only(queries, "item_id", "text").select("item_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["item_id"]
    kind = StructField("item_id", kind.dataType, True)
    out = None
    for block in _query_blocks(plain, items, size):
        found = stored(_search_block(index, block, kind, k), "lexical-hits")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = plain.where("false").selectExpr("item_id", "cast(null as int) rank", "cast(null as bigint) doc_id", "cast(null as bigint) score")
    return out


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Indexes a table (doc_id, text) and ranks it for every query (item_id, text)."""
    return search(build_index(docs), queries, k)


def all_scores(shard: Shard, weights: dict[bytes, int]) -> np.ndarray:
    """Scores of all of a shard's documents, for comparison."""
    total = np.zeros(len(shard.ids), np.int64)
    for t, w in weights.items():
        if t in shard.lists:
            doc, impact = shard.postings(np.arange(*shard.lists[t]))
            total[doc] += w * impact
    return total


__all__: Iterable[str] = ("LexicalIndex", "build_index", "rank_documents", "search")
