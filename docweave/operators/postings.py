"""A stored keyword index that takes updates: segments of posting blocks, deleted nodes, a lexicon of stems.

Tasks put the nodes of their part of a table into ranges of 256, by length, and write one row for each field, word and range:
which nodes hold it, how often and where, the most occurrences and the least length in the range.  These two bound what the
range can score whatever the corpus statistics become, so a search for the best k reads bounds first, scores the ranges of
the highest ones, and then only ranges that can still beat the k-th score.

Rows are dealt to folders by the word's hash, as many folders as the segment's size asks for, and a folder with a frequent
word is split over tasks.  An update adds a segment and lists the nodes that it replaces; statistics are sums over segments
minus those of deleted nodes, so searches score as on an index built anew.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.porter import porter_stem, stem
from docweave.functions.text import STOP_WORDS
from docweave.sources.versions import SMALL, Snapshot, TableStore, Transaction

#: Nodes of a range.
RANGE = 256
#: Fixed values of the ranking functions.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Scores are sums in no fixed order; so many decimals keep equal ones equal and ranks stable.
DIGITS = 12
#: field and term are null in the row that lists a range's nodes.
BLOCKS = "field string, term string, range_id bigint, n int, max_tf int, min_dl int, min_dl_all int, docs array<bigint>, tfs array<int>, dls array<int>, dls_all array<int>, positions array<array<int>>"


def _lists(values: pa.Array, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)


def node_blocks(nodes: DataFrame, key: str, fields: dict[str, Column], version: int = 1, buckets: int | None = None) -> DataFrame:
    """The blocks of nodes whose fields hold lists of words.  A node's length counts the words of all fields (dls_all), or
    those of the first that are no stop words and longer than two characters (dls).  With ``buckets``, a row (bucket,
    payload) has all blocks of a batch that fall into a bucket."""
    kind = nodes.schema[key].dataType.simpleString()
    names, listed = [c.split()[0] for c in BLOCKS.split(", ")], list(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (version << 42) + (TaskContext.get().partitionId() << 21)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            words, sizes, kept = {}, {}, None
            for name in listed:
                lists = batch.column(name)
                sizes[name] = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                words[name] = lists.flatten().dictionary_encode()
                if kept is None:
                    fine = pc.and_(pc.greater(pc.utf8_length(words[name].dictionary), 2), pc.invert(pc.is_in(words[name].dictionary, pa.array(STOP_WORDS)))).to_numpy(zero_copy_only=False)
                    node = np.repeat(np.arange(n), sizes[name])
                    kept = np.bincount(node, fine[words[name].indices.to_numpy()].astype(float), n).astype(np.int32) if len(node) else np.zeros(n, np.int32)
            every = sum(sizes.values()).astype(np.int32)
            order = np.lexsort((kept, every))
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            keys, dl, dl_all = batch.column("key").take(pa.array(order)), kept[order], every[order]
            edges = np.append(np.arange(0, n, RANGE), n)
            ranges, none = len(edges) - 1, pa.nulls(len(edges) - 1, pa.string())
            least = lambda v, at: np.minimum.reduceat(v, at).astype(np.int32)
            whole = [none, none, pa.array(number + np.arange(ranges)), pa.array(np.diff(edges).astype(np.int32)), pa.nulls(ranges, pa.int32()), pa.array(least(dl, edges[:-1])), pa.array(least(dl_all, edges[:-1]))]
            yield pa.RecordBatch.from_arrays([*whole, _lists(keys, edges), pa.nulls(ranges, pa.list_(pa.int32())), _lists(pa.array(dl), edges), _lists(pa.array(dl_all), edges), pa.nulls(ranges, pa.list_(pa.list_(pa.int32())))], names=names)
            for name in listed:
                codes = words[name].indices.to_numpy().astype(np.int64)
                if not len(codes):
                    continue
                r = np.repeat(rank, sizes[name])
                place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes[name]) - sizes[name], sizes[name])).astype(np.int32)
                block = (r // RANGE) * len(words[name].dictionary) + codes
                by = np.lexsort((r, block))
                block, r, codes = block[by], r[by], codes[by]
                new_block = np.concatenate([[True], block[1:] != block[:-1]])
                first = np.flatnonzero(new_block | np.concatenate([[True], r[1:] != r[:-1]]))  # of each posting
                tf, doc = np.diff(first, append=len(r)).astype(np.int32), r[first]
                at = np.flatnonzero(new_block[first])  # of each block, in postings
                ends = np.append(at, len(first))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(at)),
                        words[name].dictionary.take(pa.array(codes[first[at]])),
                        pa.array(number + doc[at] // RANGE),
                        pa.array(np.diff(ends).astype(np.int32)),
                        pa.array(np.maximum.reduceat(tf, at)),
                        pa.array(least(dl[doc], at)),
                        pa.array(least(dl_all[doc], at)),
                        _lists(keys.take(pa.array(doc)), ends),
                        _lists(pa.array(tf), ends),
                        _lists(pa.array(dl[doc]), ends),
                        _lists(pa.array(dl_all[doc]), ends),
                        _lists(_lists(pa.array(place[by]), np.append(first, len(r))), ends),
                    ],
                    names=names,
                )
            number += ranges

    rows = nodes.select(F.col(key).alias("key"), *[c.alias(name) for name, c in fields.items()])
    if buckets is not None:
        return rows.mapInArrow(lambda b: _dealt(work(b), buckets), "bucket int, payload binary")
    return rows.mapInArrow(work, BLOCKS.replace("docs array<bigint>", f"docs array<{kind}>"))


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of bucket and payload, of batches of blocks, whose lists as rows of their own are many times as large in a shuffle."""
    for batch in batches:
        terms = batch.column("term").dictionary_encode()
        of = np.array([-1, *[bucket_of(t, buckets) for t in terms.dictionary.to_pylist()]], np.int32)
        bucket = of[pc.fill_null(terms.indices, -1).to_numpy().astype(np.int64) + 1]
        order = np.argsort(bucket, kind="stable")
        bucket, batch = bucket[order], batch.take(pa.array(order))
        first = np.flatnonzero(np.diff(bucket, prepend=-2))
        parts = [batch.slice(start, end - start) for start, end in zip(first, [*first[1:], len(bucket)])]
        payloads = [_squeezed(part if number < 0 else _packed(part)) for number, part in zip(bucket[first], parts)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def _squeezed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packed(blocks: pa.RecordBatch) -> pa.RecordBatch:
    """One row with what the blocks can be made from: nodes and their lengths, words and fields once, numbers in few bytes."""
    small = lambda x: pa.array(x.astype(np.min_scalar_type(int(x.max(initial=0)))))
    docs, fields, terms = (c.dictionary_encode() for c in (blocks.column("docs").flatten(), blocks.column("field"), blocks.column("term")))
    codes = pc.fill_null(docs.indices, len(docs.dictionary)).to_numpy().astype(np.int64)
    keys = pa.concat_arrays([docs.dictionary, pa.nulls(1, docs.dictionary.type)])  # a node's key may be null
    at = np.zeros(len(keys), np.int64)
    at[codes] = np.arange(len(codes))  # a posting of each node
    ranges, tfs = blocks.column("range_id").to_numpy(), blocks.column("tfs").flatten().to_numpy()
    places = blocks.column("positions").flatten().flatten().to_numpy().astype(np.int64)
    first = np.cumsum(tfs) - tfs
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    columns = {"keys": keys, "fields": fields.dictionary, "terms": terms.dictionary, "least": pa.array([ranges.min()])}
    columns |= {"field": small(fields.indices.to_numpy()), "term": small(terms.indices.to_numpy()), "range": small(ranges - ranges.min()), "n": small(blocks.column("n").to_numpy())}
    columns |= {"doc": small(codes), "tf": small(tfs), "step": small(steps)}
    columns |= {c: small(blocks.column(c).flatten().to_numpy()[at]) for c in ("dls", "dls_all")}
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()], names=list(columns))


def _unpacked(row: pa.RecordBatch) -> list[pa.Array]:
    """The blocks, column by column, that such a row was made from."""
    of = {name: row.column(name).flatten() for name in row.schema.names}
    number = lambda name, kind=np.int64: of[name].to_numpy().astype(kind)
    n, doc, tf, steps = number("n"), number("doc"), number("tf"), number("step")
    edges, ends = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(tf))
    dls, dls_all = number("dls", np.int32)[doc], number("dls_all", np.int32)[doc]
    total = np.cumsum(steps)
    places = (total - np.repeat(total[ends[:-1]] - steps[ends[:-1]], tf)).astype(np.int32)
    tfs, at = tf.astype(np.int32), edges[:-1]
    return [
        of["fields"].take(of["field"]),
        of["terms"].take(of["term"]),
        pa.array(number("least")[0] + number("range")),
        pa.array(n.astype(np.int32)),
        *(pa.array(f.reduceat(x, at)) for f, x in ((np.maximum, tfs), (np.minimum, dls), (np.minimum, dls_all))),
        _lists(of["keys"].take(pa.array(doc)), edges),
        *(_lists(pa.array(x), edges) for x in (tfs, dls, dls_all)),
        _lists(_lists(pa.array(places), ends), edges),
    ]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of such rows, with their bucket."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            for part in pa.ipc.open_stream(payload.as_buffer()):
                columns = part.columns if bucket < 0 else _unpacked(part)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), bucket, np.int32))], names=[*names, "bucket"])


@contextmanager
def _small_partitions(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Shuffles are dealt into partitions of ``size`` bytes at most: opened, payloads take some ten times as much to sort."""
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    asked = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    try:
        spark.conf.set(setting, str(min(size, asked)))
        yield
    finally:
        spark.conf.set(setting, before)


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def bucket_count(text_bytes: int) -> int:
    """Folders of a segment, a power of two: one for about every 64 MB of text, or every megabyte up to 32, 4,096 at most."""
    of = lambda size: 1 << (text_bytes // size).bit_length()
    return min(4096, max(of(64 << 20), min(32, of(1 << 20))))


@dataclass(frozen=True)
class Term:
    """What a search looks for: a name, the words that stand for it (several, if it is a stem) and how much it counts."""

    name: str
    words: tuple[str, ...]
    weight: float = 1.0


@dataclass
class KeywordIndex:
    """An index among the tables of a snapshot.  ``read`` tells of the last search for the best k how many ranges it read of
    how many that hold a word of it."""

    snapshot: Snapshot
    name: str = "keyword"
    read: tuple[int, int] = field(default=(0, 0))

    # ---- writing

    @staticmethod
    def add(tx: Transaction, nodes: DataFrame, key: str, fields: dict[str, Column], text_bytes: int, name: str = "keyword") -> None:
        """Nodes as a further segment.  ``nodes`` should be read from files, so that a task that runs again makes the same ranges."""
        buckets = bucket_count(text_bytes)
        kind = nodes.schema[key].dataType.simpleString()
        packed = node_blocks(nodes, key, fields, tx.version, buckets).hint("rebalance", "bucket")
        rows = packed.mapInArrow(_opened, BLOCKS.replace("docs array<bigint>", f"docs array<{kind}>") + ", bucket int")
        dealt = rows.sortWithinPartitions("bucket", "term", "field", "range_id")
        whole = F.col("term").isNull()
        add_up = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
        facts = [F.sum(F.when(whole, F.col("n"))).alias("nodes"), F.sum(F.when(whole, add_up("dls"))).alias("kept"), F.sum(F.when(whole, add_up("dls_all"))).alias("words")]
        with _small_partitions(tx.base.store.spark):
            segment = tx.append(f"{name}_postings", dealt, None, facts, by="bucket", buckets=buckets, fields=list(fields))
        written = tx.base.store.spark.read.schema(dealt.schema).parquet(f"{tx.base.store.path}/{segment['path']}")
        words = written.where("term is not null").select("term").distinct()
        if known := tx.base.segments(f"{name}_lexicon"):
            words = words.join(tx.base.read(f"{name}_lexicon", known).select("term"), "term", "left_anti")
        words = words.withColumn("stem", porter_stem(F.col("term")))
        lexicon = words.withColumn("bucket", (F.crc32(F.col("stem").cast("binary")) % buckets).cast("int"))
        tx.append(f"{name}_lexicon", lexicon.hint("rebalance", "bucket").sortWithinPartitions("bucket", "stem"), None, by="bucket", buckets=buckets)

    @staticmethod
    def remove(tx: Transaction, keys: DataFrame, name: str = "keyword") -> None:
        """The nodes with these keys (one column) are found no more: each is listed with its range and length."""
        index = KeywordIndex(tx.base, name)
        if index._segments():
            gone = index.nodes().join(keys.toDF("key").distinct(), "key", "left_semi").select("key", "range_id", "dl", "dl_all")
            tx.append(f"{name}_dead", gone, None, [F.sum("dl").alias("kept"), F.sum("dl_all").alias("words")])

    @staticmethod
    def merge(tx: Transaction, name: str = "keyword", most: int = 8, dead: float = 0.2) -> bool:
        """Joins all segments to one without deleted nodes, if there are more than ``most`` or more than that part is deleted.

        Ranges stay as they are; what a block loses leaves its bounds too high, never too low.
        """
        index = KeywordIndex(tx.base, name)
        parts = index._segments()
        if len(parts) <= most and index._gone("rows") <= dead * sum(s["facts"]["nodes"] for s in parts):
            return False
        buckets = sum(s["facts"]["buckets"] for s in parts)
        buckets = min(4096, 1 << (buckets - 1).bit_length())
        rows = tx.base.read(f"{name}_postings", parts)
        if index._gone("rows"):
            dead_docs = index._dead().groupBy("range_id").agg(F.collect_list("key").alias("_gone"))  # at most a range's nodes
            rows = rows.join(dead_docs, "range_id", "left")
            ints = F.array().cast("array<int>")  # a range's own row has no counts and positions
            zipped = F.arrays_zip("docs", F.coalesce("tfs", ints).alias("tfs"), "dls", "dls_all", F.coalesce("positions", F.array().cast("array<array<int>>")).alias("positions"))
            left = F.when(F.col("_gone").isNull(), zipped).otherwise(F.filter(zipped, lambda p: ~F.array_contains(F.col("_gone"), p["docs"])))
            rows = rows.withColumn("_left", left).where(F.size("_left") > 0).withColumn("n", F.size("_left"))
            pick = lambda c: F.when(F.col(c).isNotNull(), F.col(f"_left.{c}")).alias(c)
            rows = rows.withColumns({c: pick(c) for c in ("docs", "tfs", "dls", "dls_all", "positions")})
        rows = rows.select(*[c.split()[0] for c in BLOCKS.split(", ")]).withColumn("bucket", F.coalesce(F.crc32(F.col("term").cast("binary")) % buckets, F.lit(-1)).cast("int"))
        lexicon = tx.base.read(f"{name}_lexicon", tx.base.segments(f"{name}_lexicon")).select("term", "stem").distinct()
        lexicon = lexicon.withColumn("bucket", (F.crc32(F.col("stem").cast("binary")) % buckets).cast("int"))
        for table in ("postings", "lexicon", "dead"):
            tx.tables.pop(f"{name}_{table}", None)
        whole = F.col("term").isNull()
        add_up = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
        facts = [F.sum(F.when(whole, F.col("n"))).alias("nodes"), F.sum(F.when(whole, add_up("dls"))).alias("kept"), F.sum(F.when(whole, add_up("dls_all"))).alias("words")]
        tx.append(f"{name}_postings", rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "field", "range_id"), None, facts, by="bucket", buckets=buckets, fields=index.fields)
        tx.append(f"{name}_lexicon", lexicon.hint("rebalance", "bucket").sortWithinPartitions("bucket", "stem"), None, by="bucket", buckets=buckets)
        return True

    @classmethod
    def build(cls, nodes: DataFrame, key: str, fields: dict[str, Column], path: str, text_bytes: int = 1 << 30) -> KeywordIndex:
        """An index of its own below ``path``."""
        tx = TableStore(nodes.sparkSession, path).begin()
        cls.add(tx, nodes, key, fields, text_bytes)
        return cls(tx.commit())

    # ---- what is stored

    @property
    def spark(self) -> SparkSession:
        return self.snapshot.store.spark

    def _segments(self) -> list[dict]:
        return self.snapshot.segments(f"{self.name}_postings")

    def _dead(self) -> DataFrame:
        return self.snapshot.read(f"{self.name}_dead", self.snapshot.segments(f"{self.name}_dead"))

    def _gone(self, fact: str) -> int:
        return sum(s[fact] if fact == "rows" else s["facts"][fact] for s in self.snapshot.segments(f"{self.name}_dead"))

    def _sum(self, fact: str, gone: str) -> int:
        return sum(s["facts"][fact] for s in self._segments()) - self._gone(gone)

    @property
    def n(self) -> int:
        return self._sum("nodes", "rows")

    def average(self, every_word: bool) -> float:
        fact = "words" if every_word else "kept"
        return self._sum(fact, fact) / self.n if self.n else 0.0

    def _of(self, table: str, column: str, values: Sequence[str]) -> DataFrame:
        """Rows of a table whose column has one of the values, from the folders of these alone."""
        out, segments = None, self.snapshot.segments(f"{self.name}_{table}")
        for buckets in sorted({s["facts"]["buckets"] for s in segments}):
            rows = self.snapshot.read(f"{self.name}_{table}", [s for s in segments if s["facts"]["buckets"] == buckets])
            rows = rows.where(F.col("bucket").isin(sorted({bucket_of(v, buckets) for v in values})) & F.col(column).isin(list(values)))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.snapshot.read(f"{self.name}_{table}", [])

    def blocks(self, words: Sequence[str]) -> DataFrame:
        return self._of("postings", "term", sorted(set(words)))

    def _live(self, rows: DataFrame, keys: str = "key") -> DataFrame:
        """Without deleted nodes; these are sent to all tasks only where they are few."""
        if not self._gone("rows"):
            return rows
        dead = self._dead().select(F.col("key").alias("_key"), F.col("range_id").alias("_range"))
        dead = F.broadcast(dead) if self._gone("rows") <= SMALL else dead
        return rows.join(dead, rows[keys].eqNullSafe(dead["_key"]) & (rows["range_id"] == dead["_range"]), "left_anti")

    def nodes(self) -> DataFrame:
        """key, range_id, dl, dl_all of every node."""
        rows = self.snapshot.read(f"{self.name}_postings", self._segments()).where("bucket = -1")
        each = rows.select("range_id", F.explode(F.arrays_zip("docs", "dls", "dls_all")).alias("p"))
        return self._live(each.select(F.col("p.docs").alias("key"), "range_id", F.col("p.dls").alias("dl"), F.col("p.dls_all").alias("dl_all")))

    def postings(self, blocks: DataFrame | None = None) -> DataFrame:
        """key, range_id, field, term, tf, dl, dl_all, positions, one row a posting; of all words if no blocks are given."""
        rows = self.snapshot.read(f"{self.name}_postings", self._segments()).where("bucket >= 0") if blocks is None else blocks
        each = rows.select("range_id", "field", "term", F.explode(F.arrays_zip("docs", "tfs", "dls", "dls_all", "positions")).alias("p"))
        return self._live(each.select(F.col("p.docs").alias("key"), "range_id", "field", "term", F.col("p.tfs").cast("bigint").alias("tf"), F.col("p.dls").alias("dl"), F.col("p.dls_all").alias("dl_all"), F.col("p.positions").alias("positions")))

    def terms(self) -> DataFrame:
        """term, df, cf of every word; frequencies come from the blocks' counts where no node was deleted."""
        return self.postings().groupBy("term").agg(F.countDistinct("key", "range_id").alias("df"), F.sum("tf").alias("cf"))

    def words_of(self, stems: Sequence[str]) -> dict[str, tuple[str, ...]]:
        """The words of each stem, from the lexicon."""
        wanted = sorted(set(stems))
        rows = self._of("lexicon", "stem", wanted).select("stem", "term").distinct().collect()
        return {s: tuple(sorted(r["term"] for r in rows if r["stem"] == s)) for s in wanted}

    def stemmed(self, words: Sequence[str]) -> list[Term]:
        """A term for each stem of the words, in their order."""
        of = self.words_of([stem(w) for w in words])
        return [Term(s, of[s]) for s in dict.fromkeys(stem(w) for w in words)]

    # ---- search

    def _named(self, rows: DataFrame, terms: Sequence[Term], weights: dict[str, float] | None) -> DataFrame:
        """Rows with the name of the term that their word stands for and the weight of their field."""
        names = self.spark.createDataFrame([(w, t.name) for t in terms for w in t.words], "term string, name string")
        rows = rows.join(F.broadcast(names), "term")
        if weights is None:
            return rows.withColumn("fw", F.lit(1.0))
        of = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        return rows.where(F.col("field").isin(list(weights))).withColumn("fw", F.element_at(of, F.col("field")))

    @property
    def fields(self) -> list[str]:
        return sorted({f for s in self._segments() for f in s["facts"]["fields"]})

    def _plain(self, terms: Sequence[Term]) -> bool:
        """Whether a node has at most one posting of each term."""
        return len(self.fields) <= 1 and all(len(t.words) <= 1 for t in terms)

    def frequencies(self, terms: Sequence[Term], weights: dict[str, float] | None = None) -> dict[str, int]:
        """In how many nodes each term occurs.  Where a term is one word and the index has one field, blocks' counts tell, less
        the deleted nodes in the ranges that have some; else nodes are counted."""
        rows = self._named(self.blocks([w for t in terms for w in t.words]), terms, weights)
        if not self._plain(terms):
            each = self._live(rows.select("name", "range_id", F.explode("docs").alias("key")))
            return {r["name"]: r["df"] for r in each.groupBy("name").agg(F.countDistinct("range_id", "key").alias("df")).collect()}
        df = {r["name"]: r["df"] for r in rows.groupBy("name").agg(F.sum("n").alias("df")).collect()}
        if self._gone("rows"):
            dead = self._dead().select("range_id", F.col("key").alias("_key"))
            dead = F.broadcast(dead) if self._gone("rows") <= SMALL else dead
            held = rows.select("name", "range_id", "docs").join(dead, "range_id").where(F.array_contains("docs", F.col("_key")))
            for r in held.groupBy("name").count().collect():
                df[r["name"]] -= r["count"]
        return df

    def _idf(self, df: int, every_word: bool) -> float:
        ratio = (self.n - df + 0.5) / (df + 0.5)
        if not every_word:
            return math.log(ratio + 1)
        return math.log(ratio) if ratio > 1 else IDF_FLOOR

    def gain(self, idf: Column, tf: Column, dl: Column, every_word: bool) -> Column:
        """What a term adds to a node's score; grows with tf and falls with the length."""
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(self.average(every_word))))

    def scored(self, terms: Sequence[Term], every_word: bool, every_term: bool, weights: dict[str, float] | None = None, ranges: DataFrame | None = None, df: dict[str, int] | None = None) -> DataFrame:
        """key, gain of the nodes that hold a term, or every term; of some ranges (range_id), if they are given."""
        df = self.frequencies(terms, weights) if df is None else df
        terms = [t for t in terms if df.get(t.name)]
        blocks = self._named(self.blocks([w for t in terms for w in t.words]), terms, weights)
        if ranges is not None:
            blocks = blocks.join(ranges, "range_id", "left_semi")
        dl = "dls_all" if every_word else "dls"
        each = blocks.select("range_id", "name", "fw", F.explode(F.arrays_zip("docs", "tfs", dl)).alias("p"))
        each = self._live(each.select("range_id", "name", F.col("p.docs").alias("key"), (F.col("p.tfs") * F.col("fw")).alias("tf"), F.col(f"p.{dl}").alias("dl")))
        if not self._plain(terms):
            each = each.groupBy("range_id", "key", "name").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        idf = F.create_map(*[F.lit(x) for t in terms for x in (t.name, t.weight * self._idf(df[t.name], every_word))]) if terms else F.create_map().cast("map<string,double>")
        hits = each.groupBy("range_id", "key").agg(F.round(F.sum(self.gain(F.element_at(idf, F.col("name")), F.col("tf"), F.col("dl"), every_word)), DIGITS).alias("gain"), F.count("*").alias("found"))
        return (hits.where(F.col("found") == len(terms)) if every_term else hits).select("key", "gain")

    def best(self, terms: Sequence[Term], k: int, every_word: bool, every_term: bool, weights: dict[str, float] | None = None, allowed: DataFrame | None = None, first: int = 32) -> DataFrame:
        """key, gain, rank of the ``k`` best nodes, of those whose key ``allowed`` (key) has, ties by key.

        Ranges are bounded by their blocks' most occurrences and least length.  The ``first`` ranges of the highest bounds are
        scored, and then those whose bound reaches the k-th gain; no other range can hold a better node.
        """
        if not self.n:
            return self._top([], k)
        df = self.frequencies(terms, weights)
        if every_term and not all(df.get(t.name) for t in terms):
            return self._top([], k)
        terms = [t for t in terms if df.get(t.name)]
        if not terms:
            return self._top([], k)
        rows = self._named(self.blocks([w for t in terms for w in t.words]), terms, weights)
        idf = F.create_map(*[F.lit(x) for t in terms for x in (t.name, t.weight * self._idf(df[t.name], every_word))])
        most = rows.groupBy("range_id", "name").agg(F.sum(F.col("max_tf") * F.col("fw")).alias("tf"), F.min("min_dl_all" if every_word else "min_dl").alias("dl"))
        bound = F.sum(self.gain(F.element_at(idf, F.col("name")), F.col("tf"), F.col("dl"), every_word))
        bounds = most.groupBy("range_id").agg(bound.alias("bound"), F.count("*").alias("found"))
        bounds = bounds.where(F.col("found") == len(terms)) if every_term else bounds
        some = [r["range_id"] for r in bounds.orderBy(F.desc("bound"), "range_id").limit(first).collect()]
        hits = self._best_of(terms, k, every_word, every_term, weights, allowed, self.spark.createDataFrame([(r,) for r in some], "range_id bigint"), len(some), df)
        if len(some) < first:
            self.read = (len(some), len(some))
            return self._top(hits, k)
        least = hits[-1]["gain"] if len(hits) == k else 0.0
        rest = bounds.where((F.col("bound") >= least - 10.0 ** (2 - DIGITS)) & ~F.col("range_id").isin(some)).select("range_id")
        known = bounds.agg(F.count("*").alias("n"), F.count_if((F.col("bound") >= least - 10.0 ** (2 - DIGITS)) & ~F.col("range_id").isin(some)).alias("m")).first()
        self.read = (len(some) + known["m"], known["n"])
        if known["m"]:
            hits += self._best_of(terms, k, every_word, every_term, weights, allowed, rest, known["m"], df)
        return self._top(hits, k)

    def _best_of(self, terms, k, every_word, every_term, weights, allowed, ranges, count, df) -> list:  # noqa: ANN001
        """The k best hits of some ranges, on the driver."""
        found = self.scored(terms, every_word, every_term, weights, F.broadcast(ranges) if count <= SMALL else ranges, df)
        found = found.where("gain > 0")
        if allowed is not None:
            found = found.join(allowed, "key", "left_semi")
        return found.orderBy(F.desc("gain"), "key").limit(k).collect()

    def _top(self, hits: list, k: int) -> DataFrame:
        kind = self.snapshot.schema(f"{self.name}_postings")["docs"].dataType.elementType.simpleString() if self._segments() else "bigint"
        hits = sorted(hits, key=lambda h: (-h["gain"], h["key"] is not None, 0 if h["key"] is None else h["key"]))[:k]
        return self.spark.createDataFrame([(h["key"], h["gain"], i) for i, h in enumerate(hits, 1)], f"key {kind}, gain double, rank bigint")

    def matched(self, key: str, words: list[str], every_word: bool) -> DataFrame:
        """key, dl, term, tf, df, n, avgdl of the words' postings; lengths count every word or only kept ones."""
        terms = [Term(w, (w,)) for w in dict.fromkeys(words)]
        df = self.frequencies(terms)
        rows = self.postings(self.blocks(words)).groupBy("range_id", "key", "term").agg(F.sum("tf").alias("tf"), F.first("dl_all" if every_word else "dl").alias("dl"))
        known = F.create_map(*[F.lit(x) for w, v in df.items() for x in (w, v)]) if df else F.create_map().cast("map<string,bigint>")
        return rows.select(F.col("key").alias(key), F.col("dl").cast("bigint").alias("dl"), "term", "tf", F.element_at(known, F.col("term")).cast("bigint").alias("df"), F.lit(self.n).cast("bigint").alias("n"), F.lit(self.average(every_word)).alias("avgdl"))

    def phrase(self, key: str, terms: Sequence[Term]) -> DataFrame:
        """key, occurrences, gain: how often a node's field holds the terms one behind the other, from positions alone, and
        what the phrase scores, as a term that occurs so often in so many nodes."""
        distinct = list({t.name: t for t in terms}.values())
        rows = self._named(self.blocks([w for t in distinct for w in t.words]), distinct, None)
        each = self._live(rows.select("range_id", "field", "name", F.explode(F.arrays_zip("docs", "dls_all", "positions")).alias("p")).select("range_id", "field", "name", F.col("p.docs").alias("key"), F.col("p.dls_all").alias("dl"), F.col("p.positions").alias("positions")))
        merged = each.groupBy("range_id", "key", "field", "name").agg(F.flatten(F.collect_list("positions")).alias("positions"), F.first("dl").alias("dl"))
        at = merged.groupBy("range_id", "key", "field").agg(F.map_from_entries(F.collect_list(F.struct("name", "positions"))).alias("at"), F.first("dl").alias("dl")).where(F.size("at") == len(distinct))
        starts = F.array_distinct(F.col("at")[terms[0].name])
        moved = lambda positions, back: F.transform(positions, lambda p: p - back)
        for i, t in list(enumerate(terms))[1:]:
            starts = F.array_intersect(starts, moved(F.col("at")[t.name], i))
        hits = at.withColumn("m", F.size(starts)).groupBy("range_id", "key").agg(F.sum("m").alias("occurrences"), F.first("dl").alias("dl")).where("occurrences > 0")
        df = hits.agg(F.count("*").alias("df"))
        ratio = (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)
        idf = F.when(ratio > 1, F.log(ratio)).otherwise(IDF_FLOOR)
        scored = hits.crossJoin(F.broadcast(df)).withColumn("gain", F.round(self.gain(idf, F.col("occurrences"), F.col("dl"), True), DIGITS))  # one row
        return scored.select(F.col("key").alias(key), F.col("occurrences").cast("bigint").alias("occurrences"), "gain")
