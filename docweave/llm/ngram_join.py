"""N-gram Jaccard self-join with prefix filters under several global token orders.

Two sets whose Jaccard similarity reaches t share a token among the first |x| - ceil(t |x|) + 1 tokens of each, whatever
the global order.  Tokens here are hashed word shingles.  One order (rare shingles first, then by hash) makes the
candidates; two further orders must agree that prefixes meet before a candidate is verified.  Links are wanted up to
connectivity, so a group of sets that share a prefix token is first tied to one hub each, and only sets that this
leaves in different components are paired with each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import discard, forgetting, mix, on_release, only, positional, small_batches, stored, word_keys
from docweave.llm.graph import connected_components

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Bits of a set's bitmap; places in which two bitmaps differ are no more than the tokens in which the sets differ.
BITS = 1024


@dataclass(frozen=True)
class JoinFit:
    """``width`` words to a shingle and ``percent`` of similarity; the rest only steers cost, never the result.

    Shingles counted ``local`` times in a block of a task are summed, and the ``frequent`` commonest of those in ``least`` sets
    or more come last in the orders.  Up to ``broadcast_rows`` ids of sets to verify are broadcast, more are joined by
    shuffle.  ``rounds`` of hubs at most come before sets are paired with each other, no further one after
    a round where less than one in ``worth`` pairs is a link.
    """

    width: int = 5
    percent: int = 80
    block: int = 4_000_000
    local: int = 2
    least: int = 4
    frequent: int = 500_000
    broadcast_rows: int = 1_000_000
    rounds: int = 3
    worth: int = 20


class Sets:
    """Sorted distinct 64-bit hashes of the word shingles of a batch's texts, one set behind the other.

    A text of fewer words than a shingle has one, a text without words none.
    """

    def __init__(self, text: pa.Array, width: int = 5):
        words, before = word_keys(text)
        sizes = np.diff(before)
        rolled = np.full(max(0, len(words) - width + 1), width, np.uint64)
        for i in range(width):
            rolled = rolled * _STEP + words[i : len(words) - width + 1 + i]
        rolled = mix(rolled, 0xFF51AFD7ED558CCD)
        parts = []
        for i, n in enumerate(sizes.tolist()):
            at = before[i]
            if n >= width:
                part = np.sort(rolled[at : at + n - width + 1])
                new = np.ones(len(part), bool)
                new[1:] = part[1:] != part[:-1]
                part = part[new]
            else:
                part = np.zeros(min(n, 1), np.uint64)
                for w in words[at : at + n]:
                    part = part * _STEP + w + np.uint64(n)
                part = mix(part, 0xFF51AFD7ED558CCD)
            parts.append(part)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.digests = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64).astype(np.int64)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]

    def __len__(self) -> int:
        return len(self.sizes)

    def packed(self, values: np.ndarray, at: np.ndarray) -> pa.Array:
        """A binary column of slices of 64-bit numbers."""
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def prefixes(self, frequent: Frequent, order: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each set that come first under an order, sorted, and where those of each set start.

        Frequent tokens come last, otherwise a hash of their own decides.
        """
        key = (mix(self.flat, _ORDERS[order]) >> np.uint64(1)) | (frequent.among(self.flat).astype(np.uint64) << np.uint64(63))
        wanted = self.sizes + (percent * -self.sizes) // 100 + (self.sizes > 0)
        out = []
        for i, n in enumerate(wanted.tolist()):
            s = self[i]
            out.append(s if n >= len(s) else s[np.sort(np.argpartition(key[self.at[i] : self.at[i + 1]], n - 1)[:n])])
        return np.concatenate(out) if out else self.flat, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def bits(self) -> np.ndarray:
        """For each set BITS bits, which of its tokens have an odd count at a place; copes with sets of any size."""
        planes = np.zeros((len(self), BITS), np.uint8)
        np.add.at(planes, (np.repeat(np.arange(len(self)), self.sizes), (mix(self.flat, 0x9FB21C651E98DF25) % np.uint64(BITS)).astype(np.int64)), 1)
        return np.packbits(planes & 1, axis=1).view(">i8").astype(np.int64)


class Frequent:
    """A bounded table of frequent tokens; a bitmap spares most others the search."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.bitmap = np.sort(tokens), np.zeros(1 << 24, bool)
        self.bitmap[(self.tokens >> np.uint64(40)).astype(np.int64)] = True

    def among(self, tokens: np.ndarray) -> np.ndarray:
        out = self.bitmap[(tokens >> np.uint64(40)).astype(np.int64)]
        if len(self.tokens):
            maybe = tokens[out]
            out[out] = self.tokens[np.minimum(np.searchsorted(self.tokens, maybe), len(self.tokens) - 1)] == maybe
        return out


_frequent: dict[str, Frequent] = {}
on_release.append(_frequent.clear)


def _table_of(frequent) -> Frequent:  # noqa: ANN001  Broadcast
    """This worker's table of the broadcast name and tokens."""
    name, tokens = frequent.value
    if name not in _frequent:
        _frequent.clear()
        _frequent[name] = Frequent(tokens)
    return _frequent[name]


def linked(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _profile(docs: DataFrame, fit: JoinFit) -> DataFrame:
    """Rows of two kinds: 0 holds doc_id, digest and size of a document's set, 1 a token and its count in a block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "digest", "n"]

        def counts(sets: list[np.ndarray]) -> pa.RecordBatch:
            token = np.concatenate(sets)
            sets.clear()
            token.sort()
            at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            n = np.diff(at, append=len(token))
            token, n = token[at[n >= fit.local]], n[n >= fit.local]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int8)), pa.nulls(len(token), pa.int64()), pa.array(token.astype(np.int64)), pa.array(n)], names=names)

        held, load, seen = [], 0, set()
        for batch in small_batches(batches, "text", 1024, 1 << 20):
            sets = Sets(batch.column("text"), fit.width)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), batch.column("doc_id"), pa.array(sets.digests), pa.array(sets.sizes)], names=names)
            for i, d in enumerate(sets.digests.tolist()):
                if d not in seen and sets.sizes[i]:
                    seen.add(d)
                    held.append(sets[i])
                    load += len(sets[i])
            if load >= fit.block:
                yield counts(held)
                load, seen = 0, set()
        if held:
            yield counts(held)

    return docs.mapInArrow(lambda b: forgetting(work(b)), "kind tinyint, doc_id bigint, digest bigint, n bigint")


def _prefixes(docs: DataFrame, frequent, fit: JoinFit) -> DataFrame:  # noqa: ANN001  Broadcast
    """token, digest, n for each prefix token under the first order; a task gives a set only once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small_batches(batches, "text", 1024, 1 << 20):
            sets = Sets(batch.column("text"), fit.width)
            tokens, at = sets.prefixes(_table_of(frequent), 0, fit.percent)
            new = np.zeros(len(sets), bool)
            for i, d in enumerate(sets.digests.tolist()):
                if d not in seen:
                    seen.add(d)
                    new[i] = True
            if len(seen) > 1_000_000:
                seen.clear()
            long = np.diff(at)
            fresh = np.repeat(new, long)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[fresh].astype(np.int64)), pa.array(np.repeat(sets.digests[new], long[new])), pa.array(np.repeat(sets.sizes[new], long[new]).astype(np.int32))], names=["token", "digest", "n"])

    return docs.select("text").mapInArrow(lambda b: forgetting(work(b)), "token bigint, digest bigint, n int")


def _groups(prefixes: DataFrame, fit: JoinFit) -> DataFrame:
    """The rows whose token another set of fitting size has: token, run, digest, n, need.

    Works along rows sorted by token and size and holds one row over, so a token may have any number of sets.  A run ends
    where the next size is too large for a link across; no link leaves its run.  A set that is similar to any other of
    the run shares at least ``need`` prefix tokens with it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (token, digest, n, run, given out)
        for batch in batches:
            token, digest, n = (batch.column(c).to_numpy() for c in ("token", "digest", "n"))
            if last is not None:
                token, digest, n = np.append(last[0], token), np.append(last[1], digest), np.append(last[2], n)
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])
            token, digest, n = token[new], digest[new], n[new].astype(np.int64)
            starts = np.ones(len(token), bool)
            starts[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < fit.percent * n[1:])
            at = np.maximum.accumulate(np.where(starts, np.arange(len(token)), 0))
            run = n[at]
            if last is not None:
                run[at == 0] = last[3]
            pair = ~starts
            pair[:-1] |= ~starts[1:]
            if last is not None:
                pair[0] = (len(starts) > 1 and not starts[1]) and not last[4]
            number, first = np.cumsum(starts) - 1, np.flatnonzero(starts)
            need = _need(n, n[first][number], n[np.append(first[1:], len(n)) - 1][number], fit.percent)
            need[(number == number[-1]) | ((number == 0) & (last is not None))] = 1  # such a run may go on elsewhere
            given = bool(pair[-1]) or (last is not None and len(token) == 1 and last[4])
            last = (token[-1], digest[-1], n[-1], run[-1], given)
            yield pa.RecordBatch.from_arrays([pa.array(x[pair]) for x in (token, run, digest, n, need)], names=["token", "run", "digest", "n", "need"])

    dealt = prefixes.repartition("token").sortWithinPartitions("token", "n", "digest")
    return dealt.mapInArrow(work, "token bigint, run bigint, digest bigint, n bigint, need bigint")


def _shared(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens sets of these sizes share at least if they are similar."""
    return -(-percent * (n + m) // (100 + percent))


def _need(n: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """The least number of prefix tokens that a set of size n shares with a similar set of a size from low to high.

    Of o shared tokens the first k stand among the first |x| - o + k tokens of each; one is taken off for rounding.
    """
    beyond = lambda x: 1 + -percent * x // 100  # noqa: E731  prefix less size
    low, high = np.maximum(low, -(-percent * n // 100)), np.minimum(high, 100 * n // percent)
    return np.maximum(1, np.minimum(beyond(n) + _shared(n, low, percent), beyond(high) + _shared(n, high, percent)) - 1)


def _sets(docs: DataFrame, wanted: DataFrame, frequent, fit: JoinFit) -> DataFrame:  # noqa: ANN001  Broadcast
    """digest, size, prefixes under the further orders, whole set and bitmap of the wanted documents' texts.

    A wanted text that stands only under a null doc_id is found by its digest.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 512, 1 << 20):
            sets = Sets(batch.column("text"), fit.width)
            more = [sets.packed(*sets.prefixes(_table_of(frequent), k, fit.percent)) for k in (1, 2)]
            bits = sets.bits()
            yield pa.RecordBatch.from_arrays([pa.array(sets.digests), pa.array(sets.sizes), *more, sets.packed(sets.flat, sets.at), pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), BITS // 64).cast(pa.list_(pa.int64()))], names=["digest", "size", "second", "third", "tokens", "bits"])

    near = F.broadcast if wanted.count() <= fit.broadcast_rows else lambda df: df
    found = lambda df: df.select("text").mapInArrow(lambda b: forgetting(work(b)), "digest bigint, size bigint, second binary, third binary, tokens binary, bits array<bigint>")
    sets, nameless = found(docs.join(near(wanted.select("doc_id")), "doc_id", "left_semi")), wanted.where("doc_id is null").select("digest")
    if nameless.isEmpty():
        return sets
    return sets.unionByName(found(docs.where("doc_id is null")).join(near(nameless), "digest", "left_semi").dropDuplicates(["digest"]))


def meeting(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, percent: int = 80) -> bool:
    """Whether two prefixes under one order share as many tokens as similar sets of these sizes must.

    Of o shared tokens the first k stand among the first |x| - o + k tokens of each set.
    """
    shared = -(-percent * (size_a + size_b) // (100 + percent))
    least = min(len(a) - size_a + shared, len(b) - size_b + shared)
    return len(np.intersect1d(a, b, assume_unique=True)) >= max(1, least)


def _sided(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    side = lambda s: sets.select(F.col("digest").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _verified(pairs: DataFrame, sets: DataFrame, fit: JoinFit) -> DataFrame:
    """The pairs (a, b) that agree under the further orders, and of these the ones whose sets are similar enough."""
    read = lambda x: np.frombuffer(x.as_buffer(), np.uint64)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "second_a", 512):
            sizes = [batch.column(f"size_{s}").to_pylist() for s in "ab"]
            good = [all(meeting(*[read(batch.column(f"{k}_{s}")[i]) for s in "ab"], sizes[0][i], sizes[1][i], fit.percent) for k in ("second", "third")) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "tokens_a", 512):
            good = [linked(read(x), read(y), fit.percent) for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = stored(_sided(pairs, sets, ("size", "second", "third")).mapInArrow(agree, "a bigint, b bigint").distinct(), "candidates")
    ids = left.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    return _sided(left, sets.join(ids, "digest", "left_semi"), ("tokens",)).mapInArrow(similar, "a bigint, b bigint")


def _fitting(a: str, b: str, fit: JoinFit) -> str:
    return f"100 * least({a}, {b}) >= {fit.percent} * greatest({a}, {b})"


def _least_shared(fit: JoinFit) -> str:
    """SQL of ``meeting``'s bound for the first order, by the sizes n_a and n_b."""
    both = f"ceil({fit.percent}D * (n_a + n_b) / {100 + fit.percent} - 1e-9)"
    beyond = lambda n: f"(1 - ceil({fit.percent}D * {n} / 100 - 1e-9) + {both})"
    return f"greatest(1, least({beyond('n_a')}, {beyond('n_b')}))"


def _open(groups: DataFrame, tied: DataFrame | None, number: int) -> DataFrame:
    """The rows that can still make a link between components: token, run, digest, n, need, component, hub.

    A pair of similar sets shares as many rows as each of these needs, so of a set's rows the ones that need more than
    there are cannot make a link; then rows go whose group has but one component.  The hub of a group is first the set
    that stands in most groups: the original of a family of near copies is in all of theirs, while each copy is missing
    where it was changed.  Later ones differ from token to token, so that a set meets many.
    """
    if tied is None:
        placed = groups.withColumn("component", F.col("digest"))
    else:
        placed = groups.drop("component", "hub").join(tied.select(F.col("node").alias("digest"), "component"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    for _ in range(2):
        each, group = Window.partitionBy("digest"), Window.partitionBy("token", "run")
        placed = placed.withColumn("rows", F.count("*").over(each.orderBy("need")))
        placed = placed.withColumn("rows", F.max(F.when(F.col("rows") >= F.col("need"), F.struct("need", "rows"))).over(each)).where("need <= rows.need")
        score = F.xxhash64("digest", "token", F.lit(number)) if number else F.col("rows.rows")
        placed = placed.withColumn("hub", F.max(F.struct(score.alias("score"), "digest", "n", "component")).over(group))
        placed = placed.withColumn("low", F.min("component").over(group)).withColumn("high", F.max("component").over(group)).where("low <> high").drop("low", "high", "rows")
    return stored(placed.select("token", "run", "digest", "n", "need", "component", "hub"), "open")


def _stars(placed: DataFrame, fit: JoinFit) -> DataFrame:
    """Pairs of each set with the hub of its group, where that lies in another component; no more pairs than rows."""
    pairs = placed.where(f"component <> hub.component and {_fitting('n', 'hub.n', fit)}")
    return pairs.select(F.least("digest", "hub.digest").alias("a"), F.greatest("digest", "hub.digest").alias("b")).distinct()


def _across(rest: DataFrame, sets: DataFrame, fit: JoinFit) -> DataFrame:
    """Pairs of sets of different components that share enough prefix tokens and whose bitmaps differ in few places.

    Bitmaps and sizes are tested where the pairs are made, so that what a pair costs there is all it costs as a rule.
    """
    narrow = rest.select("token", "run", "digest", "n", "component").join(sets.select("digest", *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITS // 64)]), "digest")
    x, y = (narrow.toDF(*[f"{c}_{s}" for c in narrow.columns]) for s in "ab")
    differ = " + ".join(f"bit_count(bits{i}_a ^ bits{i}_b)" for i in range(BITS // 64))
    both = f"ceil({fit.percent}D * (n_a + n_b) / {100 + fit.percent} - 1e-9)"
    near = f"digest_a < digest_b and component_a <> component_b and {_fitting('n_a', 'n_b', fit)} and {differ} <= n_a + n_b - 2 * {both}"
    pairs = x.join(y, F.expr(f"token_a = token_b and run_a = run_b and {near}")).groupBy(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("shared"))
    return pairs.where(f"shared >= {_least_shared(fit)}").select("a", "b")


def jaccard_components(docs: DataFrame, fit: JoinFit = JoinFit()) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    A-Z is lower-cased; words are runs of anything but space and U+0009 to U+000D.  A text of fewer than five words is
    one shingle; a text that is null or has no words has none, links with nothing and is its own component.  Copies form a
    component as any others.  Rows of equal doc_id count once each and share what the smallest links give; a null doc_id
    stays null and never names a component (a component of null ids alone is null).  An empty table gives no rows; further
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    profile = stored(_profile(rows, fit), "profile")
    documents = profile.where("kind = 0").select("doc_id", "digest", "n")
    top = profile.where("kind = 1").groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= fit.least).orderBy(F.desc("n"), "digest").limit(fit.frequent).select("digest").toArrow()
    frequent = spark.sparkContext.broadcast((uuid.uuid4().hex, top["digest"].to_numpy().astype(np.uint64)))

    groups = stored(_groups(_prefixes(rows, frequent, fit), fit), "groups")
    rest = _open(groups, None, 0)
    discard(groups)
    wanted = documents.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(rest.select("digest").distinct(), "digest", "left_semi").select("digest", "doc_id")
    wanted = stored(wanted, "wanted")
    sets = stored(_sets(rows, wanted, frequent, fit), "sets")

    links, tied, tried, number = None, None, None, 0
    while number < fit.rounds:
        pairs = _stars(rest, fit)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "stars")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(_verified(pairs, sets, fit), "links")
        links = found if links is None else links.unionByName(found)
        tied = connected_components(links)
        number += 1
        narrower = _open(rest, tied, number)
        discard(rest)
        rest = narrower
        if fit.worth * found.count() < pairs.count():
            break
    found = stored(_verified(_across(rest, sets, fit).join(tried, ["a", "b"], "left_anti"), sets, fit), "links")
    if not found.isEmpty():
        links = links.unionByName(found)
        tied = connected_components(links)
    discard(rest, sets, wanted)

    tied = stored(tied.select(F.col("node").alias("digest"), "component"), "tied")
    classes = stored(_looked_up(documents, tied, "digest", fit).select("doc_id", "n", F.coalesce("component", "digest").alias("class")), "classes")
    several = stored(classes.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).where("members > 1").select("class", "least", F.lit(True).alias("several")), "several")
    joined = _looked_up(classes, several, "class", fit)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("several") & (F.col("n") > 0), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, fit: JoinFit, salts: int = 16) -> DataFrame:
    """Left join with a table of unique keys: by broadcast if that is small, else the rows of a key go to several tasks."""
    if table.count() <= fit.broadcast_rows:
        return rows.join(F.broadcast(table), key, "left")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(spread, [key, "salt"], "left").drop("salt")


def keep_representatives(docs: DataFrame, fit: JoinFit = JoinFit()) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with all columns.

    Documents without words stay, each being a component of its own, and so do rows of null doc_id, which nothing names.
    Of rows that repeat a doc_id one stays.
    """
    found = jaccard_components(docs, fit)
    marks = stored(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id")).where("doc_id is not null and (component_id <> doc_id or rows > 1)"), "marks")
    near = F.broadcast(marks) if marks.count() <= fit.broadcast_rows else marks
    rows, at = positional(docs)
    name = at["doc_id"]
    ids = lambda df: df.select(F.col("doc_id").alias(name))
    kept = rows.join(ids(near), name, "left_anti").select(rows.columns)
    twice = near.where("component_id = doc_id")
    if not twice.isEmpty():
        kept = kept.unionByName(rows.join(ids(twice), name, "left_semi").dropDuplicates([name]))
    return kept.toDF(*docs.columns)
