"""Whitening of vectors whose covariance is known exactly, as a matrix of integers.

Entries are rounded down to whole 256ths, so counts, sums and products of the distinct vectors are integers and their
scatter n * sum(x x') - S S' is exact.  Its characteristic polynomial comes from residues: each Spark task reduces the
matrix to Hessenberg form modulo some primes, and Chinese remaindering joins the coefficients.  All its roots are real and
none is negative, so sign changes of shifted coefficients count roots exactly and bisection isolates them to any precision.
Components are null vectors of the scatter minus a root, by inverse iteration in that precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import positional, stored

#: Binary places of a vector's entries.
SCALE = 256.0
#: A sum is high * 10**30 + low, so any number of products of longs can be added up.
_CELLS, _BASE = "i int, j int, high decimal(38,0), low decimal(38,0)", 10**30


@dataclass(frozen=True)
class Scatter:
    """Of the distinct vectors: how many, sums of entries, and n * sum(x x') - S S' as Python integers."""

    n: int
    sums: list[int]
    matrix: list[list[int]]


@dataclass(frozen=True)
class Whitener:
    """mean, and the components as rows with their eigenvalues; ``explained`` is each eigenvalue's part of the trace."""

    scatter: Scatter
    mean: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


# ---- whole vectors, distinct vectors, their exact scatter


def fixed_point(vectors: DataFrame) -> DataFrame:
    """vec_id and x (whole 256ths, rounded down) of the rows whose vector is not null and holds finite entries alone.

    Vectors of another length than the most frequent one (the longer, if two are as frequent) take no part, nor do empty
    ones.  Entries beyond a long become the nearest one.
    """
    rows, at = positional(vectors)
    v = F.col(at["embedding"]).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(fine).select(F.col(at["vec_id"]).alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE)).alias("x"))
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return kept.join(F.broadcast(lengths.select("d")), F.size("x") == F.col("d")).drop("d")


def scatter(distinct: DataFrame) -> Scatter:
    """Exact sums over the distinct vectors (x).  A task sums its vectors' products in blocks that 53 bits hold, or in Python
    integers where entries are too large for that; Spark adds up the cells, and d * d of them come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cells = 0, None, None
        for batch in batches:
            x = batch.column("x")
            if not batch.num_rows:
                continue
            x = x.flatten().to_numpy().reshape(batch.num_rows, -1)
            d = x.shape[1]
            most = max(1, int(x.max()), -int(x.min()))
            n, sums = n + len(x), [0] * d if sums is None else sums
            cells = np.zeros((d, d), object) if cells is None else cells
            rows = (1 << 53) // (most * most)
            for i in range(0, len(x), max(1, min(rows, 4096))):
                part = x[i : i + max(1, min(rows, 4096))]
                part = part.astype(float if rows else object)
                product = part.T @ part
                cells += product.astype(np.int64).astype(object) if rows else product
            sums = [a + int(b) for a, b in zip(sums, x.astype(object).sum(0) if most > 1 << 40 else x.sum(0))]
        if n:
            i, j = np.triu_indices(len(sums))
            values = [divmod(v, _BASE) for v in [n, *sums, *cells[i, j].tolist()]]
            at = np.arange(len(sums))
            where = [np.concatenate([[-1], at * 0 - 1, i]), np.concatenate([[-1], at, j])]  # -1: the count, then the sums
            parts = [pa.array([Decimal(v[k]) for v in values], pa.decimal128(38, 0)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array(w.astype(np.int32)) for w in where), *parts], names=["i", "j", "high", "low"])

    got = distinct.select("x").mapInArrow(work, _CELLS).groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    by = {(r["i"], r["j"]): int(r["high"]) * _BASE + int(r["low"]) for r in got}
    if not by:
        return Scatter(0, [], [])
    n, d = by[-1, -1], max(j for _, j in by) + 1
    s = [by[-1, k] for k in range(d)]
    return Scatter(n, s, [[n * by[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)])


# ---- characteristic polynomial


def primes_below(top: int, count: int) -> list[int]:
    """The largest primes below ``top``, which no factor up to its root divides."""
    small = np.ones(math.isqrt(top) + 1, bool)
    small[:2] = False
    for p in range(2, math.isqrt(len(small)) + 1):
        if small[p]:
            small[p * p :: p] = False
    divisors, out, n = np.flatnonzero(small), [], top - 1
    while len(out) < count:
        if n % 2 and np.all(n % divisors):
            out.append(n)
        n -= 1
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - A) modulo a prime below 2**31, constant first: A is brought to Hessenberg form by steps
    that keep the polynomial, which then follows from its leading minors."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        h[[k + 1, pivot]] = h[[pivot, k + 1]]
        h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        by = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - by[:, None] * h[k + 1] % p) % p
        # each product is below 2**62, so it is reduced before sums
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * by % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for m in range(1, d + 1):
        minors[m, 1:] = minors[m - 1, :-1]
        minors[m] = (minors[m] - h[m - 1, m - 1] * minors[m - 1]) % p
        chain = 1
        for i in range(1, m):
            chain = chain * int(h[m - i, m - i - 1]) % p
            if not chain:
                break
            minors[m] = (minors[m] - chain * int(h[m - i - 1, m - 1]) % p * minors[m - i - 1]) % p
    return minors[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, constant first, of a symmetric matrix without negative eigenvalues.

    Its eigenvalues add up to the trace, which bounds the coefficients and so the number of primes.  Each task takes some
    primes; d + 1 residues a prime come to the driver.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    most = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * most).bit_length() // 30 + 1)
    residues = lambda p: np.array([[x % p for x in row] for row in matrix], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [primes[k] for k in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([polynomial_modulo(residues(p), p).tolist() for p in found], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism * 2))
    out, modulus = [0] * (d + 1), 1
    for p, c in sorted(spark.range(0, len(primes), 1, tasks).mapInArrow(work, "p bigint, c array<bigint>").collect()):
        again = pow(modulus, -1, p)
        out = [a + modulus * ((b - a) * again % p) for a, b in zip(out, c)]
        modulus *= p
    return [a - modulus if 2 * a > modulus else a for a in out]


# ---- roots


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """How many roots, with their multiplicity, lie above num / 2**bits, of a polynomial whose roots are all real: the sign
    changes of its coefficients around that point (Descartes' rule is exact for real roots)."""
    d = len(poly) - 1
    c = [a << (bits * (d - k)) for k, a in enumerate(poly)]  # of 2**(bits d) p(t / 2**bits), whose roots are times 2**bits
    for k in range(d):
        for j in range(d - 1, k - 1, -1):
            c[j] += num * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value_sign(poly: list[int], num: int, bits: int) -> int:
    total, scale = 0, 1
    for a in reversed(poly):
        total = total * num + a * scale
        scale <<= bits
    return (total > 0) - (total < 0)


def largest_roots(poly: list[int], count: int, precision: int = 200) -> list[tuple[Fraction, int]]:
    """The largest positive roots and how often each counts, falling, until ``count`` of them are there with multiplicity.

    Intervals are halved until each holds one root, or several that agree in ``precision`` bits, which count as one of that
    multiplicity; a single root is then halved by the sign of the polynomial alone.
    """
    d = len(poly) - 1
    zeros = next(k for k, a in enumerate(poly) if a)
    poly = poly[zeros:]
    want = min(count, d - zeros)
    if not want:
        return []
    top = max(-poly[-2] if len(poly) > 1 else 0, 1).bit_length() + 1  # the sum of the roots bounds them
    found: list[tuple[Fraction, int]] = []
    open_ = [(0, 1, -top, len(poly) - 1, 0)]  # roots above low / 2**bits and up to high / 2**bits; counts above low, above high
    while open_ and sum(m for _, m in found) < want:
        low, high, bits, above_low, above_high = open_.pop()
        inside = above_low - above_high
        if inside == 1 and low > 0:
            low, high, bits = (low << -bits, high << -bits, 0) if bits < 0 else (low, high, bits)
            sign = _value_sign(poly, high, bits)
            while sign and (high - low) << (precision) > high:
                low, high, bits = 2 * low, 2 * high, bits + 1
                middle = (low + high) // 2
                at = _value_sign(poly, middle, bits)
                if at == 0:
                    low = high = middle
                elif at == sign:
                    high = middle
                else:
                    low = middle
            found.append((Fraction(high) / Fraction(2) ** bits, 1))
            continue
        if low > 0 and (high - low) << precision <= high:
            found.append((Fraction(high) / Fraction(2) ** bits, inside))
            continue
        low, high, bits = 2 * low, 2 * high, bits + 1
        middle = low + (high - low) // 2
        above = roots_above(poly, middle, bits) if bits >= 0 else roots_above(poly, middle << -bits, 0)
        for part in ((low, middle, bits, above_low, above), (middle, high, bits, above, above_high)):  # the upper half is next
            if part[3] > part[4]:
                open_.append(part)
    return found


# ---- components


def null_vectors(matrix: list[list[int]], root: Fraction, count: int, digits: int = 90) -> list[list[Decimal]]:
    """``count`` orthonormal vectors that the matrix maps to ``root`` times themselves, by inverse iteration in decimals.

    The shifted matrix is factored once, with row pivots; starts differ by a fixed pattern, and each vector is kept at
    right angles to those before it.
    """
    d = len(matrix)
    with localcontext(Context(prec=digits)) as context:
        lam = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= lam
        least = max((abs(x) for x in a.ravel()), default=Decimal(1)) * Decimal(10) ** (15 - digits) or Decimal(1)
        order = np.arange(d)
        for k in range(d):
            p = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, p]], order[[k, p]] = a[[p, k]], order[[p, k]]
            if abs(a[k, k]) < least:
                a[k, k] = least
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solved(b: np.ndarray) -> np.ndarray:
            y = b[order].copy()
            for k in range(1, d):
                y[k] -= a[k, :k] @ y[:k]
            for k in reversed(range(d)):
                y[k] = (y[k] - (a[k, k + 1 :] @ y[k + 1 :] if k + 1 < d else 0)) / a[k, k]
            return y

        found: list[np.ndarray] = []
        for m in range(count):
            v = np.array([Decimal(1 + (i * (2 * m + 3) + m * m) % (d + 7)) for i in range(d)], object)
            for _ in range(4):
                for _ in range(2):
                    for u in found:
                        v = v - u * (u @ v)
                v = v / max(abs(x) for x in v)
                v = solved(v)
                v = v / max(abs(x) for x in v)
            for _ in range(2):
                for u in found:
                    v = v - u * (u @ v)
                v = v / (v @ v).sqrt(context)
            found.append(v)
    return [v.tolist() for v in found]


def fit_whitener(spark: SparkSession, sums: Scatter, count: int = 4) -> Whitener:
    """The first components, by falling eigenvalue; those without variance have no unit of length and are left out."""
    d = len(sums.sums)
    trace = sum(sums.matrix[i][i] for i in range(d))
    mean = np.array([s / sums.n for s in sums.sums])
    rows, values, parts = [], [], []
    if trace:
        for root, times in largest_roots(characteristic_polynomial(spark, sums.matrix), count):
            for v in null_vectors(sums.matrix, root, min(times, count - len(rows))):
                rows.append([float(x) for x in v])
                values.append(float(root / (sums.n * sums.n)))
                parts.append(float(root / trace))
    return Whitener(sums, mean, np.array(rows).reshape(len(rows), d), np.array(values), np.array(parts))


def projections(rows: DataFrame, fit: Whitener) -> DataFrame:
    """The rows (x and others) with deviation and whitened (an array, one entry a component).

    deviation is exact, and null where a long can't hold it.  x - S/n is taken as (n x - S) / n, so its entries are correct
    to a rounding however large n is.
    """
    n, s = fit.scatter.n, fit.scatter.sums
    by = (fit.components / np.sqrt(fit.eigenvalues)[:, None]).T / n if n else None
    most = max(map(abs, s), default=0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(s)), np.int64)
            bound = n * max(int(x.max()), -int(x.min())) + most if x.size else 0
            if len(s) * bound * bound < 1 << 62:
                apart = x * n - np.array(s, np.int64)
                deviation = pa.array((apart * apart).sum(1))
            else:
                apart = x.astype(object) * n - np.array(s, object)
                deviation = pa.array([v if v < 1 << 63 else None for v in (apart * apart).sum(1).tolist()] if len(x) else [], pa.int64())
            white = apart.astype(float) @ by
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * by.shape[1]), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, deviation, lists], names=[*batch.schema.names, "deviation", "whitened"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{kept}, deviation bigint, whitened array<double>")


def identity_error(distinct: DataFrame, fit: Whitener) -> float:
    """The largest entry of the distinct vectors' whitened covariance minus the identity, measured on the vectors."""
    k = len(fit.eigenvalues)
    white = projections(distinct.select("x"), fit).select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(k)])
    got = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(vectors: DataFrame, count: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every vector and component.

    Fitted on each distinct vector once.  Null vectors and such with null or other than finite entries take no part, nor do
    those of an unusual length; repeated ids and vectors repeat, null ids stay.  Components without variance are left out,
    so one distinct vector, or none, gives no rows.  Vectors that vary in fewer directions have fewer components.  Components
    of equal eigenvalues are any orthonormal ones of their space, the same for all rows.
    """
    spark = vectors.sparkSession
    rows = stored(fixed_point(vectors), "whitening-rows")
    distinct = stored(rows.select("x").distinct(), "whitening-fit")
    sums = scatter(distinct)
    fit = fit_whitener(spark, sums, count) if sums.n else None
    if fit is None or not len(fit.eigenvalues):
        none = "cast(null as int) component, 0L n, 0L deviation, 0D whitened, 0D explained, 0D identity_error"
        return rows.where("false").selectExpr("vec_id", *none.split(", "))
    error = identity_error(distinct, fit)
    parts = F.array(*[F.lit(float(p)) for p in fit.explained])
    out = projections(rows, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(sums.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(parts, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
