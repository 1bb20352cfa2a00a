"""Exact scatter, characteristic polynomial, roots and components against plain linear algebra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm.whitening import characteristic_polynomial, fit_whitener, fixed_point, largest_roots, null_vectors, polynomial_modulo, primes_below, scatter, whiten

SF = "/root/testdata/sf0.001"


def exact_polynomial(matrix):
    """By Faddeev and LeVerrier, in integers."""
    d = len(matrix)
    a, m, c = np.array(matrix, object), np.zeros((d, d), object), [0] * d + [1]
    for k in range(1, d + 1):
        m = a @ m + c[d - k + 1] * np.eye(d, dtype=int).astype(object)
        c[d - k] = -sum((a @ m)[i, i] for i in range(d)) // k
    return c


def gram(d, seed, rank=None):
    x = np.random.default_rng(seed).integers(-300, 300, (rank or d + 5, d)).astype(object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize(("d", "rank"), [(1, None), (2, None), (3, 1), (6, None), (9, 4), (12, None)])
def test_polynomial_is_exact(spark, d, rank):
    m = gram(d, d, rank)
    want = exact_polynomial(m)
    assert characteristic_polynomial(spark, m) == want
    p = primes_below(1 << 31, 1)[0]
    assert polynomial_modulo(np.array([[x % p for x in r] for r in m], np.int64), p).tolist() == [c % p for c in want]


def product(*roots):
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    return c


def test_roots_and_their_multiplicity():
    found = largest_roots(product(0, 0, 3, 5, 5, 10**30, 10**30 + 1), 4)
    assert [(round(float(r - e), 6), m) for (r, m), e in zip(found, (10**30 + 1, 10**30, 5))] == [(0, 1), (0, 1), (0, 2)]
    assert largest_roots(product(0, 0, 0), 4) == []
    assert [m for _, m in largest_roots(product(7, 7, 7, 2), 4)] == [3, 1]
    irrational = largest_roots([2, -4, 1], 2)  # 2 +- sqrt 2
    assert all(abs(float(r) - e) < 1e-15 for (r, _), e in zip(irrational, (2 + math.sqrt(2), 2 - math.sqrt(2))))


def test_vectors_of_a_double_root():
    m = [[2, 0, 0], [0, 7, 0], [0, 0, 7]]
    v = np.array(null_vectors(m, Fraction(7), 2), float)
    assert np.allclose(v @ v.T, np.eye(2)) and np.allclose(v[:, 0], 0)


def brute(x):
    x = np.unique(x, axis=0)
    v = np.cov(x.T.astype(float), bias=True)
    e, u = np.linalg.eigh(v)
    return x, e[::-1], u[:, ::-1], v


@pytest.mark.parametrize("count", [4, 70])
def test_given_vectors(spark, count):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {(r["vec_id"], r["component"]): r for r in whiten(table, count).collect()}
    given = {r["vec_id"]: np.floor(np.array(r["embedding"], float) * 256).astype(int) for r in table.collect()}
    x, e, u, v = brute(np.array(list(given.values())))
    k = min(count, len(e))
    assert len(rows) == k * len(given)
    n, s = len(x), x.sum(0)
    for i in range(k):
        got = np.array([rows[key, i + 1]["whitened"] for key in given])
        want = np.array([(given[key] - s / n) @ u[:, i] / np.sqrt(e[i]) for key in given])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
    for key, vector in given.items():
        r = rows[key, 1]
        assert (r["n"], r["deviation"]) == (n, int(((n * vector - s) ** 2).sum()))
        assert r["identity_error"] < 1e-9 and math.isclose(r["explained"], e[0] / np.trace(v), rel_tol=1e-10)


def odd_vectors(spark):
    rows = [(1, [0.5, 0.25, -1.0]), (1, [0.5, 0.25, -1.0]), (2, [0.5, 0.25, 9.0]), (None, [2.0, -0.001, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, []), (8, [1.0]), (9, [0.0, 3.0, 1.0])]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_odd_vectors(spark):
    table = odd_vectors(spark).select("*", F.lit("x").alias("x"), F.lit(1).alias("Embedding2"), F.lit(2).alias("component"))
    assert [(r["vec_id"], r["x"]) for r in fixed_point(table.where("vec_id is null")).collect()] == [(None, [512, -1, 0])]
    rows = whiten(table).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((str(i), k) for i in (1, 1, 2, None, 9) for k in (1, 2, 3))
    assert {r["n"] for r in rows} == {4} and all(r["identity_error"] < 1e-9 for r in rows)
    upper = table.select(F.lit("no").alias("EMBEDDING"), F.lit("no").alias("Vec_Id"), "*")
    assert len(whiten(upper).collect()) == len(rows)
    assert whiten(table.limit(0)).collect() == []
    assert whiten(table.where("vec_id = 1")).collect() == []  # one distinct vector has no variance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert {r["component"] for r in whiten(line).collect()} == {1}


def test_large_entries_stay_exact(spark):
    big = [[2.0**40, 1.0], [-(2.0**41), 5.0], [2.0**33, -7.0]]
    table = spark.createDataFrame(list(enumerate(big)), "vec_id bigint, embedding array<double>")
    sums = scatter(fixed_point(table).select("x").distinct())
    x = np.array([[int(c * 256) for c in v] for v in big], object)
    assert sums.sums == x.sum(0).tolist() and sums.matrix == (3 * x.T @ x - np.outer(x.sum(0), x.sum(0))).tolist()
    fit = fit_whitener(spark, sums, 2)
    assert np.allclose(fit.components @ fit.components.T, np.eye(2))
    assert all(r["deviation"] is None for r in whiten(table).collect())
