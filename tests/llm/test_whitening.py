import math
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry_point
from runloom.llm import char_poly, whitening


def exact_poly(matrix):
    """Constant coefficient first, by fractions and the traces of powers."""
    size = len(matrix)
    eye = [[Fraction(int(i == j)) for j in range(size)] for i in range(size)]
    coefficients, m = [Fraction(1)], eye
    for k in range(1, size + 1):
        product = [[sum(Fraction(a) * b for a, b in zip(row, col, strict=True))
                    for col in zip(*m, strict=True)] for row in matrix]
        c = -sum(product[i][i] for i in range(size)) / k
        coefficients.append(c)
        m = [[product[i][j] + c * eye[i][j] for j in range(size)] for i in range(size)]
    return [int(c) for c in reversed(coefficients)]


def poly(matrix):
    moduli = char_poly.enough_primes(len(matrix), sum(matrix[i][i] for i in range(len(matrix))))
    return char_poly.combine(moduli, [char_poly.poly_mod(matrix, p) for p in moduli])


def scatter(seed, rows, size, rank=None):
    r = np.random.default_rng(seed)
    x = r.integers(-50, 50, (rows, rank or size)).astype(object)
    if rank:
        x = x @ r.integers(-3, 4, (rank, size)).astype(object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize("matrix", [
    scatter(1, 20, 6), scatter(2, 3, 6), scatter(3, 10, 7, 4), [[0] * 3] * 3, [[5]],
    [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]],
    [[2, 0, 1, 0], [0, 2, 0, 1], [1, 0, 2, 0], [0, 1, 0, 2]],
    [[10**30, 1, 0], [1, 10**30, 0], [0, 0, 1]]])
def test_polynomial_roots_and_vectors(matrix):
    size = len(matrix)
    got = poly(matrix)
    assert got == exact_poly(matrix)
    rank = size - next(k for k, c in enumerate(got) if c)
    roots = char_poly.largest_roots(got, size)
    assert sum(times for *_, times in roots) == rank
    vectors = [char_poly.eigenvectors(matrix, *root) for root in roots]
    for (root, bits, _), some in zip(roots, vectors, strict=True):
        value = root / (1 << bits)
        for vector in some:
            error = np.array(matrix, float) @ vector - value * vector
            assert np.abs(error).max() <= 1e-12 * max(1.0, value)
    if vectors:
        every = np.vstack(vectors)
        assert np.abs(every @ every.T - np.eye(len(every))).max() < 1e-14


def test_roots_that_nearly_agree_are_told_apart():
    matrix = [[10**30, 1, 0], [1, 10**30, 0], [0, 0, 7]]
    roots = char_poly.largest_roots(poly(matrix), 3)
    assert [(root >> bits, times) for root, bits, times in roots] in (
        [(10**30 + 1, 1), (10**30 - 1, 1), (7, 1)], [(10**30 + 1, 1), (10**30 - 2, 1), (7, 1)],
        [(10**30, 1), (10**30 - 1, 1), (6, 1)], [(10**30 + 1, 1), (10**30 - 1, 1), (6, 1)])
    vectors = np.vstack([char_poly.eigenvectors(matrix, *r) for r in roots])
    assert np.allclose(np.abs(vectors), [[.5**.5, .5**.5, 0], [.5**.5, .5**.5, 0], [0, 0, 1]],
                       atol=1e-15)


def test_more_than_the_top_of_a_repeated_root():
    matrix = [[3 if i == j else 0 for j in range(6)] for i in range(6)]
    (root, bits, times), = char_poly.largest_roots(poly(matrix), 2)
    assert times == 6 and abs(root / (1 << bits) - 3) < 1e-15


def plain(vectors, components=16):
    """Rows of the contract by numpy: n, covariance, deviations, whitened values up to their signs."""
    kept = {}
    for key, vector in vectors:
        if vector and all(c is not None and math.isfinite(c) for c in vector):
            kept.setdefault(key, []).append([math.floor(64 * c) + 1_000_000 for c in vector])
    fit = np.array(sorted({tuple(x) for xs in kept.values() for x in xs}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    rows = {}
    for key, xs in kept.items():
        for x in xs:
            d = np.array(x, object) * n - sums
            w = (d.astype(float) / n) @ directions[:, order] / np.sqrt(values[order])
            rows.setdefault(key, []).append((int((d * d).sum()), w))
    return n, values[order] / values.sum(), rows


def check(rows, vectors, components=16):
    n, explained, want = plain(vectors, components)
    count = len(explained)
    assert len(rows) == count * sum(map(len, want.values()))
    assert {r["n"] for r in rows} == {n}
    assert {r["identity_error"] < 1e-9 for r in rows} == {True}
    by_key = {}
    for r in rows:
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        by_key.setdefault(r[0], []).append(r)
    signs = None
    for key, some in by_key.items():
        got = {}
        for r in some:
            got.setdefault(r["component"], set()).add((r["deviation"], round(r["whitened"], 6)))
        assert {d for d, _ in want[key]} == {r["deviation"] for r in some}
        if len(want[key]) == 1:
            w = np.array([next(iter(got[c]))[1] for c in range(1, count + 1)])
            if signs is None:
                signs = np.sign(w * want[key][0][1])
            assert np.allclose(w, signs * want[key][0][1], atol=2e-6)


def test_query_against_numpy(spark, sf_dir):
    rows = entry_point.queries()["op11_whitening"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(rows, table)


def test_odd_vectors(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(0, 5, 4).tolist(), "clash", 1) for i in range(60)]
    rows += [(7, rows[3][1], None, 2), (None, rows[4][1], None, 2), (61, None, None, 0),
             (62, [1.0, None, 2.0, 3.0], "", 0), (63, [1.0, math.nan, 0.0, 0.0], "", 0),
             (64, [math.inf, 0.0, 0.0, 0.0], "", 0), (65, [], "", 0), (66, [0.0] * 4, "", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n int")
    check(whitening.whiten(df).collect(), [r[:2] for r in rows])
    short = df.unionByName(spark.createDataFrame([(99, [1.0, 2.0], "", 1)], df.schema))
    assert whitening.whiten(short).filter("vec_id = 99").count() == 0


def test_large_entries_are_exact(spark):
    r = np.random.default_rng(9)
    rows = [(i, (r.normal(0, 1, 3) * [1e9, 1.0, 2**40]).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    fit = whitening.coded(df, "embedding").distinct()
    n, sums, matrix = whitening.exact_sums(fit, 3)
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], object)
    assert (n, sums) == (50, x.sum(axis=0).tolist())
    assert matrix == (50 * (x.T @ x) - np.outer(x.sum(axis=0), x.sum(axis=0))).tolist()
    got = whitening.whiten(df).collect()
    assert {g["deviation"] for g in got} == {None} and len(got) == 150
    assert got[0]["identity_error"] < 1e-9


def test_without_variance_and_without_rows(spark):
    schema = "vec_id long, embedding array<float>"
    flat = [(i, [1.0, float(i), 2.0]) for i in range(5)]
    rows = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert len(rows) == 15
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in rows)
    assert {(r["component"], r["explained"]) for r in rows} == {(1, 1.0), (2, 0.0), (3, 0.0)}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"])
            for r in one] == [(1, 0, None, None, None)] * 4
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
