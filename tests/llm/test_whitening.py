"""Whitening against exact integers and numpy's own eigenvectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from remitlens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, label int"


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "diagonal", "blocks", "low rank", "two", "one", "zero", "graded"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(3)
    n = {"two": 2, "one": 1}.get(kind, 40)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {
        "clusters": np.repeat([5.0, 5.0 + 1e-9, 1.0, 0.5], 10), "equal": np.full(n, 3.0), "low rank": np.r_[[7.0, 2.0, 1.0], np.zeros(37)],
        "zero": np.zeros(n), "graded": 10.0 ** -np.linspace(0, 9, 40),
    }.get(kind, rng.uniform(0.1, 4, n))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    if kind == "diagonal":
        a = np.diag(values)
    if kind == "blocks":
        a[:20, 20:] = a[20:, :20] = 0
        a[20:, 20:] = a[:20, :20]
    k = min(16, n)
    e, u = whitening.leading_eigenvectors(a, k)
    expected = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.allclose(e, expected, rtol=1e-12, atol=1e-13 * max(1e-300, abs(expected).max()))
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12
    assert np.abs(a @ u - u * e).max() <= 2e-13 * max(abs(expected).max(), 1e-300)


def brute(rows, k=16):
    """Exact integers and fractions; eigenvectors by numpy."""
    kept = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in kept]
    fit = sorted({x for _, x in grid})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(d)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in grid:
        dev = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        y = np.array([float(Fraction(n * x[j] - s[j], n)) for j in range(d)]) @ u / np.sqrt(e)
        out.setdefault(i, []).append((dev, y))
    return n, e / np.trace(v), out


def check(result, rows):
    n, shares, expected = brute(rows)
    got = {}
    for r in result:
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == set(expected)
    for i, vectors in expected.items():
        own = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in own] == sorted([*range(1, len(shares) + 1)] * len(vectors))
        for r in own:
            assert r.n == n and r.deviation == vectors[0][0] and r.deviation_digits == str(r.deviation)
            assert abs(abs(r.whitened) - abs(vectors[0][1][r.component - 1])) < 1e-8
            assert abs(r.explained / shares[r.component - 1] - 1) < 1e-10
            assert r.identity_error < 1e-10
    for k in range(1, len(shares) + 1):  # one sign per component
        signs = {np.sign(r.whitened * expected[r.vec_id][0][1][k - 1]) for r in result if r.component == k and abs(r.whitened) > 1e-6}
        assert len(signs) <= 1


def test_whitening_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(20)], "x", 1) for i in range(150)]
    rows += [(1000 + i, rows[0][1], "x", 1) for i in range(80)] + [rows[3], (None, rows[4][1], None, None)]
    rows += [(2000, None, "x", 1), (2001, [], "x", 1), (2002, [1.0] * 19 + [None], "x", 1), (2003, [float("nan")] * 20, "x", 1)]
    rows += [(2004, [float("inf")] * 20, "x", 1), (2005, [-1.0] * 20, "x", 1)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = whitening.fit_whitening(vectors)
    out = whitening.whiten(vectors, model)
    assert out.columns == ["vec_id", "embedding", "label", "deviation", "deviation_long", "whitened"]
    check(whitening.components(model, out).collect(), rows)


def test_degenerate_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)

    def components(rows):
        model = whitening.fit_whitening(frame(rows))
        return whitening.components(model, whitening.whiten(frame(rows), model)).collect()

    assert components([]) == []
    assert components([(1, None, "", 1)]) == []
    assert components([(1, [1.0, 2.0], "", 1)]) == []
    assert components([(1, [1.0, 2.0], "", 1), (2, [1.0, 2.0], "", 1)]) == []
    line = [(i, [float(i), 5.0], "", 1) for i in range(4)]
    assert {(r.vec_id, r.component) for r in components([*line, (9, [1.0, 2.0, 3.0], "", 1)])} == {(i, 1) for i in range(4)}
    # values beyond double precision of n x - S stay exact
    far = [(1, [2.0**54], "", 1), (2, [0.0], "", 1), (3, [1.0], "", 1)]
    got = {r.vec_id: r for r in components(far)}
    x = [(1 << 60) + 1_000_000, 1_000_000, 1_000_064]
    assert [got[i].deviation_digits for i in (1, 2, 3)] == [str((3 * a - sum(x)) ** 2) for a in x]
    assert got[1].deviation is None and abs(got[1].explained - 1) < 1e-12


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(queries.QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect(), rows)
