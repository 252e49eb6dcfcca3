"""Exact whitening against NumPy's eigenvectors, and its defined cases."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.llm import queries, whitening
from quayside.llm.vectors import integers
from quayside.llm.whitening import component, exact_products, isolate, polynomial_mod, primes_for, roots_above, squared_lengths

SCHEMA = "vec_id long, embedding array<float>, label int"


def leading_minors(matrix) -> list[int]:
    """Characteristic polynomial by Faddeev and LeVerrier, in fractions; the constant first."""
    a = np.array(matrix, dtype=object)
    d = len(a)
    out, m = [1], np.zeros((d, d), dtype=object)
    for k in range(1, d + 1):
        m = a.dot(m) + np.array([[out[-1] if i == j else 0 for j in range(d)] for i in range(d)], dtype=object)
        out.append(int(Fraction(-sum(a.dot(m)[i, i] for i in range(d)), k)))
    return out[::-1]


@given(st.integers(1, 5).flatmap(lambda d: st.lists(st.lists(st.integers(-9, 9), min_size=d, max_size=d), min_size=d, max_size=d)))
@settings(max_examples=60, deadline=None)
def test_polynomial_modulo_a_prime(rows):
    a = np.array(rows, dtype=object)
    for p in (7, 2**31 - 1):
        assert polynomial_mod(a, p) == [c % p for c in leading_minors(rows)]
        assert polynomial_mod(a.T.dot(a), p) == [c % p for c in leading_minors(a.T.dot(a))]


@given(st.lists(st.integers(0, 6), min_size=1, max_size=7))
@settings(max_examples=60, deadline=None)
def test_roots(roots):
    p = [1]
    for r in roots:
        p = [(p[i - 1] if i else 0) - r * (p[i] if i < len(p) else 0) for i in range(len(p) + 1)]
    for a in range(8):
        assert roots_above(p, a) == sum(r > a for r in roots)
    for k, r in enumerate(sorted(roots, reverse=True), 1):
        found = isolate(p, k)
        assert (found is None) == (r == 0)
        if found:
            assert found[0] == r << found[1] and found[2] == sum(x > r for x in roots)


def test_equal_roots_have_orthogonal_components():
    base = np.array([[1, 1, 0, 0], [1, -1, 0, 0], [0, 0, 1, 1], [0, 0, 1, -1]], dtype=object)
    matrix = base.dot(np.diag([5, 5, 5, 2]).astype(object)).dot(base.T)
    p = leading_minors(matrix)
    found = []
    for k in range(1, 5):
        root, shift, larger = isolate(p, k)
        found.append(component(matrix, root, shift, k - larger - 1))
    v = np.array(found)
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-15
    assert np.abs(v @ matrix.astype(float) @ v.T - np.diag([10, 10, 10, 4])).max() < 1e-13


def test_exact_sums():
    rng = np.random.default_rng(0)
    for most in (9, 2**20, 2**45):
        u = rng.integers(-most, most, (50, 3))
        assert (exact_products(u, u) == u.T.astype(object).dot(u.astype(object))).all()
        assert squared_lengths(u) == [sum(int(x) ** 2 for x in row) for row in u]
    big = np.array([[2**61, -(2**61)]], dtype=object)
    assert squared_lengths(big) == [2**123]
    assert all(p > 2 and all(p % q for q in range(3, 1000, 2)) for p in primes_for(2**200))


def plain(rows: list[list[float]], k: int = 8):
    u = np.floor(1024 * np.array(rows, dtype=np.float64))
    centred = u - u.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(u))
    return e[::-1][:k], v[:, ::-1][:, :k], centred, e.sum()


def test_query(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id")
    e, v, centred, trace = plain(t["embedding"].to_pylist())
    found = queries.op11_characteristic_whitening(spark, SF).collect()
    n = len(t)
    assert len(found) == 8 * n and {r.n for r in found} == {n}
    x = integers(t["embedding"].combine_chunks(), 64).astype(object) + 100_000
    deviations = (((n * x - x.sum(axis=0)) ** 2).sum(axis=1)).tolist()
    by = {(r.vec_id, r.component): r for r in found}
    ids = t["vec_id"].to_pylist()
    assert [by[i, 1].deviation for i in ids] == deviations
    for k in range(8):
        mine = np.array([by[i, k + 1].whitened for i in ids])
        other = centred @ v[:, k] / np.sqrt(e[k])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-7
        assert abs(by[ids[0], k + 1].explained / (e[k] / trace) - 1) < 1e-12
    assert found[0].identity_error < 1e-12


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.0, 0.25], 1), (1, [0.5, 0.0, 0.25], None), (None, [-0.5, 0.0, 1.0], 2), (4, None, 3), (5, [nan, 0.0, 0.0], 3),
            (6, [inf, 0.0, 0.0], 3), (7, [None, 0.0, 0.0], 3), (8, [-0.25, 0.0, -3.0], 3)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", whitened string, N int")
    found = whitening.whiten(df).collect()
    e, v, centred, trace = plain([r[1] for r in rows if r[0] in (1, None, 8)])
    assert len(found) == 4 * 2  # the second dimension has no variance, so it has no component
    assert {r.n for r in found} == {4} and sorted({r.component for r in found}) == [1, 2]
    assert {r.vec_id for r in found} == {1, None, 8}
    assert abs(found[0].explained - e[found[0].component - 1] / trace) < 1e-12 and found[0].identity_error < 1e-12
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)).count() == 0
    # a circle's four points: equal roots
    square = [(i, [a, b], 0) for i, (a, b) in enumerate([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)])]
    found = whitening.whiten(spark.createDataFrame(square, SCHEMA)).collect()
    assert len(found) == 8 and {r.explained for r in found} == {0.5} and found[0].identity_error < 1e-14


def test_refused(spark):
    with pytest.raises(Exception, match="components in one table"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0], 0)], SCHEMA)).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 2.0], 0)], SCHEMA)).collect()
