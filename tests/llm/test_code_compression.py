"""Vector codes against plain k-means in integers, and their defined cases."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from quayside.llm import code_compression
from quayside.llm.code_compression import distances, fixed_pivots, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.floor(1024 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64)
    cut = np.split(x, parts, axis=1)
    books = [c[:entries].copy() for c in cut]
    for k in range(rounds + 1):
        squares = [((c[:, None, :] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books)]
        codes = [s.argmin(axis=1) for s in squares]
        if k < rounds:
            for c, b, code in zip(cut, books, codes):
                for e in set(code.tolist()):
                    b[e] = c[code == e].sum(axis=0) // (code == e).sum()
    error = sum(s.min(axis=1) for s in squares)
    by_label: dict = {}
    for r, x in zip(rows, error.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + x
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), by_label[r[2]], sha) for i, r in enumerate(rows)), key=repr
    )


def test_nearest_entry_is_exact():
    rng = np.random.default_rng(5)
    for spread in (3, 600, 2**20):
        x = rng.integers(-spread, spread, (700, 5))
        book = x[:100].copy()
        book[50:60] = book[:10]  # ties go to the lower index
        pivots = fixed_pivots(book, 8)
        index, best, evaluated = nearest(x, distances(x, pivots), book, distances(book, pivots))
        squares = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
        assert evaluated < squares.size


def test_clusters_are_pruned():
    """Where entries lie apart, most of them are never compared."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-100_000, 100_000, (256, 4))
    x = centres[rng.integers(0, 256, 2000)] + rng.integers(-50, 50, (2000, 4))
    pivots = fixed_pivots(centres, 8)
    _, _, evaluated = nearest(x, distances(x, pivots), centres, distances(centres, pivots))
    assert evaluated < 0.1 * 2000 * 256


def test_against_plain(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(v) for v in rng.integers(-700, 700, 8) / np.float32(1000)], None if i % 3 == 0 else int(i % 5)) for i in rng.permutation(700)]
    rows += rows[:40]  # repeated rows
    found = code_compression.compress(spark.createDataFrame(rows, SCHEMA))
    floats = [(i, np.array(v, dtype=np.float32).tolist(), x) for i, v, x in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(floats)


def test_few_vectors_and_left_out_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, [0.5, -0.25, 1.0, 2.0], 1), (3, [0.5, 0.25, 1.0, 2.0], None), (None, [0.5, -0.25, 1.0, -2.0], None)]
    bad = [(1, None, 1), (2, [nan, 0.0, 0.0, 0.0], 1), (0, [0.0, -inf, 0.0, 0.0], 1), (9, [None, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame([(*r, 5, "y") for r in good + bad], SCHEMA + ", code int, Error string")
    assert sorted(map(tuple, code_compression.compress(df).collect()), key=repr) == plain(good)
    assert code_compression.compress(df.limit(0)).collect() == []
    assert code_compression.compress(df.where("vec_id = 1")).collect() == []
    for rows, words in (([(1, [1.0, 2.0, 3.0], 0)], "equal parts"), ([(1, [1e14] * 4, 0)], "too large"), ([(1, [1e9] * 4, 0)], "exceed a long")):
        with pytest.raises(Exception, match=words):
            code_compression.compress(spark.createDataFrame(rows, SCHEMA)).collect()
