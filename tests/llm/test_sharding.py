from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from conftest import SF

from quayside.llm import queries, sharding


def test_query(spark):
    rows = queries.op9_hypergeometric_shards(spark, SF).collect()
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert Counter((r.shard, r.slot) for r in rows) == Counter((k, s) for k in counts for s in range(counts[k]))


def test_uniform_and_repeatable(spark):
    df = spark.range(0, 24, 1, 5).selectExpr("id", "id % 2 as shard", "'x' as _place", "array(id) as slot")
    at = Counter()
    for seed in range(40):
        rows = sharding.shuffle(df, 3, seed, target_rows=3).collect()
        assert sorted(r[0] for r in rows) == list(range(24)) and all(r[3] == [r[0]] for r in rows)
        at.update((r[0] < 5, 8 * r["shard_"] + r["slot_"] < 8) for r in rows)
    expected = 40 * 5 / 3
    assert abs(at[True, True] - expected) < 5 * np.sqrt(expected)
    a, b = (sorted(map(tuple, sharding.shuffle(df.drop("slot"), 3, 1).collect())) for _ in range(2))
    assert a == b


def test_matrix_and_edges(spark):
    m = sharding.matrix([5, 0, 7], [4, 4, 4], 1)
    assert m.sum(axis=0).tolist() == [4, 4, 4] and m.sum(axis=1).tolist() == [5, 0, 7]
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 750_000) < 5 * np.sqrt(10**6 * 3 / 16 / 50)
    assert sharding.hypergeometric(rng, 2 * 10**9, 0, 5) == 5
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shuffle(none).collect() == []
    few = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shuffle(few).collect()) == [0, 0]


def test_tree_of_matrices(spark):
    """Lines of a deep tree add up to the partitions and to the targets, and cells have the right means."""
    sizes = {0: 700, 3: 1, 64: 250, 70: 0, 200: 1049}
    df = spark.createDataFrame(list(sizes.items()), "part long, n long")
    rows = sharding.lines(df, 2000, 3, 5, 11).collect()
    assert Counter({k: n for k, n in sizes.items() if n}) == sum((Counter({r.part: r.n}) for r in rows), Counter())
    targets = sum((Counter({(r.shard, r["first"], r.rows): r.n}) for r in rows), Counter())
    assert all(n == key[2] <= 11 for key, n in targets.items())
    for k, n in enumerate([667, 667, 666]):
        own = sorted((first, rows) for shard, first, rows in targets if shard == k)
        assert [a for a, _ in own] == [sum(r for _, r in own[:j]) for j in range(len(own))] and sum(r for _, r in own) == n
    means = np.mean([sharding.matrix([700, 250, 1049], [667, 667, 665], s) for s in range(300)], axis=0)
    assert np.abs(means - np.outer([700, 250, 1049], [667, 667, 665]) / 1999).max() < 3


def test_ties_and_long_texts(spark):
    """Rows that are equal in all columns keep a slot each; a long text is one row."""
    df = spark.createDataFrame([(1, "x")] * 50 + [(None, "y" * 2_000_000)], "doc_id long, text string").repartition(4)
    rows = sharding.shuffle(df, 4, target_rows=5).collect()
    assert Counter((r.doc_id, len(r.text)) for r in rows) == {(1, 1): 50, (None, 2_000_000): 1}
    assert Counter((r["shard"], r.slot) for r in rows) == Counter((k, s) for k, n in enumerate([13, 13, 13, 12]) for s in range(n))


def test_beyond_numpys_limit():
    """Draws from more than 10**9 rows: exact sums, means within five deviations."""
    rng = np.random.default_rng(4)
    held = np.array([9 * 10**8, 6 * 10**8, 5 * 10**8])
    drawn = np.array([sharding.spread(rng, held, 10**6) for _ in range(50)])
    assert (drawn.sum(axis=1) == 10**6).all()
    shares = held / held.sum()
    assert (np.abs(drawn.mean(axis=0) - 10**6 * shares) < 5 * np.sqrt(10**6 * shares * (1 - shares) / 50)).all()
