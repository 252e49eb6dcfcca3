"""Order-dependent helpers against plain loops, with hot keys and tiny segments."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.operators.islands import runs
from quayside.operators.ordered import TOP, Jumps, running, with_position
from quayside.operators.transfers import adaptive_sizes, next_size, throttle_reports
from quayside.plans.bandwidth import token_bucket
from quayside.plans.transfer import assign_batches

SEGMENTS = 13


@pytest.fixture(scope="module")
def log(spark):
    """600 events; one key holds half of them, and times tie."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        rows.append((i, key, rng.randrange(400) * 250, rng.randrange(0, 900_000), rng.randrange(0, 30), rng.random() * 7))
    return rows, spark.createDataFrame(rows, "event_id long, key string, ms long, size long, files long, seconds double")


def _by_key(rows, order):
    groups = {}
    for row in sorted(rows, key=order):
        groups.setdefault(row[1], []).append(row)
    return groups


def test_running_and_totals(log):
    rows, df = log
    out = running(
        df, ["key"], ["ms", "event_id"], {"upto": "size"}, totals={"upto": "total"}, lows={"start": "ms"}, segments=SEGMENTS
    )
    got = {r.event_id: (r.upto, r.total, r.start) for r in out.collect()}
    want = {}
    for group in _by_key(rows, lambda r: (r[2], r[0])).values():
        total, start, upto = sum(r[3] for r in group), min(r[2] for r in group), 0
        for r in group:
            upto += r[3]
            want[r[0]] = (upto, total, start)
    assert got == want


def test_position_without_key(log):
    rows, df = log
    got = {r.event_id: r.position for r in with_position(df.select("event_id", "ms"), [], ["ms", "event_id"]).collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


def test_throttle(log):
    rows, df = log
    got = {r.event_id: r.reported for r in throttle_reports(df, ["key"], "ms", "event_id", 1000, SEGMENTS).collect()}
    want = {}
    for group in _by_key(rows, lambda r: (r[2], r[0])).values():
        last = group[0][2]
        for r in group:
            want[r[0]] = r[2] - last >= 1000
            last = r[2] if want[r[0]] else last
    assert got == want and any(want.values())


def test_null_key_is_one_key(spark):
    rows = [(None if i % 2 else 1, i * 400, i) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, ms long, event_id long")
    got = {r.event_id for r in throttle_reports(df, ["key"], "ms", "event_id", 1000, SEGMENTS).collect() if r.reported}
    want = set()
    for odd in (0, 1):
        last = odd * 400
        for i in range(odd, 300, 2):
            if i * 400 - last >= 1000:
                want.add(i)
                last = i * 400
    assert got == want


@pytest.mark.parametrize("segments", [1, 7, 64])
def test_one_key_over_all_segments(spark, segments):
    """What segments do is put together over any number of them."""
    rng = random.Random(11)
    rows = [(i, i * 90 + rng.randrange(3), rng.randrange(120)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ms long, size long")
    got = [r.reported for r in throttle_reports(df, [], "ms", "event_id", 1000, segments).orderBy("event_id").collect()]
    last, want = rows[0][1], []
    for _, ms, _ in rows:
        want.append(ms - last >= 1000)
        last = ms if want[-1] else last
    assert got == want
    files = df.selectExpr("lpad(event_id, 4, '0') AS path", "size")
    got = [r.batch for r in assign_batches(files, ["path"], 700, 1000, segments=segments).orderBy("path").collect()]
    batch, used, want = 0, 0, []
    for i, (_, _, size) in enumerate(rows):
        if used + size > 700 and i and want:
            batch, used = batch + 1, 0
        want.append(batch)
        used += size
    assert got == want


@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(0, 90))
@settings(max_examples=200, deadline=None)
def test_jumps_put_together(parts, start):
    """Next-fit over several lists of sizes, from any open batch: one list after the other, and all at once."""
    limit = 50

    def plain(used: int, sizes: list[int]) -> int:
        for size in sizes:
            used = used + size if used + size <= limit else size
        return used

    def jumps(sizes: list[int]) -> Jumps:
        states = range(-1, 400)
        out = [plain(x, sizes) for x in states]
        return Jumps.of([*list(states)[:-1], TOP], [False] * len(out), out)

    def shifted(sizes: list[int]) -> Jumps:
        """The same with a shift where no batch ends."""
        whole = limit - sum(sizes)
        states = range(whole + 1, 400) if whole < 399 else [399]
        return Jumps.of([whole, *list(states)[:-1], TOP], [True, *[False] * len(states)], [sum(sizes), *(plain(x, sizes) for x in states)])

    want = start
    every = Jumps.of([TOP], [True], [0])
    for sizes in parts:
        assert jumps(sizes).apply(start) == shifted(sizes).apply(start) == plain(start, sizes)
        want = plain(want, sizes)
        every = every.then(shifted(sizes))
    assert every.apply(start) == want
    right = shifted(parts[-1])
    for sizes in parts[-2::-1]:  # grouping does not matter
        right = shifted(sizes).then(right)
    assert [right.apply(x) for x in range(100)] == [every.apply(x) for x in range(100)]


def test_adaptive(log):
    rows, df = log
    got = {r.event_id: (r.ema_throughput, r.batch_files) for r in adaptive_sizes(df, ["key"], ["event_id"], segments=SEGMENTS).collect()}
    for group in _by_key(rows, lambda r: r[0]).values():
        ema, size = 0.0, 1000
        for r in group:
            ema, size = next_size(ema, size, r[4], r[5])
            assert got[r[0]][1] == size
            assert got[r[0]][0] == pytest.approx(ema, rel=1e-11)


def test_token_bucket(log):
    rows, df = log
    limit = 700_000
    out = token_bucket(df.withColumn("us", F.col("ms") * 1000).withColumnRenamed("size", "bytes"), ["key"], limit, ts="us", tie="event_id", segments=SEGMENTS)
    got = {r.event_id: (r.tokens, r.granted, r.wait_seconds) for r in out.collect()}
    seen = set()
    for group in _by_key(rows, lambda r: (r[2], r[0])).values():
        tokens, last = limit, group[0][2] * 1000
        for r in group:
            now = r[2] * 1000
            tokens, last = min(tokens + int((now - last) / 1e6 * limit), 2 * limit), now
            ok = tokens >= r[3]
            assert got[r[0]] == (tokens, ok, 0.0 if ok else (r[3] - tokens) / limit)
            seen.add(ok)
            tokens -= r[3] if ok else 0
    assert seen == {True, False}


@pytest.mark.parametrize("limit,threshold,top", [(1000, 400, 400), (100, 1000, 300), (1000, 400, 3), (50, 60, 1)])
def test_next_fit_batches(spark, limit, threshold, top):
    """Files of all kinds: with files above the limit, and mostly empty files."""
    rng = random.Random(limit + top)
    files = [(f"f{i:04d}", rng.randrange(0, top + 1) if rng.random() < 0.9 else threshold + 5) for i in range(500)]
    got = {r.path: r.batch for r in assign_batches(spark.createDataFrame(files, "path string, size long"), ["path"], limit, threshold, segments=SEGMENTS).collect()}
    batch, used, count, want = 0, 0, 0, {}
    for path, size in sorted(files):
        if size >= threshold:
            want[path] = None
            continue
        if used + size > limit and count:
            batch, used, count = batch + 1, 0, 0
        want[path], used, count = batch, used + size, count + 1
    assert got == want


def test_one_large_file_and_two_batches(spark):
    files = [(f"s{i:02d}", 100 * 1024) for i in range(20)] + [("big", 2 * 1024 * 1024)]
    out = assign_batches(spark.createDataFrame(files, "path string, size long"), ["path"], 1024 * 1024, 512 * 1024).collect()
    assert sum(r.batch is None for r in out) == 1
    assert {r.batch for r in out if r.batch is not None} == {0, 1}


@pytest.mark.parametrize("bucket", [1, 2, 5, 4096])
def test_runs_across_buckets(spark, bucket):
    rng = random.Random(3)
    present = sorted(i for i in range(300) if rng.random() < 0.85)
    rows = [("a", i, 10) for i in present] + [("b", i, 1) for i in range(50)]
    got = {(r.k, r["first"], r["last"], r["size"], r.n) for r in runs(spark.createDataFrame(rows, "k string, i long, s long"), ["k"], "i", "s", bucket).collect()}
    want, start = set(), present[0]
    for here, following in zip(present, [*present[1:], None]):
        if following != here + 1:
            want.add(("a", start, here, (here - start + 1) * 10, here - start + 1))
            start = following
    assert got == want | {("b", 0, 49, 50, 50)}
