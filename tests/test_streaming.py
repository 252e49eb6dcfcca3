"""Streams in several micro-batches against their batch twins, late rows, replays."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import history, transfers
from quayside.plans import bandwidth
from quayside.streaming import live

SCHEMA = "event_id long, ts timestamp, job_id long, bytes long, files long, seconds double, us long"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """300 events in time order, cut into three files and read one file per micro-batch."""
    rng = random.Random(5)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(300):
        at = start + dt.timedelta(seconds=i * 20 + rng.randrange(15))
        rows.append((i, at, rng.randrange(4), rng.randrange(1_000_000), rng.randrange(20), rng.random() * 7, i * 100_000))
    folder = tmp_path_factory.mktemp("events")
    for part in range(3):
        df = spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1)
        df.write.parquet(str(folder / f"part{part}"))
    batch = spark.read.schema(SCHEMA).parquet(*[str(folder / f"part{p}") for p in range(3)])

    def stream():
        return (
            spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
        )

    return batch, stream


def _set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_progress(events):
    batch, stream = events
    out = live.run_now(live.stream_progress(stream()), "update", "p")
    assert out.select("batch").distinct().count() == 3
    got = _set(live.latest(out, ["job_id"]).select("job_id", "bytes", "files"))
    assert got == _set(batch.groupBy("job_id").agg(F.sum("bytes"), F.count("*")))


def test_progress_with_totals(events):
    batch, stream = events
    totals = batch.groupBy("job_id").agg((F.sum("bytes") * 2).alias("total_bytes"))
    out = live.latest(live.run_now(live.stream_progress(stream(), totals), "update", "p"), ["job_id"])
    assert all(r.percent == pytest.approx(50) and r.eta_seconds == pytest.approx(r.elapsed) for r in out.collect())


def test_windows_update_and_append(events):
    batch, stream = events
    twin = _set(transfers.throughput_windows(batch, "10 minutes", "5 minutes"))
    out = live.run_now(live.stream_throughput(stream(), "10 minutes", "5 minutes"), "update", "w")
    assert _set(live.latest(out, ["start"])) == twin
    closed = _set(live.run_now(live.stream_throughput(stream(), "10 minutes", "5 minutes", "1 minute"), "append", "w").drop("batch"))
    assert 0 < len(closed) < len(twin) and set(closed) <= set(twin)


def test_sessions(events):
    batch, stream = events
    out = live.last_batch(live.run_now(live.stream_sessions(stream(), "1 minute"), "complete", "s"))
    assert _set(out) == _set(transfers.activity_sessions(batch, "1 minute"))


def test_compliance(events):
    batch, stream = events
    plan = bandwidth.business_hours(10_000, 20_000)
    out = live.latest(live.run_now(live.stream_compliance(stream(), plan), "update", "c"), ["minute"])
    twin = bandwidth.compliance(batch, plan).withColumn("minute", F.unix_seconds("minute"))
    assert _set(out.select("minute", "bytes", "rule", "limit", "exceeded")) == _set(twin.select("minute", "bytes", "rule", "limit", "exceeded"))


def test_adaptive(events):
    batch, stream = events
    out = live.run_now(live.stream_adaptive(stream().select("job_id", "event_id", "files", "seconds")), name="a")
    twin = transfers.adaptive_sizes(batch, ["job_id"], ["event_id"])
    assert _set(out.select("event_id", "batch_files")) == _set(twin.select("event_id", "batch_files"))


def test_limiter(events):
    batch, stream = events
    out = live.run_now(live.stream_limiter(stream().select("job_id", "event_id", "bytes", "us"), "job_id", 900_000), name="l")
    twin = bandwidth.token_bucket(batch, ["job_id"], 900_000, ts="us", tie="event_id")
    assert _set(out.select("event_id", "tokens", "granted")) == _set(twin.select("event_id", "tokens", "granted"))


def test_liveness(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for part, rows in enumerate([[(1, 0), (2, 0), (3, 0)], [(1, 100), (2, 10)], [(1, 700)]]):
        df = spark.createDataFrame([(a, start + dt.timedelta(seconds=s)) for a, s in rows], "agent_id long, ts timestamp")
        df.coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
    stream = spark.readStream.schema("agent_id long, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = live.run_now(live.stream_liveness(stream, 300, "1 second"), name="live")
    stale = {r.agent_id for r in out.where("stale").collect()}
    assert stale == {2, 3} or stale == {1, 2, 3} and out.where("agent_id = 1 AND stale").first().last_us == 1704067300_000000
    assert out.where("agent_id = 1").agg(F.max("last_us")).first()[0] == 1704067200_000000 + 700_000_000


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for part, seconds in enumerate([[0, 60], [3600, 3700], [3710], [5]]):
        rows = [(start + dt.timedelta(seconds=s), 1) for s in seconds]
        spark.createDataFrame(rows, "ts timestamp, bytes long").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema("ts timestamp, bytes long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.write_batches(live.stream_throughput(stream, "1 minute", late="1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert live.dropped_rows(query) == 1


def test_history_stream_flags_against_all_stored(spark, tmp_path):
    rows = [(str(i), "s", 100.0 if i != 50 else 1.0, 0, 10) for i in range(60)]
    schema = "id string, source string, avg_throughput double, files_failed long, total_files long"
    for part in range(2):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.stream_history(stream, str(tmp_path / "store"), str(tmp_path / "cp"), ["source"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store/entries")).count() == 60
    found = spark.read.parquet(str(tmp_path / "store/anomalies")).collect()
    twin = history.detect_anomalies(spark.createDataFrame(rows, schema), ["source"]).collect()
    assert [r.entry_id for r in found] == [r.entry_id for r in twin] == ["50"]


def test_inventory_stream(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a").write_bytes(b"12345")
    (tmp_path / "in/b").write_bytes(b"1")
    out = live.current_manifest(live.run_now(live.stream_inventory(spark, str(tmp_path / "in")), name="i"))
    assert sorted((r.path.rsplit("/", 1)[-1], r["size"]) for r in out.collect()) == [("a", 5), ("b", 1)]


def _parts(spark, tmp_path, parts, schema):
    """Rows of each part in a file of their own, read as one micro-batch each."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{n:02d}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run_stream(spark, tmp_path, stream):
    query = live.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), state_partitions=2)
    query.awaitTermination()
    return query, spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/batch=*"))


START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENTS = "job_id long, ts timestamp, bytes long"


def _at(job, *seconds):
    return [(job, START + dt.timedelta(seconds=s), 10) for s in seconds]


def test_state_of_ended_jobs_goes(spark, tmp_path):
    parts = [_at(1, 0, 60) + _at(2, 30), _at(3, 3600), _at(3, 4000), _at(1, 5), _at(3, 4100) + _at(1, 9000), _at(3, 9100)]
    query, rows = _run_stream(spark, tmp_path, live.stream_job_progress(_parts(spark, tmp_path, parts, EVENTS), 600, "1 second"))
    found = sorted((r.job_id, r.files, r["bytes"], r.elapsed, r.ended) for r in rows.collect())
    assert found.count((1, 2, 20, 60.0, True)) == 1 and found.count((2, 1, 10, 0.0, True)) == 1
    assert (1, 1, 10, 0.0, False) in found  # a new count after the end; the late row at second 5 is in none
    assert not any(f[:2] == (1, 3) for f in found) and live.dropped_rows(query) == 1
    # news in the batch that would have ended it keep a job going
    assert (3, 4, 40, 5500.0, False) in found and not any(f[0] == 3 and f[4] for f in found)
    totals = [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress]
    assert max(totals) > totals[-1] > 0


def test_partial_sums_send_a_row_per_bucket(spark):
    rows = [(7, START + dt.timedelta(milliseconds=k), k) for k in range(5000)] + [(8, START, None), (None, START, 1), (7, None, 5)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        sums = live.partial_sums(spark.createDataFrame(rows, EVENTS).coalesce(1), 60_000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(((r.job_id, r["bytes"], r.files) for r in sums), key=repr) == sorted([(7, sum(range(5000)), 5000), (8, 0, 1), (None, 1, 1)], key=repr)


def test_closed_sessions(spark, tmp_path):
    import random

    rnd = random.Random(4)
    times = {job: sorted(rnd.sample(range(0, 40_000), 60 if job else 200)) for job in range(4)}
    events = sorted((s, job) for job, seconds in times.items() for s in seconds)
    parts = [_at_many(events[k : k + 40]) for k in range(0, len(events), 40)]
    query, rows = _run_stream(spark, tmp_path, live.stream_closed_sessions(_parts(spark, tmp_path, parts, EVENTS), 600, "10 seconds"))
    found = sorted((r.job_id, r.start_us, r.end_us, r.events, r["bytes"]) for r in rows.collect())
    base, want = int(START.timestamp()), []
    for job, seconds in times.items():
        run = [seconds[0]]
        for s in [*seconds[1:], 10**9]:
            if s - run[-1] >= 600:
                want.append((job, (base + run[0]) * 10**6, (base + run[-1] + 600) * 10**6, len(run), 10 * len(run)))
                run = []
            run.append(s)
    closed = [w for w in want if w[2] + 150 * 10**6 <= (base + events[-1][0] - 10) * 10**6]
    assert found == sorted(closed) and len(closed) > 20
    kept = [p.stateOperators[-1].numRowsTotal for p in query.recentProgress if p.stateOperators]
    # sessions that can still grow and their timers: no more towards the end than at the beginning
    assert max(kept[len(kept) // 2 :]) <= 1.3 * max(kept[: len(kept) // 2])


def test_closed_sessions_of_a_busy_job_and_ties(spark, tmp_path):
    """Events a gap apart are two sessions, and rows become sessions before the shuffle, with no Python state per key."""
    pairs = [(0, 1), (599, 1), (1199, 1), (0, None), (0, 2)] + [(s, 3) for s in range(500)]
    query, rows = _run_stream(spark, tmp_path, live.stream_closed_sessions(_parts(spark, tmp_path, [_at_many(pairs), _at_many([(99_000, 9)])], EVENTS), 600, "10 seconds"))
    base = int(START.timestamp())
    found = {(r.job_id, r.start_us // 10**6 - base, r.end_us // 10**6 - base, r.events) for r in rows.collect()}
    assert found == {(1, 0, 1199, 2), (1, 1199, 1799, 1), (None, 0, 600, 1), (2, 0, 600, 1), (3, 0, 1099, 500)}
    names = {op.operatorName for p in query.recentProgress for op in p.stateOperators}
    assert names and not any("transformWithState" in n for n in names)


def _at_many(pairs):
    return [(job, START + dt.timedelta(seconds=s), 10) for s, job in pairs]


def test_limiter_sends_results_by_slices(monkeypatch):
    import pandas as pd

    class State:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    monkeypatch.setattr(live, "SLICE", 3, raising=False)
    bucket = live._Bucket(100)
    bucket.state = State()
    rows = [pd.DataFrame({"us": [5, 1], "event_id": [1, 2], "bytes": [60, 60]}), pd.DataFrame({"us": [5, 9, 2], "event_id": [0, 4, 3], "bytes": [40, 1, 7]})]
    out = list(bucket.handleInputRows(("k",), iter(rows), None))
    assert [len(o) for o in out] == [3, 2]
    both = pd.concat(out)
    assert both["event_id"].tolist() == [2, 3, 0, 1, 4] and both["granted"].tolist() == [True, True, False, False, True]
