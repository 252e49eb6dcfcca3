"""Streaming queries over the events table, run once over all it holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.tables import Tables, oracle
from quayside.catalog.transfers import ADAPTIVE, BUCKET, BUCKET_LIMIT, RULE_SQL
from quayside.plans import bandwidth
from quayside.streaming import live


def _events(t: Tables):
    """The events table as a stream, with a timestamp to put a watermark on."""
    schema = t.read("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return stream.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("state"),
        F.floor(F.col("value") * 1000000).cast("bigint").alias("bytes"),
    )


def _run(t: Tables, stream, mode: str = "append", name: str = "stream"):
    return live.run_now(stream, mode, name, t.spark.sparkContext.defaultParallelism)


def _progress(t: Tables):
    out = live.latest(_run(t, live.stream_progress(_events(t)), "update", "progress"), ["job_id"])
    return out.select("job_id", "bytes", "files", F.round("elapsed", 6).alias("elapsed"), F.round("throughput", 3).alias("throughput"))


def _job_progress(t: Tables):
    """The last row of every job: ended if it was idle for twelve hours before the watermark."""
    out = live.latest(_run(t, live.stream_job_progress(_events(t), 12 * 3600), name="job-progress"), ["job_id"])
    return out.select("job_id", "bytes", "files", F.round("elapsed", 6).alias("elapsed"), F.round("throughput", 3).alias("throughput"), "ended")


def _adaptive(t: Tables):
    reports = _events(t).select(
        "event_id", "job_id", F.floor(F.col("bytes") / 1000000).cast("bigint").alias("files"), ((F.col("bytes") % 7000000) / 1e6).alias("seconds")
    )
    out = _run(t, live.stream_adaptive(reports), name="adaptive")
    return out.select("event_id", F.round("ema_throughput", 6).alias("ema_throughput"), "batch_files")


def _limiter(t: Tables):
    requests = _events(t).select("state", "event_id", "bytes", F.floor(F.unix_micros("ts") / 1000).cast("bigint").alias("us"))
    out = _run(t, live.stream_limiter(requests, "state", BUCKET_LIMIT), name="limiter")
    return out.select("event_id", "tokens", "granted", F.round("wait_seconds", 9).alias("wait_seconds"))


def _liveness(t: Tables):
    """State after the last word on every agent: stale once half a day behind the watermark."""
    beats = _events(t).select(F.col("job_id").alias("agent_id"), "ts")
    out = _run(t, live.stream_liveness(beats, 12 * 3600), name="liveness")
    return out.groupBy("agent_id").agg(F.max("last_us").alias("last_us"), F.bool_or("stale").alias("stale"))


def _history(t: Tables):
    """History entries written out, then streamed in and judged per source."""
    folder = live.new_folder(t.spark, "history")
    entries = t.history().select("id", "source", "avg_throughput", "files_failed", "total_files")
    entries.write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(entries.schema).parquet(f"{folder}/in")
    live.stream_history(stream, f"{folder}/store", f"{folder}/checkpoint", ["source"]).awaitTermination()
    found = t.spark.read.parquet(f"{folder}/store/anomalies")
    return found.select("source", "entry_id", "anomaly_type", F.round("severity", 6).alias("severity"))


QUERIES = {
    "stream_progress": (
        _progress,
        oracle(
            """SELECT job_id, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE, 6) AS elapsed,
  round(CASE WHEN max(ts) > min(ts) THEN sum(bytes)::DOUBLE / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE) ELSE 0.0 END, 3) AS throughput
FROM transfer_events GROUP BY job_id""",
            "transfer_events",
        ),
    ),
    "stream_job_progress": (
        _job_progress,
        oracle(
            """SELECT job_id, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE, 6) AS elapsed,
  round(CASE WHEN max(ts) > min(ts) THEN sum(bytes)::DOUBLE / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE) ELSE 0.0 END, 3) AS throughput,
  max(epoch_us(ts)) // 1000 + 43200000 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM transfer_events) AS ended
FROM transfer_events GROUP BY job_id""",
            "transfer_events",
        ),
    ),
    "stream_closed_sessions": (
        lambda t: _run(t, live.stream_closed_sessions(_events(t), 6 * 3600), name="closed-sessions").drop("batch"),
        oracle(
            """SELECT * FROM (SELECT job_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT *, sum(CASE WHEN us - prev < 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY us, event_id) AS s
  FROM (SELECT *, lag(us) OVER (PARTITION BY job_id ORDER BY us, event_id) AS prev FROM (SELECT *, epoch_us(ts) AS us FROM transfer_events)))
GROUP BY job_id, s) WHERE (end_us + 5400000000 + 999) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM transfer_events)""",
            "transfer_events",
        ),
    ),
    "stream_throughput": (
        lambda t: live.latest(
            _run(t, live.stream_throughput(_events(t), "2 hours", "1 hour"), "update", "throughput"), ["start"]
        ),
        oracle(
            """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 3600 * back AS start, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes
FROM transfer_events, (VALUES (0), (1)) v(back) GROUP BY 1""",
            "transfer_events",
        ),
    ),
    "stream_sessions": (
        lambda t: live.last_batch(_run(t, live.stream_sessions(_events(t), "6 hours"), "complete", "sessions")),
        oracle(
            """SELECT job_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT *, sum(CASE WHEN us - prev < 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY us, event_id) AS s
  FROM (SELECT *, lag(us) OVER (PARTITION BY job_id ORDER BY us, event_id) AS prev FROM (SELECT *, epoch_us(ts) AS us FROM transfer_events)))
GROUP BY job_id, s""",
            "transfer_events",
        ),
    ),
    "stream_compliance": (
        lambda t: live.latest(
            _run(t, live.stream_compliance(_events(t), bandwidth.business_hours(2_000_000, 0)), "update", "compliance"), ["minute"]
        ),
        oracle(
            f"""SELECT CAST(epoch(minute) AS BIGINT) AS minute, bytes, rule, "limit", "limit" > 0 AND bytes > "limit" * 60 AS exceeded FROM (
  SELECT *, CASE rule WHEN 'Night hours' THEN CAST(0 AS BIGINT) ELSE CAST(2000000 AS BIGINT) END AS "limit" FROM (
    SELECT *, {RULE_SQL.format(ts='minute')} AS rule FROM (
      SELECT date_trunc('minute', ts) AS minute, CAST(sum(bytes) AS BIGINT) AS bytes FROM transfer_events GROUP BY 1)))""",
            "transfer_events",
        ),
    ),
    "stream_adaptive": (
        _adaptive,
        oracle("SELECT event_id, round(ema, 6) AS ema_throughput, size AS batch_files FROM walk WHERE rn > 0", extra=ADAPTIVE),
    ),
    "stream_limiter": (
        _limiter,
        oracle("SELECT event_id, have AS tokens, granted, round(wait, 9) AS wait_seconds FROM walk WHERE rn > 0", extra=BUCKET),
    ),
    "stream_liveness": (
        _liveness,
        oracle(
            """SELECT job_id AS agent_id, last_us, last_us // 1000 + 43200000 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM transfer_events) AS stale
FROM (SELECT job_id, max(epoch_us(ts)) AS last_us FROM transfer_events GROUP BY job_id)""",
            "transfer_events",
        ),
    ),
    "stream_history": (
        _history,
        oracle(
            """SELECT h.source, id AS entry_id, a.anomaly_type, round(a.severity, 6) AS severity FROM (
  SELECT h.*, s.n, CASE WHEN sd > 0 THEN (avg_throughput - m) / sd ELSE 0.0 END AS z,
    CASE WHEN total_files > 0 THEN files_failed / total_files::DOUBLE ELSE 0.0 END AS fr
  FROM history h JOIN (SELECT source, count(*) AS n, avg(avg_throughput) AS m, stddev_pop(avg_throughput) AS sd FROM history GROUP BY source) s
    ON h.source = s.source) h,
LATERAL (VALUES (z < -2.0, 'throughput_drop', least(-z / 4.0, 1.0)), (z > 2.0, 'throughput_spike', least(z / 4.0, 1.0)),
  (fr > 0.05, 'high_failure_rate', least(fr * 2.0, 1.0))) a(hit, anomaly_type, severity) WHERE a.hit AND n >= 3""",
            "history",
        ),
    ),
}
