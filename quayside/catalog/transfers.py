"""Queries on copy plans, transfer runs, schedules and order-dependent folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.tables import Tables, oracle
from quayside.functions.sizes import MIB
from quayside.operators import transfers
from quayside.plans import bandwidth, transfer

MIB = 1024 * 1024

#: Mount points for the space check: nested, and one that is a text prefix of a directory name.
MOUNTS = [("p1", 10**12), ("p1/O", 10**11), ("p2/", 10**15), ("p3/F/f1", 10**9), ("extra", 10**6)]
MOUNTS_SQL = ", ".join(f"('{m}', CAST({a} AS BIGINT))" for m, a in MOUNTS)

SCHEDULE = bandwidth.business_hours(100 * MIB, 0)
RULE_SQL = """CASE WHEN dayofweek({ts}) BETWEEN 1 AND 5 AND hour({ts}) >= 9 AND hour({ts}) < 18 THEN 'Business hours'
  WHEN hour({ts}) >= 22 OR hour({ts}) < 6 THEN 'Night hours' END"""
LIMIT_SQL = "CASE rule WHEN 'Night hours' THEN CAST(0 AS BIGINT) ELSE CAST(104857600 AS BIGINT) END"


def _mounts(t: Tables):
    """Mount table: the regions' keys pick one mount each."""
    table = F.array(*[F.struct(F.lit(m).alias("mount_point"), F.lit(a).cast("bigint").alias("available")) for m, a in MOUNTS])
    return t.read("region").select(F.get(table, F.col("r_regionkey").cast("int")).alias("m")).select("m.*")


def _reports(t: Tables):
    return t.read("events").select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.floor("value").cast("bigint").alias("files"),
        ((F.floor(F.col("value") * 1000000).cast("bigint") % 7000000) / 1e6).alias("seconds"),
    )


ADAPTIVE = {
    "reports": """SELECT event_id, user_id AS job_id, CAST(floor(value) AS BIGINT) AS files,
  (CAST(floor(value * 1000000) AS BIGINT) % 7000000) / 1000000.0::DOUBLE AS seconds,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events""",
    "walk": """SELECT job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 0.0::DOUBLE AS ema, CAST(1000 AS BIGINT) AS size FROM reports WHERE rn = 1
UNION ALL SELECT r.job_id, r.rn, r.event_id,
  CASE WHEN r.files = 0 OR r.seconds < 0.001 THEN w.ema WHEN w.ema = 0 THEN r.files / r.seconds
    ELSE 0.3::DOUBLE * (r.files / r.seconds) + (1.0::DOUBLE - 0.3::DOUBLE) * w.ema END,
  CASE WHEN r.files = 0 OR r.seconds < 0.001 THEN w.size WHEN r.seconds < 1.0 THEN least(w.size * 3 // 2, 50000)
    WHEN r.seconds > 5.0 THEN greatest(w.size * 3 // 4, 10) ELSE w.size END
FROM walk w JOIN reports r ON r.job_id = w.job_id AND r.rn = w.rn + 1""",
}

BATCHES = {
    "small": """SELECT path, size, row_number() OVER (ORDER BY path) AS rn, CAST(sum(size) OVER (ORDER BY path) AS BIGINT) AS upto
FROM src_inventory WHERE size < 1048576""",
    "starts": """SELECT CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS first, (SELECT size FROM small WHERE rn = 1) AS head
UNION ALL SELECT s.batch + 1, n.rn, n.size FROM starts s, LATERAL (
  SELECT min(x.rn) AS rn, arg_min(x.size, x.rn) AS size FROM small x JOIN small f ON f.rn = s.first
  WHERE x.rn > s.first AND x.upto - (f.upto - f.size) > 67108864) n WHERE n.rn IS NOT NULL""",
}

BUCKET_LIMIT = 60_000_000
BUCKET = {
    "requests": """SELECT event_id, event_type AS state, CAST(epoch_us(ts) // 1000 AS BIGINT) AS us, CAST(floor(value * 1000000) AS BIGINT) AS bytes,
  row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events""",
    "walk": """SELECT state, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, us AS last, CAST(60000000 AS BIGINT) AS have, CAST(60000000 AS BIGINT) AS tokens, false AS granted, 0.0::DOUBLE AS wait
FROM requests WHERE rn = 1
UNION ALL SELECT state, rn, event_id, us, t, CASE WHEN t >= bytes THEN t - bytes ELSE t END, t >= bytes,
  CASE WHEN t >= bytes THEN 0.0::DOUBLE ELSE (bytes - t) / 60000000.0::DOUBLE END
FROM (SELECT r.*, least(w.tokens + CAST(trunc((r.us - w.last) / 1000000.0::DOUBLE * 60000000.0::DOUBLE) AS BIGINT), 120000000) AS t
  FROM walk w JOIN requests r ON r.state = w.state AND r.rn = w.rn + 1)""",
}

SIX_HOURS_MS = 6 * 3600 * 1000
THROTTLE = {
    "e": """SELECT event_id, user_id AS job_id, CAST(epoch_ms(ts) AS BIGINT) AS ms,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events""",
    "walk": """SELECT job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, ms AS last, false AS reported FROM e WHERE rn = 1
UNION ALL SELECT e.job_id, e.rn, e.event_id, CASE WHEN e.ms - w.last >= 21600000 THEN e.ms ELSE w.last END, e.ms - w.last >= 21600000
FROM walk w JOIN e ON e.job_id = w.job_id AND e.rn = w.rn + 1""",
}


def _token_bucket(t: Tables):
    requests = t.transfer_events().select(
        "event_id", "state", "bytes", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("us")
    )
    out = transfer_bucket(requests)
    return out.select("event_id", "tokens", "granted", F.round("wait_seconds", 9).alias("wait_seconds"))


def transfer_bucket(requests):
    return bandwidth.token_bucket(requests, ["state"], BUCKET_LIMIT, ts="us", tie="event_id")


def _throttled(t: Tables):
    events = t.transfer_events().select("event_id", "job_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return transfers.throttle_reports(events, ["job_id"], "ms", "event_id", SIX_HOURS_MS).select("event_id", "reported")


def _status_log(t: Tables):
    """Events as a log of job states."""
    state = F.expr(
        "CASE state WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'error' THEN 'cancelled' "
        "WHEN 'signup' THEN 'pending' ELSE 'completed' END"
    )
    return t.transfer_events().select("event_id", "job_id", "ts", state.alias("state"))


LATEST = """SELECT job_id, state FROM (
  SELECT job_id, state, row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) AS back FROM walk)
WHERE back = 1"""
LATEST_WALK = {
    "log": """SELECT job_id, CASE state WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'error' THEN 'cancelled'
    WHEN 'signup' THEN 'pending' ELSE 'completed' END AS state,
  row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM transfer_events""",
    "walk": """SELECT job_id, CAST(0 AS BIGINT) AS rn, 'pending' AS state FROM log WHERE rn = 1
UNION ALL SELECT l.job_id, l.rn, CASE WHEN l.state = 'cancelled' AND w.state NOT IN ('pending', 'running') THEN w.state ELSE l.state END
FROM walk w JOIN log l ON l.job_id = w.job_id AND l.rn = w.rn + 1""",
}

STATUS_SQL = """SELECT count(*) FILTER (kind = 'job' AND status = 'running') AS active_jobs,
  count(*) FILTER (kind = 'job' AND status = 'pending') AS pending_jobs, count(*) FILTER (kind = 'job' AND status = 'completed') AS completed_jobs,
  count(*) FILTER (kind = 'job' AND status = 'failed') AS failed_jobs,
  count(*) FILTER (kind = 'agent' AND status IN ('connected', 'busy')) AS connected_agents,
  CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes, CAST(sum(files_transferred) AS BIGINT) AS total_files,
  CASE WHEN count(*) FILTER (kind = 'job' AND status = 'running') > 0
    AND count(*) FILTER (kind = 'agent' AND status IN ('connected', 'busy')) = 0 THEN 'degraded' ELSE 'healthy' END AS health
FROM (SELECT 'job' AS kind, status, bytes_transferred, files_transferred FROM jobs
  UNION ALL SELECT 'agent', status, NULL, NULL FROM agents)"""


def _tasks(t: Tables):
    status = F.expr("CASE status WHEN 'copied' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'running' END")
    return t.copy_results().select("job_id", status.alias("status"), F.col("bytes").alias("size"))


def _progress(t: Tables):
    out = transfers.progress_timeline(t.transfer_events())
    return out.select(
        "event_id", "bytes_done", "files_done", "total_bytes", "total_files", F.round("percent", 6).alias("percent"),
        F.round("throughput", 3).alias("throughput"), F.round("eta_seconds", 3).alias("eta_seconds"),
    )


QUERIES = {
    "chunk_plan": (
        lambda t: transfer.chunk_plan(t.src_inventory()),
        oracle(
            """SELECT path, size AS file_size, part, CASE WHEN big THEN part * 67108864 END AS "offset",
  CASE WHEN big THEN least(67108864, size - part * 67108864) ELSE size END AS size, big::INT AS priority
FROM (SELECT path, size, size >= 104857600 AS big, unnest(range(CASE WHEN size >= 104857600 THEN (size + 67108863) // 67108864 ELSE 1 END)) AS part
  FROM src_inventory)""",
            "src_inventory",
        ),
    ),
    "multipart_plan": (
        lambda t: _parts(t),
        oracle(
            """SELECT path, size AS file_size, CASE WHEN big THEN part * 67108864 END AS "offset",
  CASE WHEN big THEN least(67108864, size - part * 67108864) ELSE size END AS size, CASE WHEN big THEN part + 1 END AS part_number
FROM (SELECT path, size, size > 104857600 AS big, unnest(range(CASE WHEN size > 104857600 THEN (size + 67108863) // 67108864 ELSE 1 END)) AS part
  FROM src_inventory)""",
            "src_inventory",
        ),
    ),
    "assign_batches": (
        lambda t: transfer.assign_batches(t.src_inventory().select("path", "size"), ["path"]),
        oracle(
            """SELECT path, size, (SELECT max(batch) FROM starts WHERE first <= s.rn) AS batch FROM small s
UNION ALL SELECT path, size, NULL FROM src_inventory WHERE size >= 1048576""",
            "src_inventory", extra=BATCHES,
        ),
    ),
    "batch_summary": (
        lambda t: transfer.batch_summary(transfer.assign_batches(t.src_inventory().select("path", "size"), ["path"])),
        oracle(
            """SELECT batch, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (
  SELECT size, (SELECT max(batch) FROM starts WHERE first <= s.rn) AS batch FROM small s
  UNION ALL SELECT size, NULL FROM src_inventory WHERE size >= 1048576) GROUP BY batch""",
            "src_inventory", extra=BATCHES,
        ),
    ),
    "map_keys": (
        lambda t: transfer.map_keys(t.src_inventory().select("path"), "backup/2024"),
        oracle("SELECT path, concat('backup/2024/', path) AS key FROM src_inventory", "src_inventory"),
    ),
    "strip_keys": (
        lambda t: transfer.strip_keys(t.objects().select("key"), "backup/extra"),
        oracle(
            """SELECT key, CASE WHEN starts_with(key, 'backup/extra') THEN ltrim(substr(key, 13), '/') ELSE key END AS path FROM objects""",
            "objects",
        ),
    ),
    "plan_commands": (
        lambda t: transfer.plan_to_commands(_plan(t), "/src", "s3://bucket/dst"),
        oracle(
            """SELECT CASE WHEN s.path IS NULL THEN concat('rm s3://bucket/dst/', d.path)
  ELSE concat('cp /src/', s.path, ' s3://bucket/dst/', s.path) END AS value
FROM src_inventory s FULL JOIN dst_inventory d ON s.path = d.path
WHERE s.path IS NULL OR d.path IS NULL OR s.size <> d.size OR s.mtime > d.mtime""",
            "src_inventory", "dst_inventory",
        ),
    ),
    "delete_by_pattern": (
        lambda t: transfer.to_commands(transfer.select_pattern(t.src_inventory(), "p1/*.log", "delete", "s3://bucket")),
        oracle(
            "SELECT concat('rm s3://bucket/', path) AS value FROM src_inventory WHERE starts_with(path, 'p1/') AND suffix(path, '.log')",
            "src_inventory",
        ),
    ),
    "copy_by_pattern": (
        lambda t: transfer.to_commands(transfer.select_pattern(t.src_inventory(), "*/F/*", "copy", "/src", "/dst")),
        oracle(
            "SELECT concat('cp /src/', path, ' /dst/', path) AS value FROM src_inventory WHERE contains(path, '/F/')",
            "src_inventory",
        ),
    ),
    "assign_mount": (
        lambda t: transfer.assign_mount(t.dst_inventory().select("path", "size"), _mounts(t)),
        oracle(
            f"""SELECT path, size, (SELECT arg_max(m, length(m)) FROM (VALUES {MOUNTS_SQL}) v(m, a) WHERE starts_with(path, m)) AS mount
FROM dst_inventory""",
            "dst_inventory",
        ),
    ),
    "check_space": (
        lambda t: transfer.check_space(t.dst_inventory().select("path", "size"), _mounts(t)),
        oracle(
            f"""SELECT mount, required, coalesce(a, 0) AS available, coalesce(a, 0) >= required AS fits FROM (
  SELECT mount, CAST(sum(size) AS BIGINT) AS required FROM (
    SELECT size, (SELECT arg_max(m, length(m)) FROM (VALUES {MOUNTS_SQL}) v(m, a) WHERE starts_with(path, m)) AS mount FROM dst_inventory)
  GROUP BY mount) LEFT JOIN (VALUES {MOUNTS_SQL}) v(m, a) ON m = mount""",
            "dst_inventory",
        ),
    ),
    "apply_schedule": (
        lambda t: bandwidth.apply_schedule(t.transfer_events(), SCHEDULE).select("event_id", "rule", "limit"),
        oracle(f"SELECT event_id, rule, {LIMIT_SQL} AS \"limit\" FROM (SELECT event_id, {RULE_SQL.format(ts='ts')} AS rule FROM transfer_events)", "transfer_events"),
    ),
    "apply_weekend_schedule": (
        lambda t: bandwidth.apply_schedule(t.transfer_events(), bandwidth.weekend_full_speed(5000)).select("event_id", "rule", "limit"),
        oracle(
            """SELECT event_id, CASE WHEN w THEN 'Weekend' END AS rule, CASE WHEN w THEN CAST(0 AS BIGINT) ELSE CAST(5000 AS BIGINT) END AS "limit"
FROM (SELECT event_id, dayofweek(ts) IN (0, 6) AND hour(ts) * 60 + minute(ts) < 1439 AS w FROM transfer_events)""",
            "transfer_events",
        ),
    ),
    "next_change": (
        lambda t: bandwidth.next_change(t.transfer_events(), SCHEDULE).select("event_id", "next_change_seconds"),
        oracle(
            """SELECT event_id, CAST(min(CASE WHEN b > m THEN b - m ELSE 1440 - m + b END) * 60 AS BIGINT) AS next_change_seconds
FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM transfer_events), (VALUES (540), (1080), (1320), (360)) v(b) GROUP BY event_id""",
            "transfer_events",
        ),
    ),
    "bandwidth_compliance": (
        lambda t: bandwidth.compliance(t.transfer_events(), bandwidth.business_hours(2_000_000, 0)).withColumn(
            "minute", F.unix_seconds("minute")
        ),
        oracle(
            f"""SELECT CAST(epoch(minute) AS BIGINT) AS minute, bytes, rule, "limit", "limit" > 0 AND bytes > "limit" * 60 AS exceeded FROM (
  SELECT *, CASE rule WHEN 'Night hours' THEN CAST(0 AS BIGINT) ELSE CAST(2000000 AS BIGINT) END AS "limit" FROM (
    SELECT *, {RULE_SQL.format(ts='minute')} AS rule FROM (
      SELECT date_trunc('minute', ts) AS minute, CAST(sum(bytes) AS BIGINT) AS bytes FROM transfer_events GROUP BY 1)))""",
            "transfer_events",
        ),
    ),
    "token_bucket": (
        _token_bucket,
        oracle(
            "SELECT event_id, have AS tokens, granted, round(wait, 9) AS wait_seconds FROM walk WHERE rn > 0",
            extra=BUCKET,
        ),
    ),
    "adaptive_sizes": (
        lambda t: transfers.adaptive_sizes(_reports(t), ["job_id"], ["event_id"]).select(
            "event_id", F.round("ema_throughput", 6).alias("ema_throughput"), "batch_files"
        ),
        oracle("SELECT event_id, round(ema, 6) AS ema_throughput, size AS batch_files FROM walk WHERE rn > 0", extra=ADAPTIVE),
    ),
    "throttle_reports": (
        _throttled,
        oracle("SELECT event_id, reported FROM walk WHERE rn > 0", extra=THROTTLE),
    ),
    "progress_timeline": (
        _progress,
        oracle(
            """SELECT event_id, done AS bytes_done, n AS files_done, total AS total_bytes, files AS total_files,
  round(CASE WHEN total > 0 THEN done / total::DOUBLE * 100.0 ELSE 0.0 END, 6) AS percent,
  round(rate, 3) AS throughput, round(CASE WHEN rate > 0 AND done < total THEN (total - done) / rate END, 3) AS eta_seconds
FROM (SELECT *, CASE WHEN elapsed > 0 THEN done / elapsed ELSE 0.0 END AS rate FROM (
  SELECT event_id, CAST(sum(bytes) OVER w AS BIGINT) AS done, count(*) OVER w AS n, CAST(sum(bytes) OVER k AS BIGINT) AS total,
    count(*) OVER k AS files, (epoch_us(ts) - min(epoch_us(ts)) OVER k) / 1000000.0::DOUBLE AS elapsed
  FROM transfer_events WINDOW k AS (PARTITION BY job_id),
    w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""",
            "transfer_events",
        ),
    ),
    "latest_state": (
        lambda t: transfers.latest_state(_status_log(t), "job_id", ["ts", "event_id"]),
        oracle(LATEST, "transfer_events", extra=LATEST_WALK),
    ),
    "copy_summary": (
        lambda t: transfers.copy_summary(t.copy_results(), ["job_id"], seconds=3600.0).withColumn("throughput", F.round("throughput", 6)),
        oracle(
            """SELECT job_id, count(*) FILTER (status = 'copied') AS files_copied, count(*) FILTER (status = 'skipped') AS files_skipped,
  count(*) FILTER (status = 'failed') AS files_failed, CAST(sum(bytes) AS BIGINT) AS bytes_copied,
  round(sum(bytes)::DOUBLE / 3600.0, 6) AS throughput FROM copy_results GROUP BY job_id""",
            "copy_results",
        ),
    ),
    "copy_failures": (
        lambda t: transfers.copy_failures(t.copy_results()),
        oracle("SELECT path, error FROM copy_results WHERE status = 'failed'", "copy_results"),
    ),
    "object_result": (
        lambda t: transfers.object_result(t.copy_results(), ["job_id"]),
        oracle(
            """SELECT job_id, count(*) AS objects_count, CAST(sum(bytes) AS BIGINT) AS bytes_transferred,
  count(*) FILTER (status <> 'failed') AS success_count, count(*) FILTER (status = 'failed') AS failure_count FROM copy_results GROUP BY job_id""",
            "copy_results",
        ),
    ),
    "task_stats": (
        lambda t: transfers.task_stats(_tasks(t), ["job_id"]).withColumn("completion_percent", F.round("completion_percent", 6)),
        oracle(
            """SELECT job_id, count(*) AS submitted, count(*) FILTER (status = 'copied') AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'skipped') AS in_progress, CAST(coalesce(sum(bytes) FILTER (status = 'copied'), 0) AS BIGINT) AS bytes_copied,
  CAST(coalesce(sum(bytes) FILTER (status <> 'copied'), 0) AS BIGINT) AS bytes_remaining,
  round(count(*) FILTER (status = 'copied') / count(*)::DOUBLE * 100.0, 6) AS completion_percent,
  count(*) FILTER (status = 'skipped') = 0 AS is_complete FROM copy_results GROUP BY job_id""",
            "copy_results",
        ),
    ),
    "resume_summary": (
        lambda t: transfers.resume_summary(t.resume_states()),
        oracle(
            """SELECT *, status = 'interrupted' AND files_remaining > 0 AND bytes_transferred > 0 AS resumable FROM (
  SELECT transfer_id, status, count(*) FILTER (file_status IN ('complete', 'skipped')) AS files_skipped,
    CAST(sum(CASE WHEN file_status IN ('complete', 'skipped') THEN size WHEN file_status = 'partial' THEN bytes_written ELSE 0 END) AS BIGINT) AS bytes_skipped,
    count(*) FILTER (file_status NOT IN ('complete', 'skipped')) AS files_remaining,
    CAST(sum(CASE WHEN file_status IN ('complete', 'skipped') THEN 0 WHEN file_status = 'partial' THEN size - bytes_written ELSE size END) AS BIGINT) AS bytes_remaining,
    CAST(sum(bytes_written) AS BIGINT) AS bytes_transferred FROM resume_states GROUP BY transfer_id, status)""",
            "resume_states",
        ),
    ),
    "transfer_totals": (
        lambda t: transfers.transfer_totals(t.resume_states()),
        oracle(
            """SELECT transfer_id, CAST(sum(bytes_written) AS BIGINT) AS bytes_transferred, max(last_checkpoint) AS last_checkpoint
FROM resume_states GROUP BY transfer_id""",
            "resume_states",
        ),
    ),
    "cleanup_states": (
        lambda t: transfers.cleanup_states(t.resume_states(), 1000, 996624000).select("transfer_id", "path", "status"),
        oracle(
            """SELECT transfer_id, path, status FROM resume_states WHERE NOT (greatest(996624000 - last_checkpoint, 0) > 86400000
  OR status IN ('completed', 'cancelled'))""",
            "resume_states",
        ),
    ),
    "system_status": (
        lambda t: transfers.system_status(t.jobs(), t.agents()),
        oracle(STATUS_SQL, "jobs", "agents"),
    ),
    "metrics_table": (
        lambda t: transfers.metrics_table(t.jobs(), t.agents()),
        oracle(
            """SELECT concat('quayside_', n) AS name, k AS type, h AS help, v::DOUBLE AS value FROM s, LATERAL (VALUES
  ('jobs_active', 'gauge', 'Jobs that are moving data now', active_jobs), ('jobs_pending', 'gauge', 'Jobs that wait for their turn', pending_jobs),
  ('jobs_completed_total', 'counter', 'Jobs that ended well', completed_jobs), ('jobs_failed_total', 'counter', 'Jobs that ended with an error', failed_jobs),
  ('agents_connected', 'gauge', 'Agents heard from of late', connected_agents),
  ('bytes_transferred_total', 'counter', 'Bytes moved by all jobs', total_bytes),
  ('files_transferred_total', 'counter', 'Files moved by all jobs', total_files)) m(n, k, h, v)""",
            "jobs", "agents", extra={"s": STATUS_SQL},
        ),
    ),
    "histogram": (
        lambda t: transfers.histogram(t.history(), "duration_seconds", [60.0, 120.0, 300.0, 600.0], ["status"]).withColumn(
            "le", F.col("le").cast("string")
        ),
        oracle(
            """SELECT status, count(*) AS count, sum(duration_seconds) AS sum, b.n AS le,
  count(*) FILTER (duration_seconds <= b.v) AS bucket_count
FROM history, (VALUES ('60.0', 60.0::DOUBLE), ('120.0', 120.0::DOUBLE), ('300.0', 300.0::DOUBLE), ('600.0', 600.0::DOUBLE), ('Infinity', 'Infinity'::DOUBLE)) b(n, v)
GROUP BY status, b.n""",
            "history",
        ),
    ),
    "throughput_windows": (
        lambda t: transfers.throughput_windows(t.transfer_events(), "1 day"),
        oracle(
            """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes
FROM transfer_events GROUP BY 1""",
            "transfer_events",
        ),
    ),
    "throughput_sliding": (
        lambda t: transfers.throughput_windows(t.transfer_events(), "2 hours", "1 hour"),
        oracle(
            """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 3600 * back AS start, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes
FROM transfer_events, (VALUES (0), (1)) v(back) GROUP BY 1""",
            "transfer_events",
        ),
    ),
    "activity_sessions": (
        lambda t: transfers.activity_sessions(t.transfer_events(), "6 hours"),
        oracle(
            """SELECT job_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT *, sum(CASE WHEN us - prev < 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY us, event_id) AS s
  FROM (SELECT *, lag(us) OVER (PARTITION BY job_id ORDER BY us, event_id) AS prev FROM (SELECT *, epoch_us(ts) AS us FROM transfer_events)))
GROUP BY job_id, s""",
            "transfer_events",
        ),
    ),
    "agent_liveness": (
        lambda t: transfers.liveness(t.transfer_events(), "2024-01-31 00:00:00", 12 * 3600, key="job_id").withColumn(
            "age_seconds", F.round("age_seconds", 6)
        ),
        oracle(
            """SELECT job_id, last_us, round((1706659200000000 - last_us) / 1000000.0::DOUBLE, 6) AS age_seconds,
  (1706659200000000 - last_us) / 1000000.0::DOUBLE > 43200 AS stale FROM (SELECT job_id, max(epoch_us(ts)) AS last_us FROM transfer_events GROUP BY job_id)""",
            "transfer_events",
        ),
    ),
}


def _parts(t: Tables):
    """Every part of every upload, in parts of 64 MiB."""
    return transfer.multipart_plan(t.src_inventory(), chunk=64 * MIB)


def _plan(t: Tables):
    from quayside.plans.sync import sync_plan

    return sync_plan(t.src_inventory(), t.dst_inventory(), delete_extra=True)
