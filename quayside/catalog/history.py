"""Queries on the transfer history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.tables import Tables, oracle
from quayside.functions.rates import with_rates
from quayside.operators import history, inventory

PAIR = ["source", "destination"]
AS_OF = "2001-08-01 00:00:00"
PICKED = [7, 3, 11, 999999999, 5, 2]


def _r(df, digits: int, *columns: str):
    """Rounded columns, so that engines may differ in their last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


#: Added before rounding: means of few decimals often lie on a rounding tie, which the last bit
#: of a sum would decide.
OFF_TIE = 0.0000123


def _metrics(df):
    columns = ("min", "max", "avg", "stddev", "percent_change")
    return df.withColumns({c: F.round(F.col(c) + OFF_TIE, 3) for c in columns})


STATS_SQL = """SELECT d::INT AS period_days, count(h.id) AS total_jobs, count(*) FILTER (h.status = 'success') AS successful_jobs,
  count(h.id) - count(*) FILTER (h.status = 'success') AS failed_jobs,
  round(CASE WHEN count(h.id) > 0 THEN count(*) FILTER (h.status = 'success') / count(h.id)::DOUBLE * 100.0 ELSE 0.0 END, 6) AS success_rate,
  CAST(coalesce(sum(bytes_transferred), 0) AS BIGINT) AS total_bytes_transferred,
  CAST(coalesce(sum(files_transferred), 0) AS BIGINT) AS total_files_transferred,
  coalesce(sum(duration_seconds), 0.0) AS total_duration_seconds,
  round(coalesce(avg(avg_throughput), 0.0), 3) AS avg_throughput,
  round(coalesce(avg(duration_seconds), 0.0), 6) AS avg_job_duration
FROM (VALUES (7), (30), (90), (3650)) p(d)
LEFT JOIN history h ON h.ended_at > TIMESTAMP '2001-08-01 00:00:00' - d * INTERVAL 1 DAY GROUP BY d"""

LONG_SQL = """SELECT id, source, destination, started_at, metric, value FROM history, LATERAL (VALUES
  ('throughput', avg_throughput), ('duration', duration_seconds),
  ('success_rate', CASE WHEN total_files > 0 THEN files_transferred / total_files::DOUBLE * 100.0 ELSE 100.0 END),
  ('files_per_second', files_per_second)) v(metric, value)"""

COMPARE_SQL = """SELECT {by} metric, round(min(value) + 0.0000123, 3) AS min, round(max(value) + 0.0000123, 3) AS max, round(avg(value) + 0.0000123, 3) AS avg,
  round(stddev_pop(value) + 0.0000123, 3) AS stddev,
  round(CASE WHEN arg_min(value, {pos}) <> 0 THEN (arg_max(value, {pos}) - arg_min(value, {pos})) / arg_min(value, {pos}) * 100.0 ELSE 0.0 END + 0.0000123, 3) AS percent_change
  {values} FROM {table} GROUP BY {by} metric"""

TREND_SQL = """SELECT {by} n, slope, mean - slope * (n - 1) / 2.0 AS intercept,
  CASE WHEN n >= 2 AND rel > 0.05 THEN 'improving' WHEN n >= 2 AND rel < -0.05 THEN 'degrading' ELSE 'stable' END AS direction,
  CASE WHEN n >= 2 THEN least(abs(rel), 1.0) ELSE 0.0 END AS strength,
  CASE WHEN n >= 2 THEN mean - slope * (n - 1) / 2.0 + slope * n END AS prediction,
  CASE WHEN n < 2 OR v = 0 THEN 0.0 ELSE greatest(least(coalesce(r2, 0.0), 1.0), 0.0) END AS confidence
FROM (SELECT *, CASE WHEN mean <> 0 THEN slope / mean ELSE 0.0 END AS rel FROM (
  SELECT {by} count(*) AS n, coalesce(regr_slope(y, x), 0.0) AS slope, avg(y) AS mean, regr_r2(y, x) AS r2, var_pop(y) AS v
  FROM (SELECT {by} avg_throughput AS y, CAST(row_number() OVER ({part} ORDER BY started_at, id) - 1 AS DOUBLE) AS x FROM history)
  {group}))"""

ROUND_TREND = """SELECT {by} n, round(slope, 6) AS slope, round(intercept, 3) AS intercept, direction, round(strength, 9) AS strength,
  round(prediction, 3) AS prediction, round(confidence, 9) AS confidence FROM trend"""


def _trend_sql(by: str):
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return TREND_SQL.format(by=by, part=part, group=group)


ANOMALY_SQL = """SELECT {by} id AS entry_id, a.* FROM (
  SELECT h.*, s.n, s.m, s.sd, CASE WHEN sd > 0 THEN (avg_throughput - m) / sd ELSE 0.0 END AS z,
    CASE WHEN total_files > 0 THEN files_failed / total_files::DOUBLE ELSE 0.0 END AS fr
  FROM history h JOIN (SELECT {by} count(*) AS n, avg(avg_throughput) AS m, stddev_pop(avg_throughput) AS sd FROM history {group}) s {on}) h,
LATERAL (VALUES (z < -2.0, 'throughput_drop', least(-z / 4.0, 1.0), 'throughput', m, avg_throughput,
    printf('%.1f MB/s, %.1f deviations below the mean of %.1f MB/s', avg_throughput / 1e6, abs(z), m / 1e6)),
  (z > 2.0, 'throughput_spike', least(z / 4.0, 1.0), 'throughput', m, avg_throughput,
    printf('%.1f MB/s, %.1f deviations above the mean of %.1f MB/s', avg_throughput / 1e6, abs(z), m / 1e6)),
  (fr > 0.05, 'high_failure_rate', least(fr * 2.0, 1.0), 'failure_rate', 0.0, fr,
    printf('%d of %d files failed, %.1f percent', files_failed, total_files, fr * 100.0))) a(hit, anomaly_type, severity, metric, expected, actual, description)
WHERE a.hit AND n >= 3"""
ANOMALY_OUT = """SELECT {by} entry_id, anomaly_type, round(severity, 6) AS severity, metric, round(expected, 3) AS expected, round(actual, 6) AS actual, description FROM anomalies"""


def _anomalies(df):
    return _r(_r(df, 6, "severity", "actual"), 3, "expected")


RECOMMEND_SQL = """SELECT source, destination, CAST(row_number() OVER (PARTITION BY source, destination ORDER BY o) - 1 AS INT) AS rank, recommendation
FROM (SELECT f.source, f.destination, a.o, a.recommendation FROM (
    SELECT source, destination, count(*) AS n, avg(avg_throughput) AS m, stddev_pop(avg_throughput) AS sd,
      arg_max(verify, (started_at, id)) AS v, arg_max(bytes_transferred, (started_at, id)) AS b, arg_max(threads, (started_at, id)) AS th
    FROM history GROUP BY source, destination) f
  JOIN trend t ON f.source = t.source AND f.destination = t.destination
  LEFT JOIN (SELECT source, destination, count(*) FILTER (anomaly_type = 'throughput_drop') AS drops,
      count(*) FILTER (anomaly_type = 'high_failure_rate') AS failing FROM anomalies GROUP BY source, destination) x
    ON f.source = x.source AND f.destination = x.destination,
  LATERAL (VALUES
    (1, direction = 'degrading' AND strength > 0.1, '{degrading}'),
    (2, m < 100000000.0, '{slow}'),
    (3, m > 0 AND sd / m > 0.5, '{variance}'),
    (4, coalesce(drops, 0) > f.n // 4, '{drops}'),
    (5, coalesce(failing, 0) > 0, '{failures}'),
    (6, NOT v AND b > 10000000000, '{unverified}'),
    (7, th < 4 AND m < 500000000.0, '{threads}')) a(o, hit, recommendation) WHERE a.hit)"""

ON_PAIR = "ON h.source = s.source AND h.destination = s.destination"
PAIR_ANOMALY = ANOMALY_SQL.format(by="h.source, h.destination,", group="GROUP BY 1, 2", on=ON_PAIR).replace(
    "(SELECT h.source, h.destination, count(*)", "(SELECT source, destination, count(*)"
)


def _compare_pairs(t: Tables):
    return _metrics(history.compare_metrics(t.history(), history.ORDER, PAIR))


def _compare_picked(t: Tables):
    picked = inventory.pick(t.history(), PICKED)
    out = history.compare(picked)
    joined = F.array_join(F.transform("values", lambda v: F.format_string("%.3f", F.round(v, 3))), ",")
    return _metrics(out).withColumn("values", joined)


def _trend(t: Tables, by):
    return _r(_r(history.trend(t.history(), by), 3, "intercept", "prediction"), 6, "slope").withColumns(
        {c: F.round(c, 9) for c in ("strength", "confidence")}
    )


def _rates(t: Tables):
    total = F.col("bytes_transferred") + F.col("files_failed") * 1000
    df = with_rates(
        t.history().withColumn("total_bytes", total),
        "bytes_transferred", "total_bytes", "duration_seconds", "files_transferred", "total_files",
    )
    return _r(df.select("id", "success_rate", "throughput", "percent", "eta_seconds"), 6, "success_rate", "throughput", "percent", "eta_seconds")


#: The texts as users see them, stated apart from the code under test.
ADVICE = {
    "degrading": "Throughput falls from run to run: look at the stores and the network between them.",
    "slow": "Runs average less than 100 MB/s: give them more tasks or larger blocks.",
    "variance": "Throughput varies by more than half its mean: a bandwidth schedule would even it out.",
    "drops": "More than a quarter of the runs were slow outliers: look for other load on disks and links.",
    "failures": "Some runs lost many files: read their errors, then check rights and space at the destination.",
    "unverified": "The last run moved over 10 GB without a check: copy with verify on.",
    "threads": "The last run used fewer than four threads: allow more.",
}

QUERIES = {
    "history_stats": (
        lambda t: _r(_r(history.aggregate_stats(t.history(), [7, 30, 90, 3650], AS_OF), 6, "success_rate", "avg_job_duration"), 3, "avg_throughput"),
        oracle(STATS_SQL, "history"),
    ),
    "compare_metrics": (
        _compare_pairs,
        oracle(
            COMPARE_SQL.format(by="source, destination,", pos="(started_at, id)", values="", table="long"),
            "history", extra={"long": LONG_SQL},
        ),
    ),
    "compare_picked": (
        _compare_picked,
        oracle(
            COMPARE_SQL.format(
                by="", pos="position", table="picked",
                values=", array_to_string(list(printf('%.3f', round(value, 3)) ORDER BY position), ',') AS \"values\"",
            ),
            "history",
            extra={"long": LONG_SQL, "picked": f"SELECT long.*, p.position FROM long JOIN (SELECT unnest({PICKED}) AS id, unnest(range({len(PICKED)})) AS position) p ON long.id = p.id"},
        ),
    ),
    "pick_entries": (
        lambda t: inventory.pick(t.history(), PICKED).select("position", "id", "status"),
        oracle(
            f"SELECT p.position::INT AS position, h.id, h.status FROM history h JOIN (SELECT unnest({PICKED}) AS id, unnest(range({len(PICKED)})) AS position) p ON h.id = p.id",
            "history",
        ),
    ),
    "trend_per_pair": (
        lambda t: _trend(t, PAIR),
        oracle(ROUND_TREND.format(by="source, destination,"), "history", extra={"trend": _trend_sql("source, destination, ")}),
    ),
    "trend_overall": (
        lambda t: _trend(t, None),
        oracle(ROUND_TREND.format(by=""), "history", extra={"trend": _trend_sql("")}),
    ),
    "anomalies_per_pair": (
        lambda t: _anomalies(history.detect_anomalies(t.history(), PAIR)),
        oracle(ANOMALY_OUT.format(by="source, destination,"), "history", extra={"anomalies": PAIR_ANOMALY}),
    ),
    "anomalies_overall": (
        lambda t: _anomalies(history.detect_anomalies(t.history())),
        oracle(
            ANOMALY_OUT.format(by=""), "history",
            extra={"anomalies": ANOMALY_SQL.format(by="", group="", on="ON true")},
        ),
    ),
    "recommendations": (
        lambda t: history.recommendations(t.history(), PAIR),
        oracle(
            RECOMMEND_SQL.format(**ADVICE), "history",
            extra={"trend": _trend_sql("source, destination, "), "anomalies": PAIR_ANOMALY},
        ),
    ),
    "history_rates": (
        _rates,
        oracle(
            """SELECT id, round(CASE WHEN total_files > 0 THEN files_transferred / total_files::DOUBLE * 100.0 ELSE 100.0 END, 6) AS success_rate,
  round(bytes_transferred / duration_seconds, 6) AS throughput,
  round(bytes_transferred / total::DOUBLE * 100.0, 6) AS percent,
  round(CASE WHEN bytes_transferred > 0 AND bytes_transferred < total THEN (total - bytes_transferred) / (bytes_transferred / duration_seconds) END, 6) AS eta_seconds
FROM (SELECT *, bytes_transferred + files_failed * 1000 AS total FROM history)""",
            "history",
        ),
    ),
    "recent_history": (
        lambda t: history.recent(t.history(), 50).select("id", "source", "status"),
        oracle("SELECT id, source, status FROM history ORDER BY started_at DESC, id DESC LIMIT 50", "history"),
    ),
    "history_for_pair": (
        lambda t: history.history_for(t.history(), "/src/3", "/dst/2").select("id", "bytes_transferred"),
        oracle("SELECT id, bytes_transferred FROM history WHERE source = '/src/3' AND destination = '/dst/2'", "history"),
    ),
    "throughput_series": (
        lambda t: _r(history.throughput_series(t.history(), 100), 9, "throughput_mb").select("id", "throughput_mb", "files"),
        oracle(
            """SELECT id, round(avg_throughput / 1000000.0, 9) AS throughput_mb, files_transferred AS files
FROM (SELECT * FROM history ORDER BY started_at DESC, id DESC LIMIT 100)""",
            "history",
        ),
    ),
    "history_retention": (
        lambda t: history.apply_retention(t.history(), AS_OF, 900, 1000).select("id"),
        oracle(
            """SELECT id FROM history WHERE ended_at > TIMESTAMP '2001-08-01 00:00:00' - 900 * INTERVAL 1 DAY
ORDER BY started_at DESC, id DESC LIMIT 1000""",
            "history",
        ),
    ),
    "retention_tiers": (
        lambda t: history.retention_tiers(t.history(), AS_OF).select("id", "tier", "bytes_transferred"),
        oracle(
            """SELECT id, CASE WHEN ended_at > TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAY THEN 'detail'
  WHEN ended_at > TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 90 DAY THEN 'job' ELSE 'summary' END AS tier, bytes_transferred FROM history""",
            "history",
        ),
    ),
}
