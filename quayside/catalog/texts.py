"""Queries on texts: sizes, listings, logs, accounting, states, errors, devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.tables import Tables, oracle
from quayside.functions import accounting, rates, sizes
from quayside.sources import texts


def _size_texts(t: Tables):
    """Price texts with every kind of unit, blanks, signs and some that are no number."""
    k = F.col("o_orderkey")
    number = F.concat(F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("."), (k % 10).cast("string"))
    units = ["", "b", "K", "kb", " M", "MB", "G", "gB", "T", " tb", "X", "MM", "BB", "e2", "e1K"]
    unit = F.get(F.array(*[F.lit(u) for u in units]), (k % len(units)).cast("int"))
    sign = F.when(k % 31 == 0, "-").when(k % 37 == 0, "+").when(k % 41 == 0, "x").otherwise("")
    return t.read("orders").select(k.alias("id"), F.concat(F.lit(" "), sign, number, unit).alias("text"))


SIZE_TEXTS = """SELECT o_orderkey AS id, concat(' ', CASE WHEN o_orderkey % 31 = 0 THEN '-' WHEN o_orderkey % 37 = 0 THEN '+'
    WHEN o_orderkey % 41 = 0 THEN 'x' ELSE '' END, CAST(floor(o_totalprice) AS BIGINT), '.', o_orderkey % 10,
  ['', 'b', 'K', 'kb', ' M', 'MB', 'G', 'gB', 'T', ' tb', 'X', 'MM', 'BB', 'e2', 'e1K'][(o_orderkey % 15 + 1)::INT]) AS text FROM orders"""

PARSED = """SELECT id, text, CASE WHEN n IS NULL THEN NULL WHEN n * f >= 9223372036854775807 THEN 9223372036854775807
  WHEN n < 0 THEN 0 ELSE CAST(floor(n * f) AS BIGINT) END AS {name} FROM (
  SELECT id, text, TRY_CAST(trim(regexp_replace(t, cut, '')) AS DOUBLE) AS n, f FROM (
    SELECT id, text, upper(trim(text)) AS t, CASE {cuts} END AS cut, CASE {factors} END AS f FROM (SELECT *, upper(trim(text)) AS u FROM texts)))"""


def _parsed(name: str, units: list[tuple[str, int]], cut: str, other: str) -> str:
    hit = lambda u: f"WHEN suffix(u, '{u}') OR suffix(u, '{u}B') THEN"
    return PARSED.format(
        name=name,
        cuts=" ".join(f"{hit(u)} '{cut.replace('U', u)}'" for u, _ in units) + f" ELSE '{other}'",
        factors=" ".join(f"{hit(u)} 1024.0::DOUBLE ^ {p}" for u, p in units) + " ELSE 1.0::DOUBLE",
    )


def _log_lines(t: Tables):
    k = F.col("file_id")
    line = (
        F.when(k % 6 == 0, F.concat(F.lit("upload "), "path"))
        .when(k % 6 == 1, F.concat(F.lit("cp /src/"), "path", F.lit(" -> s3://bucket/"), "path"))
        .when(k % 6 == 2, F.concat(F.lit("download "), "path"))
        .when(k % 6 == 3, F.concat(F.lit("cp s3://bucket/"), "path", F.lit(" /dst/"), "path"))
        .when(k % 6 == 4, F.concat(F.lit("ERROR cp "), "path"))
        .otherwise(F.concat(F.lit("mkdir "), "path"))
    )
    return t.src_inventory().select(line.alias("value"))


def _sync_lines(t: Tables):
    k = F.col("file_id")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("sent "), F.format_number("size", 0), F.lit(" bytes  received "), F.format_number(k, 0), F.lit(" bytes  7.50 bytes/sec")))
        .when(k % 5 == 1, F.col("path"))
        .when(k % 5 == 2, F.lit("sending incremental file list"))
        .when(k % 5 == 3, F.concat(F.lit("total size is "), F.col("size").cast("string")))
        .otherwise(F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("docs/bytes sent to "), "path")))
    )
    return t.src_inventory().select(line.alias("value"))


def _raw_states(t: Tables):
    """Scheduler and raw state of every order and line, in the schedulers' own words."""
    raw = {
        "slurm": ["PENDING", "configuring", "RUNNING", " COMPLETING", "COMPLETED", "NODE_FAIL", "TIMEOUT", "CANCELLED", "PREEMPTED"],
        "pbs": ["Q", "W", "H", "R", "E", "C", "q", "S", "X"],
        "lsf": ["PEND", "run", "DONE", "EXIT", "ZOMBI", "PEND", "RUN", "SSUSP", "UNKWN"],
        "sge": ["job_state 1: r", "job_state 1: qw", "job_state", "", "queue: none", "job_state 1: t", "job_state qw r", "r", "qw"],
    }
    names = F.array(*[F.lit(n) for n in raw])
    words = F.array(*[F.array(*[F.lit(w) for w in v]) for v in raw.values()])
    kind = (F.col("l_orderkey") % 4).cast("int")
    return t.read("lineitem").select(
        F.get(names, kind).alias("scheduler"), F.get(F.get(words, kind), (F.col("l_partkey") % 9).cast("int")).alias("raw")
    )


def _states(t: Tables):
    named = _raw_states(t).withColumn("state", accounting.normalize_state("scheduler", "raw"))
    return named.groupBy("scheduler", "raw", "state").agg(F.count("*").alias("n"))


STATES = """SELECT scheduler, raw, CASE scheduler
  WHEN 'slurm' THEN CASE WHEN upper(trim(raw)) IN ('PENDING', 'CONFIGURING') THEN 'Pending' WHEN upper(trim(raw)) IN ('RUNNING', 'COMPLETING') THEN 'Running'
    WHEN upper(trim(raw)) = 'COMPLETED' THEN 'Completed' WHEN upper(trim(raw)) IN ('FAILED', 'TIMEOUT', 'NODE_FAIL') THEN 'Failed'
    WHEN upper(trim(raw)) = 'CANCELLED' THEN 'Cancelled' ELSE 'Unknown' END
  WHEN 'pbs' THEN CASE WHEN raw IN ('Q', 'W', 'H') THEN 'Pending' WHEN raw IN ('R', 'E') THEN 'Running' WHEN raw = 'C' THEN 'Completed' ELSE 'Unknown' END
  WHEN 'lsf' THEN CASE upper(trim(raw)) WHEN 'PEND' THEN 'Pending' WHEN 'RUN' THEN 'Running' WHEN 'DONE' THEN 'Completed' WHEN 'EXIT' THEN 'Failed' ELSE 'Unknown' END
  ELSE CASE WHEN contains(raw, 'job_state') AND contains(raw, 'r') THEN 'Running' WHEN contains(raw, 'job_state') AND contains(raw, 'qw') THEN 'Pending'
    ELSE 'Completed' END END AS state, count(*) AS n
FROM (SELECT ['slurm', 'pbs', 'lsf', 'sge'][k + 1] AS scheduler, CASE k
    WHEN 0 THEN ['PENDING', 'configuring', 'RUNNING', ' COMPLETING', 'COMPLETED', 'NODE_FAIL', 'TIMEOUT', 'CANCELLED', 'PREEMPTED'][j + 1]
    WHEN 1 THEN ['Q', 'W', 'H', 'R', 'E', 'C', 'q', 'S', 'X'][j + 1]
    WHEN 2 THEN ['PEND', 'run', 'DONE', 'EXIT', 'ZOMBI', 'PEND', 'RUN', 'SSUSP', 'UNKWN'][j + 1]
    ELSE ['job_state 1: r', 'job_state 1: qw', 'job_state', '', 'queue: none', 'job_state 1: t', 'job_state qw r', 'r', 'qw'][j + 1] END AS raw
  FROM (SELECT (l_orderkey % 4)::INT AS k, (l_partkey % 9)::INT AS j FROM lineitem)) GROUP BY ALL"""


def _devices(t: Tables):
    words = ["/dev/nvme0n1 ", "Samsung SSD ", "/dev/hda ", "Disk ", "nfs4 host:/", "CIFS ", "lustre@tcp ", "ram ", "beegfs_nodev "]
    name = F.concat(F.get(F.array(*[F.lit(w) for w in words]), (F.col("s_suppkey") % 9).cast("int")), "s_name")
    return t.read("supplier").select("s_suppkey", name.alias("name")).select(
        "s_suppkey", "name", rates.device_type("name").alias("device_type"), rates.mount_type("name").alias("mount_type")
    )


DEVICES = """SELECT s_suppkey, name, CASE WHEN contains(l, 'nvme') THEN 'nvme' WHEN contains(l, 'ssd') THEN 'ssd'
  WHEN contains(l, 'hd') OR contains(l, 'disk') THEN 'hdd' WHEN contains(l, 'nfs') OR contains(l, 'smb') OR contains(l, 'cifs') THEN 'network'
  ELSE 'unknown' END AS device_type,
  CASE WHEN contains(l, 'cifs') OR contains(l, 'smb') THEN 'smb' WHEN contains(l, 'nfs') THEN 'nfs'
  WHEN regexp_matches(l, 'gpfs|lustre|gluster|ceph|beegfs') THEN 'network_fs' WHEN contains(l, 'nvme') THEN 'nvme' ELSE 'unknown' END AS mount_type
FROM (SELECT *, lower(name) AS l FROM (SELECT s_suppkey, concat(['/dev/nvme0n1 ', 'Samsung SSD ', '/dev/hda ', 'Disk ', 'nfs4 host:/', 'CIFS ',
  'lustre@tcp ', 'ram ', 'beegfs_nodev '][(s_suppkey % 9)::INT + 1], s_name) AS name FROM supplier))"""


def _errors(t: Tables):
    kinds = ["io", "not_found", "permission_denied", "integrity_mismatch", "connection", "remote_transfer", "timeout", "config", "cancelled", "symlink"]
    typed = t.read("lineitem").where("l_returnflag = 'R'").select(
        F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("l_partkey") % 10).cast("int")).alias("kind"),
        F.when(F.col("l_suppkey") % 2 == 0, "permission_denied").otherwise("other").alias("io_kind"),
    )
    return rates.classify_errors(typed, io_kind="io_kind").groupBy("kind", "recoverable", "permission", "has_path").agg(F.count("*").alias("n"))


ERRORS = """SELECT kind, kind IN ('io', 'connection', 'remote_transfer', 'timeout') AS recoverable,
  kind = 'permission_denied' OR (kind = 'io' AND io_kind = 'permission_denied') AS permission,
  kind IN ('io', 'not_found', 'permission_denied', 'integrity_mismatch', 'symlink') AS has_path, count(*) AS n
FROM (SELECT ['io', 'not_found', 'permission_denied', 'integrity_mismatch', 'connection', 'remote_transfer', 'timeout', 'config', 'cancelled',
    'symlink'][(l_partkey % 10)::INT + 1] AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'permission_denied' ELSE 'other' END AS io_kind
  FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL"""


def _utilisation(t: Tables):
    """Devices: quantity in use of every part."""
    device = t.read("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("total"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).cast("bigint").alias("available"))
    return rates.with_utilisation(device, "total", "available").withColumn("used_percent", F.round("used_percent", 6))


QUERIES = {
    "parse_size": (
        lambda t: _size_texts(t).select("id", "text", sizes.parse_size("text").alias("bytes")),
        oracle(
            _parsed("bytes", [("T", 4), ("G", 3), ("M", 2), ("K", 1)], "[UB]+$", "B+$"), extra={"texts": SIZE_TEXTS}
        ),
    ),
    "parse_bandwidth": (
        lambda t: _size_texts(t).select("id", "text", sizes.parse_bandwidth("text").alias("rate")),
        oracle(_parsed("rate", [("G", 3), ("M", 2), ("K", 1)], "U*(UB)*$", "^$"), extra={"texts": SIZE_TEXTS}),
    ),
    "parse_listing": (
        lambda t: texts.parse_listing(t.listing_text()),
        oracle(
            "SELECT path AS key, size, CAST(floor(epoch(mtime)) AS BIGINT) AS last_modified FROM src_inventory", "src_inventory"
        ),
    ),
    "log_stats": (
        lambda t: texts.log_stats(_log_lines(t)),
        oracle(
            """SELECT count(*) AS total_files, count(*) FILTER (file_id % 6 IN (0, 1)) AS uploaded,
  count(*) FILTER (file_id % 6 IN (2, 3)) AS downloaded, count(*) FILTER (file_id % 6 = 4) AS failed FROM src_inventory""",
            "src_inventory",
        ),
    ),
    "sync_log_stats": (
        lambda t: texts.sync_log_stats(_sync_lines(t)),
        oracle(
            """SELECT CAST(sum(CASE WHEN file_id % 5 = 0 THEN size + file_id ELSE 0 END) AS BIGINT) AS bytes_transferred,
  count(*) FILTER (file_id % 5 = 1 OR (file_id % 5 = 4 AND file_id % 2 = 1)) AS files_transferred FROM src_inventory""",
            "src_inventory",
        ),
    ),
    "normalize_jobs": (
        lambda t: accounting.normalize_jobs(t.accounting()).select(
            "job_id", "memory_bytes", "time_limit_seconds", "time_limit_text", "hours_text", F.array_join("nodes", " ").alias("nodes")
        ),
        oracle(
            """SELECT job_id, memory_bytes, time_limit_seconds,
  CASE WHEN s IS NULL THEN NULL WHEN s >= 86400 THEN concat(s // 86400, '-', lpad(((s % 86400) // 3600)::VARCHAR, 2, '0'), ':', lpad(((s % 3600) // 60)::VARCHAR, 2, '0'), ':', lpad((s % 60)::VARCHAR, 2, '0'))
    ELSE concat(lpad((s // 3600)::VARCHAR, 2, '0'), ':', lpad(((s % 3600) // 60)::VARCHAR, 2, '0'), ':', lpad((s % 60)::VARCHAR, 2, '0')) END AS time_limit_text,
  CASE WHEN s IS NULL THEN NULL ELSE concat(CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END, s // 3600, ':', lpad(((s % 3600) // 60)::VARCHAR, 2, '0'), ':', lpad((s % 60)::VARCHAR, 2, '0')) END AS hours_text,
  nodes FROM (SELECT *, time_limit_seconds AS s FROM (SELECT o_orderkey AS job_id,
  CASE o_orderkey % 4 WHEN 0 THEN (p % 64) * 1073741824 WHEN 1 THEN p * 1048576 WHEN 2 THEN NULL ELSE p END AS memory_bytes,
  CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 9) * 86400 + (o_orderkey % 24) * 3600 + (p % 60) * 60 + 7
    WHEN 1 THEN (o_orderkey % 30) * 3600 + (p % 60) * 60 END AS time_limit_seconds,
  CASE WHEN o_orderkey % 2 = 0 THEN array_to_string(list_transform(range(o_orderkey % 8 + 1, o_orderkey % 8 + o_orderkey % 5 + 1), lambda i: concat('node', lpad(i::VARCHAR, 2, '0'))), ' ')
    ELSE concat('n', o_orderkey, ' m', o_orderkey) END AS nodes
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)))""",
        ),
    ),
    "job_nodes": (
        lambda t: accounting.job_nodes(t.accounting()),
        oracle(
            """SELECT o_orderkey AS job_id, concat('node', lpad(i::VARCHAR, 2, '0')) AS node FROM orders,
  LATERAL (SELECT unnest(range(o_orderkey % 8 + 1, o_orderkey % 8 + o_orderkey % 5 + 1)) AS i) WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, concat(x, o_orderkey) FROM orders, (VALUES ('n'), ('m')) v(x) WHERE o_orderkey % 2 = 1""",
        ),
    ),
    "job_resources": (
        lambda t: accounting.job_resources(t.accounting()).select("job_id", "total_cpus", "node_count"),
        oracle(
            """SELECT job_id, CASE WHEN num_tasks IS NOT NULL AND cpus_per_task IS NOT NULL THEN num_tasks * cpus_per_task
  WHEN num_tasks IS NOT NULL THEN num_tasks ELSE cpus_per_task END AS total_cpus,
  CASE WHEN job_id % 2 = 0 THEN (job_id % 5)::INT ELSE 2 END AS node_count FROM accounting""",
            "accounting",
        ),
    ),
    "job_states": (_states, STATES),
    "device_types": (_devices, DEVICES),
    "error_classes": (_errors, ERRORS),
    "retry_plan": (
        lambda t: rates.retry_plan(t.copy_results().where("status = 'failed'").select("path", "error"), 8),
        oracle(
            """SELECT path, error, a::INT AS attempt, least(2.0::DOUBLE ^ a, 64.0::DOUBLE) AS object_delay, 2.0::DOUBLE ^ a * 0.1::DOUBLE AS sync_delay
FROM copy_results, (SELECT unnest(range(1, 9)) AS a) WHERE status = 'failed'""",
            "copy_results",
        ),
    ),
    "utilisation": (
        _utilisation,
        oracle(
            """SELECT l_partkey, total, available, total - available AS used, round(CASE WHEN total > 0 THEN (total - available) / total::DOUBLE * 100.0 ELSE 0.0 END, 6) AS used_percent
FROM (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS total, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS available
  FROM lineitem GROUP BY l_partkey)""",
        ),
    ),
}
