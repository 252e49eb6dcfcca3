"""Queries on synchronisation plans and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.tables import Tables, oracle
from quayside.functions.hashing import hash_content
from quayside.operators import inventory, manifest
from quayside.plans import sync, transfer

PLAN_SQL = """SELECT coalesce(s.path, d.path) AS path,
  CASE WHEN s.path IS NULL THEN 'Delete' WHEN d.path IS NULL THEN 'CopyNew'
    WHEN s.size <> d.size OR s.mtime > d.mtime THEN 'Update'
    WHEN s.mtime < d.mtime THEN 'Conflict' ELSE 'Skip' END AS action,
  CASE WHEN s.path IS NULL THEN d.size WHEN d.path IS NULL THEN s.size
    WHEN s.size <> d.size OR s.mtime > d.mtime THEN s.size ELSE 0 END AS size
FROM src_inventory s FULL JOIN dst_inventory d ON s.path = d.path"""

HASHES_SQL = {
    "a": "SELECT path, sha256(text) AS hash FROM content",
    "b": "SELECT path, sha256(text) AS hash FROM content_new",
}
VERIFY_SQL = """SELECT coalesce(a.path, b.path) AS path, a.hash AS src_hash, b.hash AS dst_hash,
  CASE WHEN b.path IS NULL THEN 'missing_dest' WHEN a.path IS NULL THEN 'missing_source'
    WHEN a.hash = b.hash THEN 'match' ELSE 'mismatch' END AS result
FROM a FULL JOIN b ON a.path = b.path"""


def _plan(t: Tables, **options):
    return sync.sync_plan(t.src_inventory(), t.dst_inventory(), **options)


def _verified(t: Tables):
    a = hash_content(t.content(), "text", "sha256").select("path", "hash")
    b = hash_content(t.content_new(), "text", "sha256").select("path", "hash")
    return sync.verify_trees(a, b)


def _hash_plan(t: Tables):
    """content_compare: hashes of equal-sized files decide. Times are equal on both sides here."""
    side = lambda df: hash_content(df, "text", "sha256").select(
        "path", F.length("text").cast("bigint").alias("size"), F.lit(0).alias("mtime"), "hash"
    )
    return sync.sync_plan(side(t.content_new()), side(t.content()), True, content_compare=True)


QUERIES = {
    "sync_plan": (
        lambda t: _plan(t, delete_extra=True),
        oracle(PLAN_SQL, "src_inventory", "dst_inventory"),
    ),
    "sync_plan_keep_extra": (
        lambda t: _plan(t),
        oracle(PLAN_SQL.replace("FULL JOIN", "LEFT JOIN"), "src_inventory", "dst_inventory"),
    ),
    "sync_plan_ignore_times": (
        lambda t: _plan(t, delete_extra=True, ignore_times=True),
        oracle(
            """SELECT coalesce(s.path, d.path) AS path,
  CASE WHEN s.path IS NULL THEN 'Delete' WHEN d.path IS NULL THEN 'CopyNew'
    WHEN s.size <> d.size THEN 'Update' ELSE 'Skip' END AS action,
  CASE WHEN s.path IS NULL THEN d.size WHEN d.path IS NULL OR s.size <> d.size THEN s.size ELSE 0 END AS size
FROM src_inventory s FULL JOIN dst_inventory d ON s.path = d.path""",
            "src_inventory", "dst_inventory",
        ),
    ),
    "sync_plan_content_compare": (
        _hash_plan,
        oracle(
            """SELECT coalesce(s.path, d.path) AS path,
  CASE WHEN s.path IS NULL THEN 'Delete' WHEN d.path IS NULL THEN 'CopyNew'
    WHEN s.text <> d.text THEN 'Update' ELSE 'Skip' END AS action,
  CASE WHEN s.path IS NULL THEN length(d.text) WHEN d.path IS NULL OR s.text <> d.text THEN length(s.text) ELSE 0 END AS size
FROM content_new s FULL JOIN content d ON s.path = d.path""",
            "content_new",
        ),
    ),
    "plan_summary": (
        lambda t: sync.plan_summary(_plan(t, delete_extra=True)),
        oracle(
            """SELECT count(*) FILTER (action = 'CopyNew') AS new_files, count(*) FILTER (action = 'Update') AS updated_files,
  count(*) FILTER (action = 'Skip') AS skipped_files, count(*) FILTER (action = 'Conflict') AS conflicts,
  count(*) FILTER (action = 'Delete') AS deleted_files,
  CAST(sum(CASE WHEN action IN ('CopyNew', 'Update') THEN size ELSE 0 END) AS BIGINT) AS bytes_to_copy,
  CAST(sum(CASE WHEN action = 'Delete' THEN size ELSE 0 END) AS BIGINT) AS bytes_to_delete,
  (SELECT count(*) FROM src_inventory) AS source_count, (SELECT count(*) FROM dst_inventory) AS dest_count,
  count(*) FILTER (action IN ('CopyNew', 'Update', 'Delete')) > 0 AS has_changes FROM plan""",
            "src_inventory", "dst_inventory", extra={"plan": PLAN_SQL},
        ),
    ),
    "changed_files": (
        lambda t: sync.changed_files(_plan(t)),
        oracle(
            "SELECT path FROM plan WHERE action IN ('CopyNew', 'Update')",
            "src_inventory", "dst_inventory", extra={"plan": PLAN_SQL},
        ),
    ),
    "manifest_plan": (
        lambda t: sync.manifest_plan(t.src_inventory(), t.manifest(), delete_extra=True),
        oracle(
            """SELECT coalesce(s.path, m.path) AS path,
  CASE WHEN s.path IS NULL THEN 'Delete' WHEN m.path IS NULL THEN 'CopyNew'
    WHEN s.size = m.size AND CAST(floor(epoch(s.mtime)) AS BIGINT) = m.mtime THEN 'Skip' ELSE 'Update' END AS action,
  CASE WHEN s.path IS NULL THEN m.size WHEN m.path IS NULL THEN s.size
    WHEN s.size = m.size AND CAST(floor(epoch(s.mtime)) AS BIGINT) = m.mtime THEN 0 ELSE s.size END AS size
FROM src_inventory s FULL JOIN manifest m ON s.path = m.path""",
            "src_inventory", "manifest",
        ),
    ),
    "manifest_diff": (
        lambda t: sync.manifest_diff(t.src_inventory(), t.manifest()),
        oracle(
            """SELECT coalesce(s.path, m.path) AS path,
  CASE WHEN m.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'deleted'
    WHEN s.size = m.size AND CAST(floor(epoch(s.mtime)) AS BIGINT) = m.mtime THEN 'unchanged' ELSE 'modified' END AS state
FROM src_inventory s FULL JOIN manifest m ON s.path = m.path""",
            "src_inventory", "manifest",
        ),
    ),
    "manifest_diff_summary": (
        lambda t: sync.diff_summary(sync.manifest_diff(t.src_inventory(), t.manifest())),
        oracle(
            """SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'modified') AS modified,
  count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state = 'unchanged') AS unchanged,
  count(*) FILTER (state <> 'unchanged') AS change_count FROM (SELECT
  CASE WHEN m.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'deleted'
    WHEN s.size = m.size AND CAST(floor(epoch(s.mtime)) AS BIGINT) = m.mtime THEN 'unchanged' ELSE 'modified' END AS state
FROM src_inventory s FULL JOIN manifest m ON s.path = m.path)""",
            "src_inventory", "manifest",
        ),
    ),
    "extra_files": (
        lambda t: sync.extra_files(t.src_inventory(), t.dst_inventory()).select("path", "size"),
        oracle(
            "SELECT path, size FROM dst_inventory WHERE path NOT IN (SELECT path FROM src_inventory)",
            "src_inventory", "dst_inventory",
        ),
    ),
    "paths_in": (
        lambda t: inventory.paths_in(t.src_inventory(), t.dst_inventory()).select("path", "size"),
        oracle(
            "SELECT path, size FROM src_inventory WHERE path IN (SELECT path FROM dst_inventory)",
            "src_inventory", "dst_inventory",
        ),
    ),
    "object_sync_plan": (
        lambda t: sync.object_sync_plan(t.src_inventory(), t.objects(), "backup"),
        oracle(
            """SELECT path, concat('backup/', path) AS key, s.size, reason, reason <> 'current' AS upload FROM (
  SELECT s.path, s.size, CASE WHEN o.key IS NULL THEN 'absent' WHEN o.size <> s.size THEN 'size_differs'
    WHEN o.last_modified < CAST(floor(epoch(s.mtime)) AS BIGINT) THEN 'remote_older' ELSE 'current' END AS reason
  FROM src_inventory s LEFT JOIN objects o ON o.key = concat('backup/', s.path)) s""",
            "src_inventory", "objects",
        ),
    ),
    "object_download_plan": (
        lambda t: sync.object_download_plan(t.objects(), t.src_inventory(), "backup"),
        oracle(
            """SELECT key, path, size, reason, reason <> 'current' AS download FROM (
  SELECT o.key, substr(o.key, 8) AS path, o.size, CASE WHEN s.path IS NULL THEN 'absent' WHEN o.size <> s.size THEN 'size_differs'
    WHEN CAST(floor(epoch(s.mtime)) AS BIGINT) < o.last_modified THEN 'local_older' ELSE 'current' END AS reason
  FROM objects o LEFT JOIN src_inventory s ON s.path = substr(o.key, 8))""",
            "src_inventory", "objects",
        ),
    ),
    "incremental_skip": (
        lambda t: sync.incremental_skip(t.src_inventory(), t.dst_inventory()).select("path", "skip"),
        oracle(
            """SELECT s.path, coalesce(d.size = s.size AND d.mtime >= s.mtime, false) AS skip
FROM src_inventory s LEFT JOIN dst_inventory d ON s.path = d.path""",
            "src_inventory", "dst_inventory",
        ),
    ),
    "verify_trees": (_verified, oracle(VERIFY_SQL, "content", "content_new", extra=HASHES_SQL)),
    "verify_summary": (
        lambda t: sync.verify_summary(_verified(t)),
        oracle(
            """SELECT count(*) AS verified, count(*) FILTER (result = 'match') AS passed,
  count(*) FILTER (result <> 'match') AS failed FROM v""",
            "content", "content_new", extra={**HASHES_SQL, "v": VERIFY_SQL},
        ),
    ),
    "verify_manifest": (
        lambda t: sync.verify_manifest(
            hash_content(t.content_new(), "text", "sha256"), hash_content(t.content(), "text", "sha256")
        ),
        oracle(
            """SELECT a.path, coalesce(a.hash = b.hash, false) AS verified, b.path IS NULL AS missing
FROM a LEFT JOIN b ON a.path = b.path""",
            "content", "content_new", extra=HASHES_SQL,
        ),
    ),
    "verify_sizes": (
        lambda t: sync.verify_sizes(t.src_inventory(), t.dst_inventory()),
        oracle(
            "SELECT s.path, s.size = d.size AS verified FROM src_inventory s JOIN dst_inventory d ON s.path = d.path",
            "src_inventory", "dst_inventory",
        ),
    ),
    "manifest_from_scan": (
        lambda t: manifest.manifest_from_scan(t.src_inventory()).select("path", "path_bytes", "size", "mtime"),
        oracle(
            "SELECT path, CAST(NULL AS VARCHAR) AS path_bytes, size, CAST(floor(epoch(mtime)) AS BIGINT) AS mtime FROM src_inventory",
            "src_inventory",
        ),
    ),
    "manifest_upsert": (
        lambda t: manifest.upsert(t.manifest(), manifest.manifest_from_scan(t.src_inventory()).select("path", "size", "mtime")),
        oracle(
            """SELECT path, size, CAST(floor(epoch(mtime)) AS BIGINT) AS mtime FROM src_inventory
UNION ALL SELECT * FROM manifest WHERE path NOT IN (SELECT path FROM src_inventory)""",
            "src_inventory", "manifest",
        ),
    ),
    "manifest_remove": (
        lambda t: manifest.remove(t.manifest(), t.src_inventory()),
        oracle(
            "SELECT path, size, mtime FROM manifest WHERE path NOT IN (SELECT path FROM src_inventory)",
            "src_inventory", "manifest",
        ),
    ),
}
