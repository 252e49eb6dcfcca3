"""Queries on filters, projections, totals and orderings of inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.tables import Tables, oracle
from quayside.functions import paths, sizes
from quayside.functions.security import acl_rights, decode_mode
from quayside.operators import filters, inventory
from quayside.plans import transfer

CATEGORY = """CASE WHEN size < 4096 THEN 'tiny' WHEN size < 1048576 THEN 'small'
  WHEN size < 104857600 THEN 'medium' WHEN size < 1073741824 THEN 'large' ELSE 'huge' END"""
PRIORITY = """CASE WHEN size < 4096 THEN 0 WHEN size < 1048576 THEN 1
  WHEN size < 104857600 THEN 2 WHEN size < 1073741824 THEN 3 ELSE 4 END"""
MIB = 1024 * 1024


def _src(t: Tables):
    return t.src_inventory().select("path", "size", "mtime")


def _acl(t: Tables):
    """One access-control entry per line of an order, with masks over all bits."""
    mask = F.expr(
        "CASE WHEN l_returnflag = 'R' THEN 2032127L WHEN l_linestatus = 'O' THEN shiftleft(1L, cast(l_partkey % 32 as int)) "
        "ELSE (l_partkey * 2654435761L) % 4294967296L END"
    )
    kind = F.when(F.col("l_returnflag") == "A", "AccessDenied").otherwise("AccessAllowed")
    entries = t.read("lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.array(
            F.struct(
                kind.alias("ace_type"),
                mask.alias("access_mask"),
                F.concat(F.lit("S-1-"), F.col("l_suppkey").cast("string")).alias("sid"),
            )
        ).alias("entries"),
    )
    return acl_rights(entries).withColumn("rights", F.array_join("rights", ","))


RIGHTS_SQL = """SELECT file_id, ace_type, sid, access_mask,
  CASE WHEN access_mask & 2032127 = 2032127 THEN 'Full Control' ELSE concat_ws(',',
    CASE WHEN access_mask & 2147483649 <> 0 THEN 'Read' END, CASE WHEN access_mask & 1073741826 <> 0 THEN 'Write' END,
    CASE WHEN access_mask & 536870944 <> 0 THEN 'Execute' END, CASE WHEN access_mask & 65536 <> 0 THEN 'Delete' END,
    CASE WHEN access_mask & 262144 <> 0 THEN 'Change Permissions' END, CASE WHEN access_mask & 524288 <> 0 THEN 'Take Ownership' END) END AS rights
FROM (SELECT l_orderkey AS file_id, CASE WHEN l_returnflag = 'A' THEN 'AccessDenied' ELSE 'AccessAllowed' END AS ace_type,
  concat('S-1-', l_suppkey) AS sid,
  CASE WHEN l_returnflag = 'R' THEN 2032127 WHEN l_linestatus = 'O' THEN CAST(1 AS BIGINT) << CAST(l_partkey % 32 AS INT)
    ELSE (l_partkey * 2654435761) % 4294967296 END AS access_mask FROM lineitem)"""


def _uris(t: Tables):
    """Page addresses in the forms a source argument can take."""
    url = F.col("url")
    host = F.regexp_extract(url, "^https?://([^/]*)", 1)
    rest = F.regexp_replace(url, "^https?://[^/]*", "")
    text = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("s3://"), host, rest))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("user@"), host, F.lit(":"), rest))
        .otherwise(url)
    )
    out = t.read("pages").select("page_id", text.alias("uri"))
    split = out.select(
        "page_id", "uri", paths.split_object_url("uri").alias("o"), paths.split_remote_path("uri").alias("r")
    )
    return split.select(
        "page_id", "uri", "o.bucket", "o.key", F.col("r.user").alias("user_name"), F.col("r.host").alias("host"),
        F.col("r.path").alias("remote_path"),
    )


URIS_SQL = """SELECT page_id, uri,
  CASE WHEN starts_with(uri, 's3://') THEN split_part(substr(uri, 6), '/', 1) END AS bucket,
  CASE WHEN starts_with(uri, 's3://') THEN CASE WHEN position('/' IN substr(uri, 6)) = 0 THEN ''
    ELSE substr(uri, 6 + position('/' IN substr(uri, 6))) END END AS key,
  CASE WHEN remote THEN split_part(uri, '@', 1) END AS user_name,
  CASE WHEN remote THEN substr(split_part(uri, ':', 1), position('@' IN uri) + 1) END AS host,
  CASE WHEN remote THEN substr(uri, position(':' IN uri) + 1) END AS remote_path
FROM (SELECT *, position(':' IN uri) > 0 AND position('@' IN split_part(uri, ':', 1)) > 0 AS remote FROM (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?://', 's3://')
    WHEN 1 THEN concat('user@', regexp_extract(url, '^https?://([^/]*)', 1), ':', regexp_replace(url, '^https?://[^/]*', ''))
    ELSE url END AS uri FROM pages))"""


def _page(t: Tables):
    """A page with its header on every row."""
    rows, header = inventory.paginate(t.jobs(), [F.desc("created_at"), "id"], page=3, per_page=20)
    counts = [F.lit(header[c]).cast("bigint").alias(c) for c in ("total", "total_pages")]
    return rows.select("*", *counts, F.lit(header["page"]).alias("page"), F.lit(header["per_page"]).alias("per_page"))


QUERIES = {
    "filter_size": (
        lambda t: filters.filter_size(_src(t), 4096, 100 * MIB).select("path", "size"),
        oracle("SELECT path, size FROM src_inventory WHERE size BETWEEN 4096 AND 104857600", "src_inventory"),
    ),
    "filter_globs": (
        lambda t: filters.filter_globs(
            _src(t), ["p[12]/*.bin", "p?/{O,F}/*.txt", "**/*.log"], ["*[!0-8].log", "p1/P/**"]
        ).select("path"),
        oracle(
            r"""SELECT path FROM src_inventory WHERE (regexp_full_match(path, 'p[12]/.*\.bin')
  OR regexp_full_match(path, 'p./(O|F)/.*\.txt') OR regexp_full_match(path, '(|.*/)[^/]*\.log') OR regexp_full_match(path, '.*\.log'))
  AND NOT regexp_full_match(path, '.*[^0-8]\.log') AND NOT starts_with(path, 'p1/P/')""",
            "src_inventory",
        ),
    ),
    "filter_hidden": (
        lambda t: filters.filter_hidden(_src(t)).select("path"),
        oracle("SELECT path FROM src_inventory WHERE NOT starts_with(list_last(string_split(path, '/')), '.')", "src_inventory"),
    ),
    "filter_depth": (
        lambda t: filters.filter_depth(t.dst_inventory(), 3).select("path"),
        oracle("SELECT path FROM dst_inventory WHERE len(string_split(path, '/')) <= 3", "dst_inventory"),
    ),
    "relative_paths": (
        lambda t: t.dst_inventory().select(
            "path",
            paths.relative_to("path", "extra").alias("relative_path"),
            paths.under("/backup/", "path").alias("destination"),
        ),
        oracle(
            """SELECT path, CASE WHEN starts_with(path, 'extra/') THEN substr(path, 7) ELSE path END AS relative_path,
  concat('/backup/', path) AS destination FROM dst_inventory""",
            "dst_inventory",
        ),
    ),
    "file_extensions": (
        lambda t: _src(t).select("path", paths.extension("path").alias("extension")),
        oracle(
            r"""SELECT path, CASE WHEN len(parts) = 1 OR (len(parts) = 2 AND parts[1] = '') THEN NULL ELSE list_last(parts) END AS extension
FROM (SELECT path, string_split(list_last(string_split(path, '/')), '.') AS parts FROM src_inventory)""",
            "src_inventory",
        ),
    ),
    "size_categories": (
        lambda t: _src(t).select(
            "path", sizes.size_category("size").alias("category"), sizes.task_priority("size").alias("priority")
        ),
        oracle(f"SELECT path, {CATEGORY} AS category, {PRIORITY} AS priority FROM src_inventory", "src_inventory"),
    ),
    "decode_mode": (
        lambda t: decode_mode(t.mode_bits()),
        oracle(
            """SELECT path, permissions, permissions & 2048 <> 0 AS setuid, permissions & 1024 <> 0 AS setgid,
  permissions & 512 <> 0 AS sticky, concat(
    CASE WHEN permissions & 256 <> 0 THEN 'r' ELSE '-' END, CASE WHEN permissions & 128 <> 0 THEN 'w' ELSE '-' END,
    CASE WHEN permissions & 64 <> 0 THEN 'x' ELSE '-' END, CASE WHEN permissions & 32 <> 0 THEN 'r' ELSE '-' END,
    CASE WHEN permissions & 16 <> 0 THEN 'w' ELSE '-' END, CASE WHEN permissions & 8 <> 0 THEN 'x' ELSE '-' END,
    CASE WHEN permissions & 4 <> 0 THEN 'r' ELSE '-' END, CASE WHEN permissions & 2 <> 0 THEN 'w' ELSE '-' END,
    CASE WHEN permissions & 1 <> 0 THEN 'x' ELSE '-' END) AS rwx, permissions & 2 <> 0 AS world_writable FROM mode_bits""",
            "mode_bits",
        ),
    ),
    "access_rights": (_acl, RIGHTS_SQL),
    "split_uris": (_uris, URIS_SQL),
    "scan_totals": (
        lambda t: inventory.scan_totals(_src(t)),
        oracle(
            "SELECT count(*) AS file_count, CAST(0 AS BIGINT) AS dir_count, CAST(sum(size) AS BIGINT) AS total_size FROM src_inventory",
            "src_inventory",
        ),
    ),
    "dir_usage": (
        lambda t: inventory.dir_usage(t.dst_inventory()),
        oracle(
            """SELECT array_to_string(parts[:n], '/') AS directory, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
FROM (SELECT size, parts, unnest(range(1, len(parts))) AS n
  FROM (SELECT size, string_split(path, '/') AS parts FROM dst_inventory)) GROUP BY 1""",
            "dst_inventory",
        ),
    ),
    "category_summary": (
        lambda t: inventory.category_summary(_src(t)),
        oracle(
            f"SELECT {CATEGORY} AS category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM src_inventory GROUP BY 1",
            "src_inventory",
        ),
    ),
    "split_by_size": (
        lambda t: inventory.split_summary(_src(t), MIB),
        oracle(
            """SELECT CASE WHEN size < 1048576 THEN 'below' ELSE 'at_or_above' END AS side, count(*) AS files,
  CAST(sum(size) AS BIGINT) AS bytes FROM src_inventory GROUP BY 1""",
            "src_inventory",
        ),
    ),
    "path_stats": (
        lambda t: inventory.path_stats(t.src_inventory().select("path").unionAll(t.dst_inventory().select("path"))),
        oracle(
            """SELECT count(*) AS rows, count(DISTINCT path) AS distinct_paths, count(*) - count(DISTINCT path) AS duplicates
FROM (SELECT path FROM src_inventory UNION ALL SELECT path FROM dst_inventory)""",
            "src_inventory", "dst_inventory",
        ),
    ),
    "duplicate_paths": (
        lambda t: inventory.duplicate_paths(t.src_inventory().select("path").unionAll(t.dst_inventory().select("path"))),
        oracle(
            """SELECT path, count(*) AS n FROM (SELECT path FROM src_inventory UNION ALL SELECT path FROM dst_inventory)
GROUP BY path HAVING count(*) > 1""",
            "src_inventory", "dst_inventory",
        ),
    ),
    "dedup_paths": (
        lambda t: inventory.dedup_paths(t.src_inventory().select("path").unionAll(t.dst_inventory().select("path"))),
        oracle("SELECT path FROM src_inventory UNION SELECT path FROM dst_inventory", "src_inventory", "dst_inventory"),
    ),
    "sorted_paths": (
        lambda t: inventory.sorted_paths(t.dst_inventory()),
        oracle("SELECT DISTINCT path FROM dst_inventory ORDER BY path", "dst_inventory"),
    ),
    "order_smallest_first": (
        lambda t: inventory.order_files(_src(t), "smallest").select("path", "size"),
        oracle("SELECT path, size FROM src_inventory ORDER BY size, path", "src_inventory"),
    ),
    "order_newest_first": (
        lambda t: inventory.order_files(_src(t), "newest").select("path", "size"),
        oracle("SELECT path, size FROM src_inventory ORDER BY mtime DESC, path", "src_inventory"),
    ),
    "order_largest_first": (
        lambda t: inventory.order_files(_src(t), "largest").select("path", "size"),
        oracle("SELECT path, size FROM src_inventory ORDER BY size DESC, path", "src_inventory"),
    ),
    "order_oldest_first": (
        lambda t: inventory.order_files(_src(t), "oldest").select("path", "size"),
        oracle("SELECT path, size FROM src_inventory ORDER BY mtime, path", "src_inventory"),
    ),
    "next_tasks": (
        lambda t: inventory.next_tasks(_src(t), 100).select("path", "size", "priority"),
        oracle(f"SELECT path, size, {PRIORITY} AS priority FROM src_inventory ORDER BY priority, size, path LIMIT 100", "src_inventory"),
    ),
    "paginate_jobs": (
        _page,
        oracle(
            """SELECT *, (SELECT count(*) FROM jobs) AS total, 3 AS page, 20 AS per_page, (SELECT (count(*) + 19) // 20 FROM jobs) AS total_pages
FROM jobs ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""",
            "jobs",
        ),
    ),
    "plan_dirs": (
        lambda t: transfer.plan_dirs(t.dst_inventory(), transfer.plan_dirs(t.src_inventory())),
        oracle(
            """SELECT path, len(string_split(path, '/')) AS depth FROM (
  SELECT DISTINCT array_to_string(parts[:n], '/') AS path FROM (SELECT parts, unnest(range(1, len(parts))) AS n
    FROM (SELECT string_split(path, '/') AS parts FROM dst_inventory))
  EXCEPT SELECT array_to_string(parts[:n], '/') FROM (SELECT parts, unnest(range(1, len(parts))) AS n
    FROM (SELECT string_split(path, '/') AS parts FROM src_inventory)))""",
            "src_inventory", "dst_inventory",
        ),
    ),
    "sparse_flags": (
        lambda t: _sparse_flags(t),
        oracle(
            """SELECT path, size, allocated, allocated < greatest(size - 4096, 0) AS likely_sparse,
  round(CASE WHEN size > 0 THEN greatest(1.0 - allocated::DOUBLE / size, 0.0) ELSE 0.0 END, 9) AS sparse_ratio
FROM (SELECT path, size, (CASE WHEN file_id % 4 = 0 THEN size // 2 ELSE size END + 511) // 512 * 512 AS allocated FROM src_inventory)""",
            "src_inventory",
        ),
    ),
}


def _sparse_flags(t: Tables):
    from quayside.operators.content import with_sparse_flag

    df = t.src_inventory().select(
        "path", "size", F.expr("(CASE WHEN file_id % 4 = 0 THEN size div 2 ELSE size END + 511) div 512").alias("st_blocks")
    )
    return with_sparse_flag(df).select(
        "path", "size", "allocated", "likely_sparse", F.round("sparse_ratio", 9).alias("sparse_ratio")
    )
