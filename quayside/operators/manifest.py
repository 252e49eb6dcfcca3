"""Manifest rows: building, upserting, removing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.plans.sync import epoch_seconds


def manifest_from_scan(inventory: DataFrame) -> DataFrame:
    """Manifest entries of a scan: whole-second mtime, no hash yet.

    ``path_bytes`` is the lowercase hex of a path that is not valid UTF-8, from the scan's
    ``raw_path`` column (binary) where it has one; ``path`` is the readable form.
    """
    raw = F.col("raw_path") if "raw_path" in inventory.columns else F.lit(None).cast("binary")
    lossy = raw.isNotNull() & (F.encode("path", "UTF-8") != raw)
    mode = F.col("permissions").cast("int") if "permissions" in inventory.columns else F.lit(None).cast("int")
    files = inventory.where(~F.col("is_dir")) if "is_dir" in inventory.columns else inventory
    return files.select(
        "path",
        F.when(lossy, F.lower(F.hex(raw))).alias("path_bytes"),
        "size",
        epoch_seconds("mtime").alias("mtime"),
        F.lit(None).cast("string").alias("hash"),
        F.lit(None).cast("string").alias("hash_algorithm"),
        mode.alias("permissions"),
    )


def dealt_by_path(rows: DataFrame) -> DataFrame:
    """Rows shuffled by path into as many partitions as the session has, which adaptive execution does not bring together.

    Sorted in memory, rows of entries take many times their shuffled bytes, so partitions that were put together by those
    make tasks that grow with the table; this many share it evenly. A join with them is cut the same way. For rows with few of a path."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def newest_per_path(rows: DataFrame, order: list[str | Column], keys: list[str] | None = None) -> DataFrame:
    """The row of each path that is greatest by ``order``; of rows that agree in it the greatest by all columns."""
    keys = keys or ["path"]
    rest = [c for c in rows.columns if c not in keys]
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = F.struct(*[c.alias(f"o{n}") for n, c in enumerate(by)], *[F.col(c).alias(f"c{n}") for n, c in enumerate(rest)])
    newest = rows.groupBy(*keys).agg(F.max(ranked).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.c{n}").alias(c) for n, c in enumerate(rest)]).select(*rows.columns)


def upsert(manifest: DataFrame, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Manifest with the rows of ``changes`` added or put in place of old ones; of doubled paths in ``changes``
    the row that is greatest by ``order`` counts (``mtime`` first, if there is one)."""
    single = newest_per_path(changes, order or [c for c in ("mtime", "mtime_secs") if c in changes.columns])
    # whether a path is in the changes does not depend on which of its rows counts: bare paths, not sorted once more for the join
    kept = manifest.join(dealt_by_path(changes.select("path")), "path", "left_anti")
    return kept.unionByName(single, allowMissingColumns=True)


def remove(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    return manifest.join(dealt_by_path(gone.select("path")), "path", "left_anti")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")
    )
