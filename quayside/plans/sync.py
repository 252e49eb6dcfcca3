"""Synchronisation plans and verification: inventories joined by relative path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions that move bytes.
COPIES = ("CopyNew", "Update")


def _side(df: DataFrame, prefix: str, columns: list[str], key: str = "path") -> DataFrame:
    return df.select(F.col(key).alias("path"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def sync_plan(
    source: DataFrame,
    dest: DataFrame,
    delete_extra: bool = False,
    ignore_times: bool = False,
    content_compare: bool = False,
) -> DataFrame:
    """One row per path: CopyNew, Update, Skip, Conflict or Delete, and the bytes it moves.

    A size difference is an update whatever the times say; with equal sizes the newer source
    is an update and the newer destination a conflict. ``content_compare`` judges equal sizes
    by a ``hash`` column instead of by time. Without ``delete_extra`` the destination-only
    rows are not even read past the join: it is a left join then.
    """
    columns = ["size", "mtime"] + (["hash"] if content_compare else [])
    src = _side(source, "src", columns)
    dst = _side(dest, "dst", columns)
    src = src.withColumn("_in_src", F.lit(True))
    dst = dst.withColumn("_in_dst", F.lit(True))
    both = src.join(dst, "path", "full_outer" if delete_extra else "left")
    if content_compare:
        unequal = F.when(~F.col("src_hash").eqNullSafe(F.col("dst_hash")), "Update").otherwise("Skip")
    elif ignore_times:
        unequal = F.lit("Skip")
    else:
        unequal = (
            F.when(F.col("src_mtime") > F.col("dst_mtime"), "Update")
            .when(F.col("src_mtime") < F.col("dst_mtime"), "Conflict")
            .otherwise("Skip")
        )
    action = (
        F.when(F.col("_in_src").isNull(), "Delete")
        .when(F.col("_in_dst").isNull(), "CopyNew")
        .when(F.col("src_size") != F.col("dst_size"), "Update")
        .otherwise(unequal)
    )
    size = (
        F.when(F.col("action").isin(*COPIES), F.col("src_size"))
        .when(F.col("action") == "Delete", F.col("dst_size"))
        .otherwise(F.lit(0))
    )
    return both.withColumn("action", action).select("path", "action", size.cast("bigint").alias("size"))


def manifest_plan(
    source: DataFrame, manifest: DataFrame, delete_extra: bool = False, ignore_times: bool = False
) -> DataFrame:
    """Plan against a manifest (``mtime`` in whole seconds): equal size and second or an
    update; a manifest knows no conflict."""
    src = _side(source.withColumn("mtime", epoch_seconds("mtime")), "src", ["size", "mtime"])
    known = _side(manifest, "known", ["size", "mtime"])
    src = src.withColumn("_in_src", F.lit(True))
    known = known.withColumn("_in_known", F.lit(True))
    same = F.col("src_size") == F.col("known_size")
    if not ignore_times:
        same = same & (F.col("src_mtime") == F.col("known_mtime"))
    action = (
        F.when(F.col("_in_src").isNull(), "Delete")
        .when(F.col("_in_known").isNull(), "CopyNew")
        .when(same, "Skip")
        .otherwise("Update")
    )
    size = (
        F.when(F.col("action") == "Skip", F.lit(0))
        .when(F.col("action") == "Delete", F.col("known_size"))
        .otherwise(F.col("src_size"))
    )
    joined = src.join(known, "path", "full_outer" if delete_extra else "left")
    return joined.withColumn("action", action).select("path", "action", size.cast("bigint").alias("size"))


def epoch_seconds(column: str) -> Column:
    """Whole seconds since 1970, never negative."""
    return F.greatest(F.unix_seconds(F.col(column).cast("timestamp")), F.lit(0))


def manifest_diff(source: DataFrame, manifest: DataFrame) -> DataFrame:
    """added, modified, deleted or unchanged per path."""
    src = _side(source.withColumn("mtime", epoch_seconds("mtime")), "src", ["size", "mtime"])
    known = _side(manifest, "known", ["size", "mtime"])
    src, known = src.withColumn("_in_src", F.lit(True)), known.withColumn("_in_known", F.lit(True))
    state = (
        F.when(F.col("_in_known").isNull(), "added")
        .when(F.col("_in_src").isNull(), "deleted")
        .when(
            F.col("src_size").eqNullSafe(F.col("known_size"))
            & F.col("src_mtime").eqNullSafe(F.col("known_mtime")),
            "unchanged",
        )
        .otherwise("modified")
    )
    return src.join(known, "path", "full_outer").select("path", state.alias("state"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: counts per action, bytes to copy and to delete, files on either side, changes."""
    is_ = lambda *names: F.col("action").isin(*names)
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0))
    return plan.agg(
        F.count_if(is_("CopyNew")).alias("new_files"),
        F.count_if(is_("Update")).alias("updated_files"),
        F.count_if(is_("Skip")).alias("skipped_files"),
        F.count_if(is_("Conflict")).alias("conflicts"),
        F.count_if(is_("Delete")).alias("deleted_files"),
        total(is_(*COPIES)).alias("bytes_to_copy"),
        total(is_("Delete")).alias("bytes_to_delete"),
        F.count_if(~is_("Delete")).alias("source_count"),
        F.count_if(~is_("CopyNew")).alias("dest_count"),
        (F.count_if(is_(*COPIES, "Delete")) > 0).alias("has_changes"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    is_ = lambda name: F.count_if(F.col("state") == name)
    return diff.agg(
        is_("added").alias("added"),
        is_("modified").alias("modified"),
        is_("deleted").alias("deleted"),
        is_("unchanged").alias("unchanged"),
        (F.count_if(F.col("state") != "unchanged")).alias("change_count"),
    )


def changed_files(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("action").isin(*COPIES)).select("path")


def needs_sync(plan: DataFrame) -> bool:
    """True as soon as one row of the plan changes anything."""
    return not plan.where(F.col("action").isin(*COPIES, "Delete")).isEmpty()


def extra_files(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Destination files the source does not have."""
    return dest.join(source.select("path"), "path", "left_anti")


def incremental_skip(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Source rows with ``skip``: same size and a destination that is not older."""
    dst = _side(dest, "dst", ["size", "mtime"])
    same = (F.col("size") == F.col("dst_size")) & (F.col("dst_mtime") >= F.col("mtime"))
    return source.join(dst, "path", "left").select(
        *source.columns, F.coalesce(same, F.lit(False)).alias("skip")
    )


def object_sync_plan(source: DataFrame, objects: DataFrame, prefix: str) -> DataFrame:
    """Upload decision per file: absent, size_differs, remote_older or current. Never deletes."""
    local = source.select(
        "path",
        F.concat(F.lit(prefix + "/"), "path").alias("key"),
        "size",
        epoch_seconds("mtime").alias("mtime"),
    )
    remote = objects.select("key", F.col("size").alias("remote_size"), "last_modified")
    reason = (
        F.when(F.col("remote_size").isNull(), "absent")
        .when(F.col("remote_size") != F.col("size"), "size_differs")
        .when(F.col("last_modified") < F.col("mtime"), "remote_older")
        .otherwise("current")
    )
    return local.join(remote, "key", "left").select(
        "path", "key", "size", reason.alias("reason"), (reason != "current").alias("upload")
    )


def object_download_plan(objects: DataFrame, local: DataFrame, prefix: str) -> DataFrame:
    """The same decision the other way round: which objects to fetch below a local tree."""
    from quayside.plans.transfer import strip_keys

    remote = strip_keys(objects, prefix)
    here = local.select(
        "path", F.col("size").alias("local_size"), epoch_seconds("mtime").alias("local_mtime")
    )
    reason = (
        F.when(F.col("local_size").isNull(), "absent")
        .when(F.col("local_size") != F.col("size"), "size_differs")
        .when(F.col("local_mtime") < F.col("last_modified"), "local_older")
        .otherwise("current")
    )
    return remote.join(here, "path", "left").select(
        "key", "path", "size", reason.alias("reason"), (reason != "current").alias("download")
    )


def verify_trees(source_hashes: DataFrame, dest_hashes: DataFrame) -> DataFrame:
    """Compares (path, hash) of both sides: match, mismatch, missing_dest or missing_source."""
    src = source_hashes.select("path", F.col("hash").alias("src_hash"), F.lit(True).alias("_in_src"))
    dst = dest_hashes.select("path", F.col("hash").alias("dst_hash"), F.lit(True).alias("_in_dst"))
    result = (
        F.when(F.col("_in_dst").isNull(), "missing_dest")
        .when(F.col("_in_src").isNull(), "missing_source")
        .when(F.col("src_hash").eqNullSafe(F.col("dst_hash")), "match")
        .otherwise("mismatch")
    )
    return src.join(dst, "path", "full_outer").select(
        "path", "src_hash", "dst_hash", result.alias("result")
    )


def verify_manifest(hashes: DataFrame, expected: DataFrame) -> DataFrame:
    """Checks (path, algorithm, hash) against expected rows: equal algorithm and equal hash."""
    want = expected.select(
        "path", F.col("algorithm").alias("want_algorithm"), F.col("hash").alias("want_hash")
    )
    ok = (F.col("algorithm") == F.col("want_algorithm")) & (F.col("hash") == F.col("want_hash"))
    return want.join(hashes.select("path", "algorithm", "hash"), "path", "left").select(
        "path", F.coalesce(ok, F.lit(False)).alias("verified"), F.col("hash").isNull().alias("missing")
    )


def verify_sizes(source: DataFrame, dest: DataFrame) -> DataFrame:
    dst = _side(dest, "dst", ["size"])
    return source.join(dst, "path").select("path", (F.col("size") == F.col("dst_size")).alias("verified"))


def verify_summary(results: DataFrame) -> DataFrame:
    """Verified, passed and failed counts of :func:`verify_trees` rows; the failed rows
    themselves are those with a result other than ``match``."""
    match = F.col("result") == "match"
    return results.agg(
        F.count("*").alias("verified"), F.count_if(match).alias("passed"), F.count_if(~match).alias("failed")
    )
