"""Guarded ratios, retry delays, error and device classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.paths import _col


def ratio(part: Column | str, whole: Column | str, empty: float = 0.0) -> Column:
    """part / whole, or ``empty`` where the whole is not positive."""
    p, w = _col(part).cast("double"), _col(whole).cast("double")
    return F.when(w > 0, p / w).otherwise(F.lit(empty))


def percent(part: Column | str, whole: Column | str, empty: float = 0.0) -> Column:
    p, w = _col(part).cast("double"), _col(whole).cast("double")
    return F.when(w > 0, p / w * 100.0).otherwise(F.lit(empty))


def eta_seconds(done: Column | str, total: Column | str, throughput: Column | str) -> Column:
    """Seconds to the end at the present rate; null when done or standing still."""
    d, t, r = _col(done), _col(total), _col(throughput)
    return F.when((r > 0) & (d < t), (t - d).cast("double") / r)


def with_rates(df: DataFrame, done: str, total: str, seconds: str, ok: str, files: str) -> DataFrame:
    """Adds success_rate (100 when there was nothing to do), throughput, percent, eta_seconds."""
    out = df.select(
        "*",
        percent(ok, files, empty=100.0).alias("success_rate"),
        ratio(done, seconds).alias("throughput"),
        percent(done, total).alias("percent"),
    )
    return out.withColumn("eta_seconds", eta_seconds(done, total, "throughput"))


def with_utilisation(df: DataFrame, total: str, available: str) -> DataFrame:
    """Adds used and used_percent of a memory or device table."""
    used = F.col(total) - F.col(available)
    return df.select("*", used.alias("used"), percent(used, total).alias("used_percent"))


def object_retry_delay(attempt: Column | str, cap: int = 64) -> Column:
    """2^attempt seconds, at most ``cap``."""
    return F.least(F.pow(F.lit(2.0), _col(attempt)), F.lit(float(cap)))


def sync_retry_delay(attempt: Column | str, base: float = 0.1) -> Column:
    """base * 2^attempt seconds."""
    return F.pow(F.lit(2.0), _col(attempt)) * F.lit(base)


def retry_plan(failed: DataFrame, max_retries: int = 3) -> DataFrame:
    """One row per failed item and attempt with both delays."""
    tries = failed.select("*", F.explode(F.sequence(F.lit(1), F.lit(max_retries))).alias("attempt"))
    return tries.select(
        "*",
        object_retry_delay("attempt").alias("object_delay"),
        sync_retry_delay("attempt").alias("sync_delay"),
    )


# Error kinds by property.
RECOVERABLE = ["io", "connection", "remote_transfer", "timeout"]
WITH_PATH = [
    "io", "not_found", "permission_denied", "same_source_and_destination", "integrity_mismatch",
    "insufficient_space", "file_too_large", "symlink", "unsupported_file_type",
]


def classify_errors(df: DataFrame, kind: str = "kind", io_kind: str | None = None) -> DataFrame:
    """Adds recoverable, permission, has_path; ``io_kind`` names the system error of io rows."""
    denied = F.col(kind) == "permission_denied"
    if io_kind:
        denied = denied | ((F.col(kind) == "io") & F.coalesce(F.col(io_kind) == "permission_denied", F.lit(False)))
    return df.select(
        "*",
        F.col(kind).isin(RECOVERABLE).alias("recoverable"),
        denied.alias("permission"),
        F.col(kind).isin(WITH_PATH).alias("has_path"),
    )


# Name parts and the class they stand for, first match wins.
DEVICE_CLASSES = [("nvme", ["nvme"]), ("ssd", ["ssd"]), ("hdd", ["hd", "disk"]), ("network", ["nfs", "smb", "cifs"])]
MOUNT_CLASSES = [
    ("smb", ["cifs", "smb"]),
    ("nfs", ["nfs"]),
    ("network_fs", ["gpfs", "lustre", "gluster", "ceph", "beegfs"]),
    ("nvme", ["nvme"]),
]


def _class_of(name: Column, classes: list[tuple[str, list[str]]]) -> Column:
    text = F.lower(name)
    out = None
    for label, parts in classes:
        test = F.lit(False)
        for part in parts:
            test = test | F.contains(text, F.lit(part))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("unknown")


def device_type(name: Column | str) -> Column:
    return _class_of(_col(name), DEVICE_CLASSES)


def mount_type(description: Column | str) -> Column:
    """Class of a mount from its device and file-system text."""
    return _class_of(_col(description), MOUNT_CLASSES)
