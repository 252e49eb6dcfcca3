"""The usual chains of operators: copy a tree, verify two trees, compare transfers, apply a delta."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import content, delta, history, inventory, transfers
from quayside.plans import sync
from quayside.session import persist_shared
from quayside.sources import copying, scan


@dataclass
class CopyRun:
    """Results are rows per file; the summaries have one row."""

    results: DataFrame
    summary: DataFrame
    verification: DataFrame | None
    scan_errors: DataFrame


def copy_tree(
    spark: SparkSession,
    source: str,
    dest: str,
    incremental: bool = False,
    verify: str | None = None,
    dry_run: bool = False,
    preserve: bool = True,
    on_error: str = "continue",
    **scan_options,
) -> CopyRun:
    """Scan, copy (or plan) and verify a tree. ``verify`` names a hash algorithm: files are
    hashed while they are copied and once more at the destination."""
    found, errors = scan.scan_inventory(spark, [source], **scan_options)
    files = persist_shared(found.where("NOT is_dir").select("path", "size"))
    # the copy has effects: its result rows are written once and read from there
    results = persist_shared(
        copying.copy_files(files, source, dest, dry_run, incremental, preserve, verify, on_error)
    )
    verification = None
    if verify and not dry_run:
        copied = results.where("status = 'copied'").select("path", "hash", F.col("bytes").alias("size"))
        there = copying.hash_files(copied, dest, verify)
        verification = sync.verify_trees(copied, there)
    return CopyRun(results, transfers.copy_summary(results), verification, errors)


def verify_directories(spark: SparkSession, source: str, dest: str, algorithm: str | None = None) -> DataFrame:
    """Differences of two trees: path and what is wrong with it; no rows means equal.

    Without an algorithm sizes and times decide, and newer destinations are reported as
    conflicts; with one, contents do.
    """
    a, _ = scan.scan_inventory(spark, [source])
    b, _ = scan.scan_inventory(spark, [dest])
    a, b = a.where("NOT is_dir"), b.where("NOT is_dir")
    if algorithm is None:
        plan = sync.sync_plan(a, b, delete_extra=True)
        return plan.where("action <> 'Skip'").select("path", F.col("action").alias("difference"))
    hashes = [copying.hash_files(df, root, algorithm) for df, root in ((a, source), (b, dest))]
    return sync.verify_trees(*hashes).where("result <> 'match'").select("path", F.col("result").alias("difference"))


@dataclass
class Comparison:
    entries: DataFrame
    metrics: DataFrame
    trend: DataFrame
    anomalies: DataFrame
    recommendations: DataFrame


def compare_transfers(entries: DataFrame, ids: list) -> Comparison:
    """Everything the comparison of picked history entries shows, in the order of ``ids``."""
    picked = inventory.pick(entries, ids)
    order = ["position"]
    return Comparison(
        entries=picked.select(
            "position", "id", "started_at", "duration_seconds", "bytes_transferred", "files_transferred", "avg_throughput", "status"
        ),
        metrics=history.compare(picked),
        trend=history.trend(picked, order=order),
        anomalies=history.detect_anomalies(picked),
        recommendations=history.recommendations(picked, order=order),
    )


def delta_transfer(old: DataFrame, new: DataFrame, block: int, column: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ops, literal blocks, summary) that turn the old contents into the new ones."""
    base = content.signatures(content.split_blocks(old, column, block, keep=["path"]))
    target = content.split_blocks(new, column, block, keep=["path"])
    matches = delta.match_chunks(content.signatures(target), base)
    return delta.delta_ops(matches, block), delta.literal_blocks(target, matches), delta.delta_summary(matches)
