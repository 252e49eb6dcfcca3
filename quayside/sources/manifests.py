"""Manifests, hash manifests, histories and transfer states at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside import schemas
from quayside.functions.security import decode_mode
from quayside.sources.footers import footer_totals, manifest_footers
from quayside.sources.stores import KNOWN, scheme_of

#: Rows per row group of the Parquet manifest's files.
ROWS_PER_FILE = 500_000


def write_manifest(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet manifest, zstd-compressed. Sorting by path inside each file lets the column
    encodings share path prefixes and the row-group statistics prune by path."""
    (
        entries.sortWithinPartitions("path")
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .parquet(path)
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Parquet manifest with sizes as bigint (an unsigned 64-bit column reads as decimal)."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("bigint") for c, t in kinds.items() if t.startswith("decimal")})


def save_inventory_table(inventory: DataFrame, table: str, buckets: int, mode: str = "errorifexists") -> None:
    """Inventory or manifest as a table bucketed and sorted by path.

    Plans and diffs of two tables with the same number of buckets join without a shuffle, so
    an estate that is compared again and again is shuffled once, when it is stored.
    """
    (
        inventory.repartition(buckets, "path")
        .write.mode(mode)
        .bucketBy(buckets, "path")
        .sortBy("path")
        .option("compression", "zstd")
        .saveAsTable(table)
    )


def parquet_entries(inventory: DataFrame) -> DataFrame:
    """The 14 manifest columns of scanned files; hashes are left null."""
    micros = F.unix_micros(F.col("mtime").cast("timestamp"))
    decoded = decode_mode(inventory.where("NOT is_dir"))
    return decoded.select(
        "path",
        "size",
        F.floor(micros / 1_000_000).cast("bigint").alias("mtime_secs"),
        (F.pmod(micros, F.lit(1_000_000)) * 1000).alias("mtime_nsecs"),
        F.col("permissions").cast("bigint").alias("permissions"),
        "uid",
        "gid",
        "setuid",
        "setgid",
        "sticky",
        F.when(F.col("is_symlink"), "symlink").otherwise("file").alias("file_type"),
        "symlink_target",
        F.lit(None).cast("string").alias("xxhash3"),
        F.lit(None).cast("string").alias("blake3"),
    )


def manifest_count(spark: SparkSession, path: str) -> DataFrame:
    """Number of entries, from the footers alone: no data page is read. Where tasks cannot open the store, Spark counts; its
    scan reads no column either."""
    if scheme_of(path) not in KNOWN:
        return spark.read.parquet(path).agg(F.count("*").alias("entries"))
    return footer_totals(manifest_footers(spark, path)).select("entries")


def read_manifest_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, entries) of a manifest: what :func:`write_manifest_json` wrote (a header beside JSON lines), a single
    document, or a folder of documents. A folder named ``header`` below the path tells the first from the others.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        header = spark.read.schema(schemas.MANIFEST_DOCUMENT).json(f"{path}/header").drop("entries")
        return header, spark.read.schema(schemas.MANIFEST_ENTRY.replace(":", "")).json(f"{path}/entries")
    doc = spark.read.schema(schemas.MANIFEST_DOCUMENT).option("multiLine", "true").json(path)
    return doc.drop("entries"), doc.select(F.explode("entries").alias("e")).select("e.*")


def write_manifest_json(
    entries: DataFrame, path: str, source_root: str, dest_root: str, now: int, single_document: bool = False
) -> None:
    """JSON manifest: a header and JSON lines of entries, spread over tasks, whatever their number.

    ``single_document`` writes one document instead, for tools that expect that; one task then holds all entries."""
    columns = ["path", "path_bytes", "size", "mtime", "hash", "hash_algorithm", "permissions"]
    totals = entries.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")
    ).select(
        F.lit(1).alias("version"),
        F.lit(source_root).alias("source_root"),
        F.lit(dest_root).alias("dest_root"),
        F.lit(now).alias("created"),
        F.lit(now).alias("updated"),
        "total_files",
        "total_size",
    )
    if single_document:
        all_of = entries.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("entries"))
        totals.select("*", all_of.scalar().alias("entries")).coalesce(1).write.json(path)
    else:
        totals.coalesce(1).write.json(f"{path}/header")
        entries.select(*columns).write.option("ignoreNullFields", "true").json(f"{path}/entries")


def write_hash_manifest(hashes: DataFrame, path: str, algorithm: str, root: str, now: int) -> None:
    """Hash manifest as JSON lines of entries beside a one-line header."""
    spark = hashes.sparkSession
    spark.range(1).select(
        F.lit(algorithm).alias("algorithm"), F.lit(now).alias("created"), F.lit(root).alias("root")
    ).coalesce(1).write.json(f"{path}/header")
    hashes.select("path", "size", "hash", "algorithm", "mtime").write.json(f"{path}/entries")


def read_hash_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, entries) of :func:`write_hash_manifest`."""
    header = spark.read.schema(schemas.HASH_DOCUMENT).json(f"{path}/header").drop("entries")
    return header, spark.read.schema(schemas.HASH_ENTRY.replace(":", "")).json(f"{path}/entries")


def read_hash_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, entries) of a single hash-manifest document."""
    doc = spark.read.schema(schemas.HASH_DOCUMENT).option("multiLine", "true").json(path)
    return doc.drop("entries"), doc.select(F.explode("entries").alias("e")).select("e.*")


def find_entry(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("path") == path)


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """History entries of a JSON array document, with nested stats and config. Unreadable
    documents give no entries."""
    return (
        spark.read.schema(schemas.HISTORY)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .json(path)
        .where("id IS NOT NULL")
    )


def flat_history(history: DataFrame) -> DataFrame:
    """The columns the history operators use."""
    return history.select(
        "id", "source", "destination", "started_at", "ended_at", "duration_seconds", "status",
        *[F.col(f"stats.{c}") for c in (
            "total_files", "files_transferred", "files_failed", "bytes_transferred", "avg_throughput", "files_per_second"
        )],
        F.col("config.threads"),
        F.col("config.verify"),
    )


def append_history(entries: DataFrame, path: str) -> None:
    """Appends to the stored history, one folder per month of end, so that a period filter
    reads its months only. ``rebalance`` brings a month together and splits a crowded one."""
    dated = entries.withColumn("ended_month", F.trunc(F.to_date("ended_at"), "month"))
    dated.hint("rebalance", "ended_month").write.mode("append").partitionBy("ended_month").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ended_between(history: DataFrame, first: str, last: str) -> DataFrame:
    """Entries of a stored history by day of end (both included); other months are not read."""
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    return history.where(
        F.col("ended_month").between(F.trunc(low, "month"), high) & F.to_date("ended_at").between(low, high)
    )


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per (transfer, file) of all transfer-state documents; corrupt ones are skipped."""
    docs = (
        spark.read.schema(schemas.STATE)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .where("id IS NOT NULL AND files IS NOT NULL")
    )
    return docs.select(
        F.col("id").alias("transfer_id"), "source", "destination", "started_at", "last_checkpoint", "status", F.explode("files").alias("path", "f")
    ).select(
        "transfer_id", "source", "destination", "started_at", "last_checkpoint", "status", "path",
        "f.size", "f.bytes_written", "f.source_mtime", "f.partial_checksum", F.col("f.status").alias("file_status"),
    )


def append_states(states: DataFrame, path: str, batch: str | None = None) -> str:
    """Adds state rows (transfer_id, path, last_checkpoint, ...) to a table of them, as batch ``batch``; tells its name.

    Every batch is a folder, which writing it again replaces, so a repeated append changes nothing. Without a name the rows
    name their batch by a hash of all of them."""
    if batch is None:
        row = F.xxhash64(*states.columns)
        known = states.agg(F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(2**31))).alias("s"), F.count("*").alias("n")).first()
        batch = f"{(known['x'] or 0) & (2**64 - 1):016x}-{known['s'] or 0:x}-{known['n']}"
    placed = states.withColumn("batch", F.lit(batch)).sortWithinPartitions("transfer_id", "path")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return batch


def read_stored_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def latest_states(states: DataFrame) -> DataFrame:
    """Latest row per (transfer, file) of a state table; of equally late ones that with more bytes written."""
    rest = [c for c in states.columns if c not in ("transfer_id", "path")]
    newest = F.max_by(F.struct(*rest), F.struct("last_checkpoint", "bytes_written")).alias("_r")
    return states.groupBy("transfer_id", "path").agg(newest).select("transfer_id", "path", "_r.*").select(*states.columns)
