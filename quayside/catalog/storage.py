"""Queries that go through files: trees, manifests, copies, archives, histories, states.

The given documents are written out as real files below the shared folder first, so the work
of every one of these grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.tables import Tables, oracle
from quayside.catalog.trees import mounted, sizes, tree
from quayside.functions.hashing import hash_content
from quayside.operators import transfers
from quayside.operators.inventory import manifest_head, scan_totals
from quayside.operators.manifest import manifest_from_scan
from quayside.plans import sync, transfer
from quayside.session import persist_shared
from quayside.sources import archives, copying, footers, manifests, scan
from quayside.sources.manifest_log import ManifestLog
from quayside.streaming import live
from quayside.streaming.live import new_folder


#: Paths of which three quarters have a hidden directory or name, in Spark and in DuckDB alike.
HIDDEN = """concat(CASE file_id % 4 WHEN 2 THEN '_' ELSE '' END, split_part(path, '/', 1), CASE file_id % 4 WHEN 3 THEN '/.' ELSE '/' END,
  split_part(path, '/', 2), CASE file_id % 4 WHEN 1 THEN '/.' WHEN 3 THEN '/_' ELSE '/' END, split_part(path, '/', 3))"""


def _scan(t: Tables):
    inventory, _ = scan.scan_inventory(t.spark, [tree(t)])
    return inventory


def _sizes(t: Tables):
    return sizes(t.content())


def _list_objects(t: Tables):
    return scan.list_objects(t.spark, tree(t, path=HIDDEN)).select("path", "size")


def _read_content(t: Tables):
    df = scan.scan_content(t.spark, [tree(t)], "*.txt")
    return df.select(F.substring_index("path", "/", -3).alias("path"), F.sha2("content", 256).alias("sha256"))


def _read_blocks(t: Tables):
    blocks = scan.read_blocks(_sizes(t), 4096, tree(t))
    return blocks.select("path", "block_index", "offset", "size", F.sha2("data", 256).alias("sha256"))


def _copy(t: Tables):
    """Copies the tree while hashing, then hashes the copies and compares."""
    root = tree(t)
    results = persist_shared(copying.copy_files(_sizes(t), root, root + "-copy", hash_algorithm="sha256"))
    there = copying.hash_files(_sizes(t), root + "-copy", "sha256")
    verified = sync.verify_trees(results.select("path", "hash"), there.select("path", "hash"))
    return results.join(verified.select("path", "result"), "path").select("path", "status", "bytes", "hash", "result")


def _incremental(t: Tables):
    root = tree(t)
    persist_shared(copying.copy_files(_sizes(t), root, root + "-copy"))
    return transfers.copy_summary(copying.copy_files(_sizes(t), root, root + "-copy", incremental=True))


def _dry_run(t: Tables):
    root = tree(t)
    planned = copying.copy_files(_sizes(t), root, root + "-none", dry_run=True)
    return planned.groupBy("status").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def _copy_chunks(t: Tables):
    root = tree(t)
    chunks = transfer.chunk_plan(_sizes(t), chunk=4096, minimum=8192)
    results = persist_shared(copying.copy_chunks(chunks, root, root + "-chunks"))
    whole = copying.chunk_completeness(results)
    hashes = copying.hash_files(_sizes(t), root + "-chunks", "sha256").select("path", "hash")
    return whole.join(hashes, "path").select("path", "bytes", "chunks", "complete", "hash")


def _archives(t: Tables, fmt: str):
    root = tree(t)
    batches = transfer.assign_batches(_sizes(t), ["path"], limit=256 * 1024)
    persist_shared(archives.write_archives(batches, root, root + "-archives", fmt))
    members = archives.read_archives(t.spark, root + "-archives")
    return members.select("path", "size", F.sha2("content", 256).alias("sha256"))


def _one_archive(t: Tables):
    """All files in one plain archive, which many tasks read by its index."""
    root = tree(t)
    persist_shared(archives.write_archives(_sizes(t).withColumn("batch", F.lit(0)), root, root + "-archive", "tar"))
    index = persist_shared(archives.archive_members(t.spark, root + "-archive"))
    return archives.read_members(index).select("archive", "path", "size", F.sha2("content", 256).alias("sha256"))


def _manifest(t: Tables) -> str:
    folder = new_folder(t.spark, "manifest")
    inventory = t.src_inventory().select(
        "path", "size", F.col("mtime").cast("timestamp").alias("mtime"), F.lit(False).alias("is_dir"), (F.col("file_id") % 13 == 0).alias("is_symlink"),
        F.when(F.col("file_id") % 13 == 0, F.concat(F.lit("to/"), "path")).alias("symlink_target"), (F.col("file_id") % 4096).cast("int").alias("permissions"),
        (F.col("file_id") % 3 + 1000).alias("uid"), F.lit(1000).cast("bigint").alias("gid"),
    )
    manifests.write_manifest(manifests.parquet_entries(inventory), folder)
    return folder


def _manifest_json(t: Tables):
    """All columns of the entries, with the header on every row. Every seventh path is no valid text."""
    folder = new_folder(t.spark, "manifest-json")
    odd = F.col("file_id") % 7 == 0
    scanned = t.src_inventory().withColumns(
        {"raw_path": F.concat(F.encode("path", "UTF-8"), F.when(odd, F.unhex(F.lit("FF"))).otherwise(F.lit(b""))), "permissions": (F.col("file_id") % 512).cast("int")}
    )
    entries = manifest_from_scan(scanned).withColumns({"hash": F.sha2("path", 256), "hash_algorithm": F.lit("sha256")})
    manifests.write_manifest_json(entries, folder, "/src", "/dst", 1_700_000_000)
    header, rows = manifests.read_manifest_json(t.spark, folder)
    top = header.first()
    return rows.select("*", *[F.lit(top[c]).alias(c) for c in ("version", "source_root", "dest_root", "created", "updated", "total_files", "total_size")])


def _hash_manifest(t: Tables):
    folder = new_folder(t.spark, "hashes")
    hashed = hash_content(t.content().withColumn("size", F.octet_length("text").cast("bigint")), "text", "sha256")
    manifests.write_hash_manifest(hashed.withColumn("mtime", F.lit(0)), folder, "sha256", "/src", 1_700_000_000)
    _, rows = manifests.read_hash_manifest(t.spark, folder)
    return rows.select("path", "size", "algorithm", "hash")


def _history(t: Tables):
    folder = new_folder(t.spark, "history")
    manifests.append_history(t.history(), folder)
    stored = manifests.read_history(t.spark, folder)
    return manifests.ended_between(stored, "1997-01-01", "1999-12-31").select("id", "status", "bytes_transferred")


def _write_documents(t: Tables, documents) -> str:
    """(path, content) rows as one JSON file each."""
    folder = mounted(new_folder(t.spark, "documents"))
    copying.write_files(documents, folder).agg(F.sum("bytes")).collect()
    return folder


def _history_json(t: Tables):
    """History documents with nested statistics, each of up to 1000 entries, read back flat."""
    stats = F.struct("total_files", "files_transferred", "files_failed", "bytes_transferred", "avg_throughput", "files_per_second")
    entry = F.struct(
        F.col("id").cast("string").alias("id"), "source", "destination", F.col("started_at").cast("timestamp").alias("started_at"),
        F.col("ended_at").cast("timestamp").alias("ended_at"), "duration_seconds", "status", stats.alias("stats"),
        F.struct("threads", "verify").alias("config"),
    )
    # ids are unique, so a thousand of them bound a document
    documents = t.history().groupBy(F.floor(F.col("id") / 1000).alias("n")).agg(F.to_json(F.collect_list(entry)).alias("content")).select(
        F.concat(F.lit("history-"), F.col("n").cast("string"), F.lit(".json")).alias("path"), "content"
    )
    flat = manifests.flat_history(manifests.read_history_json(t.spark, _write_documents(t, documents)))
    return flat.select(F.col("id").cast("bigint").alias("id"), "status", "total_files", "bytes_transferred", "threads", "verify")


def _states(t: Tables):
    """State documents of up to 1000 files each, read back as one table; every document has a
    truncated copy beside it, which must be skipped. The sums are per supplier."""
    state = F.struct(
        F.col("path").alias("relative_path"), F.col("bytes").alias("size"), F.col("bytes").alias("bytes_written"),
        F.col("job_id").alias("source_mtime"), F.lit(None).cast("string").alias("partial_checksum"), "status",
    )
    numbered = t.copy_results().withColumn("n", F.monotonically_increasing_id())
    lines = numbered.withColumn("path", F.concat_ws("/", "path", F.col("n").cast("string")))
    files = F.map_from_entries(F.collect_list(F.struct("path", state)))
    whole = lines.groupBy(F.floor(F.col("n") / 1000).cast("string").alias("id")).agg(files.alias("files")).select(
        F.concat("id", F.lit(".json")).alias("path"),
        F.to_json(F.struct("id", "files", F.lit("InProgress").alias("status"), F.lit(1).alias("last_checkpoint"))).alias("content"),
    )
    broken = whole.select(
        F.concat(F.lit("broken-"), "path").alias("path"), F.expr("substr(content, 1, length(content) div 2)").alias("content")
    )
    rows = manifests.read_states(t.spark, _write_documents(t, whole.unionByName(broken)))
    return rows.groupBy(F.col("source_mtime").alias("transfer_id")).agg(
        F.count("*").alias("files"), F.sum("bytes_written").alias("bytes_transferred")
    )


def _latest_states(t: Tables):
    """Two checkpoints of every transfer, the second of a third of the files and appended twice, as after a retry."""
    folder = new_folder(t.spark, "state-log")
    first = t.src_inventory().select(
        (F.col("file_id") % 50).alias("transfer_id"), "path", "size", F.floor(F.col("size") / 2).cast("bigint").alias("bytes_written"),
        F.lit(1).cast("bigint").alias("last_checkpoint"), F.lit("InProgress").alias("file_status"), "file_id",
    )
    second = first.where(F.col("file_id") % 3 == 0).withColumns(
        {"bytes_written": F.col("size"), "last_checkpoint": F.lit(2).cast("bigint"), "file_status": F.lit("Completed")}
    )
    for rows in (first, second, second):
        manifests.append_states(rows.drop("file_id"), folder)
    return manifests.latest_states(manifests.read_stored_states(t.spark, folder))


def _stream_inventory(t: Tables):
    root = tree(t, path=HIDDEN)
    batches = live.run_now(live.stream_inventory(t.spark, root), name="inventory")
    return live.current_manifest(batches).select("path", "size")


def _manifest_log(t: Tables):
    """Five change sets with removed, changed and doubled paths through a log that merges its levels."""
    entries = manifest_from_scan(t.src_inventory().withColumn("raw_path", F.lit(None).cast("binary")))
    numbered = entries.join(t.src_inventory().select("path", "file_id"), "path")
    numbered = persist_shared(numbered)
    log = ManifestLog.create(t.spark, new_folder(t.spark, "manifest-log"), entries.schema, buckets=8, fanout=2)
    for b in range(5):
        now = numbered.where(F.col("file_id") % (b + 1) == 0).withColumn("size", F.col("size") + b)
        older = now.withColumns({"size": F.col("size") + 7, "mtime": F.col("mtime") - 1})
        log.apply(now.unionByName(older), numbered.where(F.col("file_id") % 11 == b), order=["mtime"])
    log.vacuum()
    return log.state().select("path", "size", "mtime")


SIZES = f"SELECT {HIDDEN} AS path, strlen(text) AS size FROM content"

QUERIES = {
    "scan_inventory": (
        lambda t: _scan(t).where("NOT is_dir").select("path", "size", "is_symlink"),
        oracle("SELECT path, strlen(text) AS size, false AS is_symlink FROM content", "content"),
    ),
    "scan_tree_totals": (
        lambda t: scan_totals(_scan(t)),
        oracle(
            """SELECT count(*) AS file_count, 1 + count(DISTINCT split_part(path, '/', 1)) + count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dir_count,
  CAST(sum(strlen(text)) AS BIGINT) AS total_size FROM content""",
            "content",
        ),
    ),
    "list_objects": (_list_objects, oracle(SIZES, "content")),
    "scan_content": (_read_content, oracle("SELECT path, sha256(text) AS sha256 FROM content", "content")),
    "read_blocks": (
        _read_blocks,
        oracle(
            """SELECT path, i AS block_index, i * 4096 AS "offset", length(substr(h, (i * 8192 + 1)::INT, 8192)) // 2 AS size,
  sha256(unhex(substr(h, (i * 8192 + 1)::INT, 8192))) AS sha256
FROM (SELECT path, h, unnest(range((length(h) + 8191) // 8192)) AS i FROM (SELECT path, hex(encode(text)) AS h FROM content))""",
            "content",
        ),
    ),
    "copy_files": (
        _copy,
        oracle("SELECT path, 'copied' AS status, strlen(text) AS bytes, sha256(text) AS hash, 'match' AS result FROM content", "content"),
    ),
    "copy_incremental": (
        _incremental,
        oracle(
            """SELECT CAST(0 AS BIGINT) AS files_copied, count(*) AS files_skipped, CAST(0 AS BIGINT) AS files_failed,
  CAST(0 AS BIGINT) AS bytes_copied FROM content""",
            "content",
        ),
    ),
    "copy_dry_run": (
        _dry_run,
        oracle("SELECT 'planned' AS status, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM content", "content"),
    ),
    "copy_chunks": (
        _copy_chunks,
        oracle(
            """SELECT path, strlen(text) AS bytes, CASE WHEN strlen(text) >= 8192 THEN (strlen(text) + 4095) // 4096 ELSE 1 END AS chunks,
  true AS complete, sha256(text) AS hash FROM content""",
            "content",
        ),
    ),
    "archive_members": (
        _one_archive,
        oracle("SELECT 'batch-00000000-0000.tar' AS archive, path, strlen(text) AS size, sha256(text) AS sha256 FROM content", "content"),
    ),
    "archive_round_trip": (
        lambda t: _archives(t, "tar-gz"),
        oracle("SELECT path, strlen(text) AS size, sha256(text) AS sha256 FROM content", "content"),
    ),
    "manifest_round_trip": (
        lambda t: manifests.read_manifest(t.spark, _manifest(t)),
        oracle(
            """SELECT path, size, CAST(floor(epoch(mtime)) AS BIGINT) AS mtime_secs, CAST(0 AS BIGINT) AS mtime_nsecs, file_id % 4096 AS permissions,
  CAST(1000 + file_id % 3 AS BIGINT) AS uid, CAST(1000 AS BIGINT) AS gid, (file_id % 4096) & 2048 <> 0 AS setuid, (file_id % 4096) & 1024 <> 0 AS setgid,
  (file_id % 4096) & 512 <> 0 AS sticky, CASE WHEN file_id % 13 = 0 THEN 'symlink' ELSE 'file' END AS file_type,
  CASE WHEN file_id % 13 = 0 THEN concat('to/', path) END AS symlink_target, NULL::VARCHAR AS xxhash3, NULL::VARCHAR AS blake3 FROM src_inventory""",
            "src_inventory",
        ),
    ),
    "manifest_count": (
        lambda t: manifests.manifest_count(t.spark, _manifest(t)),
        oracle("SELECT count(*) AS entries FROM src_inventory", "src_inventory"),
    ),
    "manifest_footers": (
        lambda t: footers.footer_totals(footers.manifest_footers(t.spark, _manifest(t))).select("entries", "first", "last"),
        oracle("SELECT count(*) AS entries, min(path) AS first, max(path) AS last FROM src_inventory", "src_inventory"),
    ),
    "manifest_range": (
        lambda t: footers.entries_between(t.spark, _manifest(t), "p2/", "p3/O").select("path", "size", "permissions", "file_type"),
        oracle(
            """SELECT path, size, file_id % 4096 AS permissions, CASE WHEN file_id % 13 = 0 THEN 'symlink' ELSE 'file' END AS file_type
FROM src_inventory WHERE path BETWEEN 'p2/' AND 'p3/O'""", "src_inventory"
        ),
    ),
    "manifest_head": (
        lambda t: manifest_head(manifests.read_manifest(t.spark, _manifest(t)), 20).select("path", "size"),
        oracle("SELECT path, size FROM src_inventory ORDER BY path LIMIT 20", "src_inventory"),
    ),
    "manifest_json_round_trip": (
        _manifest_json,
        oracle(
            """SELECT path, CASE WHEN file_id % 7 = 0 THEN lower(concat(hex(encode(path)), 'FF')) END AS path_bytes, size,
  CAST(floor(epoch(mtime)) AS BIGINT) AS mtime, sha256(path) AS hash, 'sha256' AS hash_algorithm, CAST(file_id % 512 AS INT) AS permissions,
  1 AS version, '/src' AS source_root, '/dst' AS dest_root, 1700000000 AS created, 1700000000 AS updated,
  count(*) OVER () AS total_files, CAST(sum(size) OVER () AS BIGINT) AS total_size FROM src_inventory""",
            "src_inventory",
        ),
    ),
    "manifest_log": (
        _manifest_log,
        oracle(
            """SELECT path, size + b AS size, mtime FROM (SELECT path, size, CAST(floor(epoch(mtime)) AS BIGINT) AS mtime,
    list_max(list_filter(range(5), lambda b: file_id % (b + 1) = 0)) AS b,
    list_max(list_filter(range(5), lambda b: file_id % 11 = b)) AS g FROM src_inventory) WHERE b >= coalesce(g, -1)""",
            "src_inventory",
        ),
    ),
    "hash_manifest_round_trip": (
        _hash_manifest,
        oracle("SELECT path, strlen(text) AS size, 'sha256' AS algorithm, sha256(text) AS hash FROM content", "content"),
    ),
    "history_store": (
        _history,
        oracle(
            """SELECT id, status, bytes_transferred FROM history WHERE CAST(ended_at AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
            "history",
        ),
    ),
    "history_documents": (
        _history_json,
        oracle("SELECT id, status, total_files, bytes_transferred, threads, verify FROM history", "history"),
    ),
    "transfer_state_documents": (
        _states,
        oracle(
            """SELECT job_id AS transfer_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes_transferred FROM copy_results GROUP BY job_id""",
            "copy_results",
        ),
    ),
    "latest_transfer_states": (
        _latest_states,
        oracle(
            """SELECT file_id % 50 AS transfer_id, path, size, CASE WHEN file_id % 3 = 0 THEN size ELSE size // 2 END AS bytes_written,
  CAST(CASE WHEN file_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS last_checkpoint,
  CASE WHEN file_id % 3 = 0 THEN 'Completed' ELSE 'InProgress' END AS file_status FROM src_inventory""",
            "src_inventory",
        ),
    ),
    "stream_inventory": (_stream_inventory, oracle(SIZES, "content")),
}
