"""Schemas of the stored documents and tables."""

from __future__ import annotations

# Inventory rows of a scan. ``path`` is relative to ``root``; ``raw_path`` holds the bytes of
# a path that is not valid UTF-8. Times are microseconds, as finely as Spark keeps them.
INVENTORY = """root string, path string, raw_path binary, size bigint, mtime timestamp, created timestamp,
is_dir boolean, is_symlink boolean, symlink_target string, permissions int, uid bigint, gid bigint, st_blocks bigint"""

# Parquet manifest: seconds and nanoseconds apart, so nothing is lost.
MANIFEST = """path string, size bigint, mtime_secs bigint, mtime_nsecs bigint, permissions bigint, uid bigint, gid bigint,
setuid boolean, setgid boolean, sticky boolean, file_type string, symlink_target string, xxhash3 string, blake3 string"""

# One JSON manifest document.
MANIFEST_ENTRY = """path: string, path_bytes: string, size: bigint, mtime: bigint, hash: string, hash_algorithm: string, permissions: int"""
MANIFEST_DOCUMENT = f"""version int, source_root string, dest_root string, created bigint, updated bigint,
total_files bigint, total_size bigint, entries array<struct<{MANIFEST_ENTRY}>>"""

HASH_ENTRY = "path: string, size: bigint, hash: string, algorithm: string, mtime: bigint"
HASH_DOCUMENT = f"algorithm string, created bigint, root string, entries array<struct<{HASH_ENTRY}>>"

# History entries.
STATS = """total_files: bigint, files_transferred: bigint, files_failed: bigint, files_skipped: bigint, directories_created: bigint,
bytes_transferred: bigint, total_source_bytes: bigint, avg_throughput: double, peak_throughput: double, min_throughput: double,
throughput_stddev: double, files_per_second: double,
verification: struct<algorithm: string, files_verified: bigint, verification_failures: bigint, overhead_seconds: double>,
compression: struct<algorithm: string, original_bytes: bigint, compressed_bytes: bigint, ratio: double, overhead_seconds: double>,
delta: struct<files_analyzed: bigint, files_delta_transferred: bigint, bytes_saved: bigint, total_chunks: bigint, matched_chunks: bigint>"""
CONFIG = """threads: bigint, buffer_size: bigint, parallel_connections: bigint, verify: boolean, compression: boolean,
incremental: boolean, delta: boolean, bandwidth_limit: bigint"""
SNAPSHOT = "hostname: string, cpu_usage: double, memory_usage: double, disk_io_usage: double, network_usage: double, load_average: double"
HISTORY = f"""id string, job_id string, name string, source string, destination string, transfer_type string,
started_at timestamp, ended_at timestamp, duration_seconds double, status string, error string,
stats struct<{STATS}>, config struct<{CONFIG}>, system_snapshot struct<{SNAPSHOT}>"""

# Transfer-state documents: a map of file states per transfer.
FILE_STATE = "relative_path: string, size: bigint, bytes_written: bigint, source_mtime: bigint, partial_checksum: string, status: string"
STATE = f"""id string, source string, destination string, total_size bigint, bytes_transferred bigint,
files map<string, struct<{FILE_STATE}>>, started_at bigint, last_checkpoint bigint, options_hash decimal(20,0), status string"""
