"""Scans, copies, archives and manifests on real temporary trees."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.operators import transfers
from quayside.plans import sync, transfer
from quayside.sources import archives, copying, manifests, scan


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    files = {"small.txt": b"x" * 10, "medium.bin": b"m" * 100 * 1024, "subdir/nested.txt": b"nested", ".hidden": b"h", ".git/config": b"cfg", "subdir2/nested/deep.txt": b"deep", "empty": b""}
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root, files


def _files(df):
    return {r.path for r in df.where("NOT is_dir").collect()}


def test_scan_hidden_filters_depth(spark, tree):
    root, files = tree
    found, errors = scan.scan_inventory(spark, [str(root)])
    assert _files(found) == set(files) - {".hidden"}  # .git/config is not hidden by its parent
    assert {r.path for r in found.where("is_dir").collect()} == {"", "subdir", "subdir2", "subdir2/nested"}
    assert errors.isEmpty()
    everything, _ = scan.scan_inventory(spark, [str(root)], include_hidden=True)
    assert _files(everything) == set(files)
    some, _ = scan.scan_inventory(spark, [str(root)], exclude=["*.bin"], include=["*.txt", "*.bin"], min_size=5)
    assert _files(some) == {"small.txt", "subdir/nested.txt"}
    shallow, _ = scan.scan_inventory(spark, [str(root)], max_depth=1)
    assert _files(shallow) == {"small.txt", "medium.bin", "empty"}


def test_scan_columns(spark, tree):
    root, files = tree
    os.utime(root / "small.txt", ns=(0, 1_700_000_000_123_456_000))
    os.chmod(root / "small.txt", 0o4750)
    row = scan.scan_inventory(spark, [str(root)])[0].where("path = 'small.txt'").first()
    assert (row["size"], row.is_symlink, row.permissions & 0o7777) == (10, False, 0o4750)
    entry = manifests.parquet_entries(scan.scan_inventory(spark, [str(root)])[0]).where("path = 'small.txt'").first()
    assert (entry.mtime_secs, entry.mtime_nsecs, entry.setuid, entry.file_type) == (1_700_000_000, 123_456_000, True, "file")


def test_scan_links_and_errors(spark, tree):
    root, _ = tree
    (root / "link").symlink_to(root / "subdir")
    (root / "subdir" / "loop").symlink_to(root)
    (root / "dangling").symlink_to(root / "nowhere")
    plain, errors = scan.scan_inventory(spark, [str(root)])
    assert {"link", "dangling", "subdir/loop"} <= _files(plain) and errors.isEmpty()
    followed, errors = scan.scan_inventory(spark, [str(root)], follow_symlinks=True)
    assert "link/nested.txt" in _files(followed)
    assert errors.where(F.col("message").contains("link loop")).count() > 0
    with pytest.raises(FileNotFoundError):
        scan.scan_inventory(spark, [str(root / "missing")])


def test_scan_unreadable_name(spark, tmp_path):
    (tmp_path / "r").mkdir()
    with open(os.fsencode(str(tmp_path / "r")) + b"/bad\xff", "wb") as f:
        f.write(b"1")
    row = scan.scan_inventory(spark, [str(tmp_path / "r")])[0].where("NOT is_dir").first()
    assert bytes(row.raw_path) == b"bad\xff" and row.path == "bad�"


def test_copy_verify_and_skip(spark, tree, tmp_path):
    root, files = tree
    target = tmp_path / "copy"
    plan = scan.scan_inventory(spark, [str(root)])[0].where("NOT is_dir")
    dry = copying.copy_files(plan, str(root), str(target), dry_run=True).collect()
    assert {r.status for r in dry} == {"planned"} and not target.exists()
    done = copying.copy_files(plan, str(root), str(target), hash_algorithm="sha256").collect()
    assert {r.path: r.hash for r in done} == {n: hashlib.sha256(d).hexdigest() for n, d in files.items() if n != ".hidden"}
    assert all((target / n).read_bytes() == d for n, d in files.items() if n != ".hidden")
    assert not list(target.rglob("*.part-*"))
    again = copying.copy_files(plan, str(root), str(target), incremental=True)
    assert transfers.copy_summary(again).first().files_skipped == 6
    assert transfers.copy_summary(again, legacy_counts=True).first().files_copied == 6
    os.remove(root / "small.txt")
    rows = copying.copy_files(plan, str(root), str(tmp_path / "other")).where("status = 'failed'").collect()
    assert [(r.path, "FileNotFoundError" in r.error) for r in rows] == [("small.txt", True)]
    with pytest.raises(Exception, match="FileNotFoundError"):
        copying.copy_files(plan, str(root), str(tmp_path / "third"), on_error="fail").collect()
    src = copying.hash_files(plan, str(target)).select("path", "hash")
    dst = copying.hash_files(plan, str(tmp_path / "other")).select("path", "hash")
    assert sync.verify_summary(sync.verify_trees(src, dst)).first().failed == 1


def test_copy_by_uri(spark, tree, tmp_path):
    root, files = tree
    plan = spark.createDataFrame([(n, len(d)) for n, d in files.items()] + [("gone", 1)], "path string, size long")
    target = f"file://{tmp_path}/uri"
    rows = {r.path: r for r in copying.copy_files(plan, f"file://{root}", target, hash_algorithm="sha256").collect()}
    assert rows.pop("gone").status == "failed"
    assert {p: r.hash for p, r in rows.items()} == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    assert all((tmp_path / "uri" / n).read_bytes() == d for n, d in files.items())
    assert not list((tmp_path / "uri").rglob("*.part-*"))
    again = copying.copy_files(plan.where("path <> 'gone'"), str(root), target, incremental=True).collect()
    assert {r.status for r in again} == {"skipped"}


def test_copy_attributes(spark, tree, tmp_path):
    root, _ = tree
    os.chmod(root / "small.txt", 0o640)
    os.utime(root / "small.txt", (1, 1_600_000_000))
    plan = spark.createDataFrame([("small.txt", 10)], "path string, size long")
    copying.copy_files(plan, str(root), str(tmp_path / "a")).collect()
    info = os.stat(tmp_path / "a" / "small.txt")
    assert (info.st_mode & 0o777, int(info.st_mtime)) == (0o640, 1_600_000_000)


def test_chunked_copy(spark, tmp_path):
    (tmp_path / "src").mkdir()
    data = os.urandom(1_000_003)
    (tmp_path / "src" / "huge").write_bytes(data)
    files = spark.createDataFrame([("huge", len(data))], "path string, size long")
    plan = transfer.chunk_plan(files, chunk=64 * 1024, minimum=100 * 1024)
    assert plan.count() == 16
    row = copying.chunk_completeness(copying.copy_chunks(plan, str(tmp_path / "src"), str(tmp_path / "dst"))).first()
    assert (row.complete, row.chunks, row.bytes) == (True, 16, len(data))
    assert (tmp_path / "dst" / "huge").read_bytes() == data
    blocks = scan.read_blocks(files, 100_000, str(tmp_path / "src")).orderBy("block_index").collect()
    assert b"".join(bytes(r.data) for r in blocks) == data


@pytest.mark.parametrize("fmt", ["tar", "tar-gz", "tar-zstd"])
def test_archives(spark, tree, tmp_path, fmt):
    root, files = tree
    rows = [(n, len(d), 0 if len(d) < 7 else 1) for n, d in files.items()] + [("gone", 3, 1), ("large", 9, None)]
    batches = spark.createDataFrame(rows, "path string, size long, batch long")
    out = archives.write_archives(batches, str(root), str(tmp_path / "a"), fmt, max_members=3).collect()
    assert sum(r.files for r in out) == len(files) and sum(r.missing for r in out) == 1
    assert max(r.files + r.missing for r in out) <= 3
    back = {r.path: bytes(r.content) for r in archives.read_archives(spark, str(tmp_path / "a")).collect()}
    assert back == files


def test_parquet_manifest_round_trip(spark, tmp_path):
    rows = [(f"f{i}", i * 1024, 1_700_000_000 + i, 123_456_789, 0o644, 1000, 1000, False, False, False, "file", None, "ab" * 16, None) for i in range(100)]
    from quayside import schemas

    df = spark.createDataFrame(rows, schemas.MANIFEST)
    manifests.write_manifest(df, str(tmp_path / "m"))
    back = manifests.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert manifests.manifest_count(spark, str(tmp_path / "m")).first()[0] == 100


def test_unsigned_manifest_columns(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"path": ["a"], "size": pa.array([2**40], pa.uint64()), "permissions": pa.array([420], pa.uint32())})
    pq.write_table(table, tmp_path / "m.parquet")
    row = manifests.read_manifest(spark, str(tmp_path / "m.parquet")).first()
    assert tuple(row) == ("a", 2**40, 420)


def test_json_manifest(spark, tmp_path):
    entry = {"path": "a", "size": 5, "mtime": 7, "hash": None, "hash_algorithm": None, "permissions": 420}
    doc = {"version": 1, "source_root": "/s", "dest_root": "/d", "created": 1, "updated": 2, "total_files": 1, "total_size": 5, "entries": [entry]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    header, rows = manifests.read_manifest_json(spark, str(tmp_path / "m.json"))
    assert header.first().total_size == 5 and rows.first().path == "a"
    for name, single in (("one", True), ("lines", False)):
        manifests.write_manifest_json(rows, str(tmp_path / name), "/s", "/d", 9, single_document=single)
        header, back = manifests.read_manifest_json(spark, str(tmp_path / name))
        assert tuple(header.select("total_files", "total_size", "updated").first()) == (1, 5, 9)
        assert [(r.path, r["size"], r.permissions) for r in back.collect()] == [("a", 5, 420)]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_json_manifest_of_any_size(spark, tmp_path, n):
    rows = spark.range(n).selectExpr("concat('f', id) path", "cast(null as binary) path_bytes", "id size", "id mtime", "cast(null as string) hash", "cast(null as string) hash_algorithm", "420 permissions")
    manifests.write_manifest_json(rows, str(tmp_path / "m"), "/s", "/d", 9)
    header, back = manifests.read_manifest_json(spark, str(tmp_path / "m"))
    assert header.first().total_files == n and back.count() == n and back.select("path").distinct().count() == n


def test_hash_manifest_document(spark, tmp_path):
    doc = {"algorithm": "xxhash3", "created": 1, "root": "/r", "entries": [{"path": "a", "size": 1, "hash": "ff", "algorithm": "xxhash3", "mtime": 2}]}
    (tmp_path / "h.json").write_text(json.dumps(doc))
    _, rows = manifests.read_hash_document(spark, str(tmp_path / "h.json"))
    assert manifests.find_entry(rows, "a").first().hash == "ff"
    assert manifests.find_entry(rows, "b").isEmpty()


def test_history_store_prunes_months(spark, tmp_path):
    rows = [(str(i), dt.datetime(2024, 1 + i % 4, 1 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, ended_at timestamp_ntz")
    manifests.append_history(df, str(tmp_path / "h"))
    manifests.append_history(df.limit(1), str(tmp_path / "h"))
    stored = manifests.read_history(spark, str(tmp_path / "h"))
    assert stored.count() == 21
    picked = manifests.ended_between(stored, "2024-02-01", "2024-02-10")
    assert {r.id for r in picked.collect()} == {str(i) for i in range(20) if i % 4 == 1 and 1 + i <= 10}
    assert "PartitionFilters: [isnotnull(ended_month" in picked._jdf.queryExecution().toString()


def test_states(spark, tmp_path):
    state = {"id": "t1", "source": "/s", "destination": "/d", "total_size": 3, "bytes_transferred": 1, "started_at": 1, "last_checkpoint": 2, "options_hash": 2**63 + 5, "status": "Interrupted", "files": {"a": {"relative_path": "a", "size": 3, "bytes_written": 1, "source_mtime": 0, "partial_checksum": None, "status": "Partial"}}}
    (tmp_path / "t1.json").write_text(json.dumps(state))
    (tmp_path / "bad.json").write_text('{"id": "x", "files": {')
    (tmp_path / "t2.tmp").write_text(json.dumps(state))
    rows = manifests.read_states(spark, str(tmp_path)).collect()
    assert [(r.transfer_id, r.path, r.file_status, r.bytes_written) for r in rows] == [("t1", "a", "Partial", 1)]
    log = manifests.read_states(spark, str(tmp_path))
    manifests.append_states(log, str(tmp_path / "log"))
    manifests.append_states(log.withColumn("last_checkpoint", F.lit(9).cast("long")).withColumn("bytes_written", F.lit(3).cast("long")), str(tmp_path / "log"))
    last = manifests.latest_states(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert [(r.last_checkpoint, r.bytes_written) for r in last] == [(9, 3)]


def test_balanced_pieces(spark):
    df = spark.createDataFrame([(f"f{i:03d}", 1000 if i else 50_000) for i in range(100)], "path string, size long")
    spread = copying.balance_by_bytes(df, 4, per_file=0)
    sums = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 100 and spread.rdd.getNumPartitions() == 4
    assert max(r.s for r in sums) <= 53_000


def test_python_batches_are_bounded_by_bytes(spark):
    """What a Python worker is given at a time does not grow with texts or tasks, and texts are hashed once."""
    from conftest import SF

    import __spark_entry__ as spark_entry

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))
    hashed = spark_entry.queries()["hash_xxhash64"](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    assert "EvalPython" not in hashed._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(64).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    seen = rows.select(F.col("text").cast("binary").alias("b")).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in it), "n long")
    assert seen.agg(F.max("n")).first()[0] <= 8


def test_weak_checksums_of_batches():
    import os

    from quayside.functions.hashing import weak_checksum_bytes, weak_checksums

    values = [os.urandom(n) for n in (0, 1, 3, 256, 5000, 70_000)] * 3
    for step in (7, 300, 1 << 20):
        assert weak_checksums(pa.array(values)[1:], step).tolist() == [weak_checksum_bytes(v) for v in values[1:]]


def test_files_are_written_from_the_batch_itself(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "é" * 1000), ("c", ""), ("a/d", "x")], "path string, content string")
    written = copying.write_files(df, str(tmp_path))
    assert "MapInArrow" in written._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, written.collect())) == [("a/b.txt", 2000), ("a/d", 1), ("c", 0)]
    assert (tmp_path / "a/b.txt").read_text() == "é" * 1000 and not list(tmp_path.glob("**/*.part-*"))


def test_blocks_are_read_by_slices(spark, tmp_path, monkeypatch):
    """A file is dealt out in slices of many blocks, not in a row per block."""
    from quayside.sources import scan

    monkeypatch.setattr(scan, "SLICE", 1000, raising=False)
    body = os.urandom(5003)
    (tmp_path / "f").write_bytes(body)
    blocks = scan.read_blocks(spark.createDataFrame([("f", 5003), ("none", 0)], "path string, size long"), 256, str(tmp_path))
    assert "Generate" in (plan := blocks._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" in plan
    found = blocks.orderBy("block_index").collect()
    assert [(r.block_index, r.offset, r.size) for r in found] == [(k, k * 256, min(256, 5003 - k * 256)) for k in range(20)]
    assert b"".join(bytes(r.data) for r in found) == body
