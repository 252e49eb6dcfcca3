"""Small literal cases: sync, manifests, sizes, texts, history, schedules, deltas."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from quayside.functions import accounting, hashing, paths, rates, security, sizes
from quayside.operators import content, delta, filters, history, inventory, manifest, transfers
from quayside.plans import bandwidth, sync, transfer

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
INVENTORY = "path string, size long, mtime timestamp"


def _inv(spark, *rows):
    return spark.createDataFrame([(p, s, m) for p, s, m in rows], INVENTORY)


def _actions(plan):
    return {r.path: (r.action, r["size"]) for r in plan.collect()}


def test_sync_empty_destination(spark):
    plan = sync.sync_plan(_inv(spark, ("a", 1, T0), ("b", 2, T0)), _inv(spark), delete_extra=True)
    assert _actions(plan) == {"a": ("CopyNew", 1), "b": ("CopyNew", 2)}


def test_sync_identical_and_needs_sync(spark):
    inv = _inv(spark, ("a", 1, T0), ("b", 2, T0))
    plan = sync.sync_plan(inv, inv, delete_extra=True)
    assert set(_actions(plan).values()) == {("Skip", 0)}
    assert not sync.needs_sync(plan)


def test_sync_extra_and_conflict(spark):
    src = _inv(spark, ("keep", 1, T0), ("old", 1, T0), ("big", 5, T0))
    dst = _inv(spark, ("keep", 1, T0), ("old", 1, T1), ("big", 9, T1), ("extra", 7, T0))
    assert _actions(sync.sync_plan(src, dst, delete_extra=True)) == {
        "keep": ("Skip", 0), "old": ("Conflict", 0), "big": ("Update", 5), "extra": ("Delete", 7),
    }
    assert "extra" not in _actions(sync.sync_plan(src, dst))
    assert _actions(sync.sync_plan(src, dst, ignore_times=True))["old"] == ("Skip", 0)


def test_sync_microseconds_count(spark):
    late = T0 + dt.timedelta(microseconds=1)
    assert _actions(sync.sync_plan(_inv(spark, ("a", 1, late)), _inv(spark, ("a", 1, T0))))["a"][0] == "Update"
    known = manifest.manifest_from_scan(_inv(spark, ("a", 1, T0)))
    assert _actions(sync.manifest_plan(_inv(spark, ("a", 1, late)), known))["a"][0] == "Skip"


def test_diff_is_antisymmetric(spark):
    a = _inv(spark, ("x", 1, T0), ("y", 2, T0), ("z", 3, T0))
    b = _inv(spark, ("y", 2, T0), ("z", 4, T0), ("w", 5, T0))
    swap = {"added": "deleted", "deleted": "added", "modified": "modified", "unchanged": "unchanged"}
    there = {r.path: r.state for r in sync.manifest_diff(a, manifest.manifest_from_scan(b)).collect()}
    back = {r.path: r.state for r in sync.manifest_diff(b, manifest.manifest_from_scan(a)).collect()}
    assert {p: swap[s] for p, s in there.items()} == back


def test_manifest_upsert_and_remove(spark):
    one = spark.createDataFrame([("file.txt", 100, 5)], "path string, size long, mtime long")
    two = one.withColumn("size", F.lit(200).cast("long"))
    up = manifest.upsert(one, two)
    assert tuple(manifest.manifest_totals(up).first()) == (1, 200)
    assert tuple(manifest.manifest_totals(manifest.remove(up, one)).first()) == (0, 0)


def test_hex_of_unreadable_path(spark):
    raw = b"a\xff"
    df = spark.createDataFrame([("a�", raw, 1, T0), ("b", None, 1, T0)], "path string, raw_path binary, size long, mtime timestamp")
    assert {r.path: r.path_bytes for r in manifest.manifest_from_scan(df).collect()} == {"a�": "61ff", "b": None}


GLOBS = [
    ("*.bin", "a/b.bin", True), ("*.bin", "b.bin.txt", False), ("?.txt", "/.txt", True), ("a?c", "abc", True),
    ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[!a-c]x", "dx", True), ("{foo,bar*}.md", "barn.md", True),
    ("{foo,bar*}.md", "baz.md", False), ("**/x", "x", True), ("**/x", "a/b/x", True), ("**/x", "ax", False),
    ("src/**", "src/a/b", True), ("src/**", "src", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
    ("a/**/b", "ab", False), ("\\*", "*", True), ("\\*", "x", False), ("a.c", "abc", False), ("[]]", "]", True),
    ("x[\\]", "x\\", True), ("a\nb*", "a\nbc", True),
]


def test_globs(spark):
    df = spark.range(1).select(*[F.lit(p).rlike(paths.glob_to_regex(g)).alias(f"c{i}") for i, (g, p, _) in enumerate(GLOBS)])
    assert list(df.first()) == [w for _, _, w in GLOBS]
    for bad in ("[a", "{a,b"):
        with pytest.raises(ValueError):
            paths.glob_to_regex(bad)


def test_hidden_depth_extension(spark):
    names = [".git/config", ".hidden", "a.tar.gz", ".bashrc", ".a.txt", "dir.d/none", "end.", "a/b/c"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path for r in filters.filter_hidden(df).collect()} == {".git/config", "a.tar.gz", "dir.d/none", "end.", "a/b/c"}
    assert {r.path: r.e for r in df.select("path", paths.extension("path").alias("e")).collect()} == {
        ".git/config": None, ".hidden": None, "a.tar.gz": "gz", ".bashrc": None, ".a.txt": "txt", "dir.d/none": None, "end.": "", "a/b/c": None,
    }
    assert {r.path for r in filters.filter_depth(df, 2).collect()} == set(names) - {"a/b/c"}


def test_size_categories(spark):
    values = [100, 4095, 4096, 100_000, 10_000_000, 500_000_000, 2_000_000_000]
    df = spark.createDataFrame([(v,) for v in values], "size long")
    got = [r.c for r in df.select(sizes.size_category("size").alias("c")).collect()]
    assert got == ["tiny", "tiny", "small", "small", "medium", "large", "huge"]


def test_parse_texts(spark):
    texts = {"1024": 1024, "1K": 1024, "1KB": 1024, "1M": 2**20, "1G": 2**30, "1.5G": 3 * 2**29, " 2 tb ": 2**41, "7b": 7, "": None, "x": None, "1Q": None, "-1K": 0, "1e3": 1000, ".5K": 512, "1 K B": None, "9E99": 2**63 - 1}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", sizes.parse_size("t").alias("v")).collect()} == texts
    rates_ = {"100M": 104_857_600, "1G": 1_073_741_824, "500K": 512_000, "1024": 1024, "1GGB": 2**30, "10B": None, "1T": None, "0": 0}
    df = spark.createDataFrame([(t,) for t in rates_], "t string")
    assert {r.t: r.v for r in df.select("t", sizes.parse_bandwidth("t").alias("v")).collect()} == rates_
    assert df.where("t = '0'").select(sizes.parse_bandwidth("t", positive_only=True)).first()[0] is None


def test_uris(spark):
    df = spark.createDataFrame([("s3://my-bucket/path/to/file",), ("s3://bucket",), ("/local/path",), ("user@host:/path/to/file",), ("host:/a@b",)], "u string")
    o = [r.o and tuple(r.o) for r in df.select(paths.split_object_url("u").alias("o")).collect()]
    r = [r.r and tuple(r.r) for r in df.select(paths.split_remote_path("u").alias("r")).collect()]
    assert o == [("my-bucket", "path/to/file"), ("bucket", ""), None, None, None]
    assert r == [None, None, None, ("user", "host", "/path/to/file"), None]


def test_accounting(spark):
    df = spark.createDataFrame(
        [("4G", "1-01:01:01", "node[01-04]"), ("512M", "02:30", "node1, node2,node3"), ("1024K", "45", "n[9-11]"), ("1.5G", "x-01:00:00", "n[4-2]"), (" 77 ", "1:2:3:4", "n[a-b]")],
        "memory string, time_limit string, node_list string",
    )
    rows = accounting.normalize_jobs(df).collect()
    assert [r.memory_bytes for r in rows] == [4 * 2**30, 512 * 2**20, 2**20, None, 77]
    assert [r.time_limit_seconds for r in rows] == [90061, 9000, None, 3600, None]
    assert [r.time_limit_text for r in rows] == ["1-01:01:01", "02:30:00", None, "01:00:00", None]
    assert rows[0].hours_text == "25:01:01"
    assert [r.nodes for r in rows] == [["node01", "node02", "node03", "node04"], ["node1", "node2", "node3"], ["n9", "n10", "n11"], [], []]


def test_acl_and_mode(spark):
    masks = {0x001F01FF: ["Full Control"], 1: ["Read"], 0x40000020: ["Write", "Execute"], 0x80010000: ["Read", "Delete"], 0x000C0000: ["Change Permissions", "Take Ownership"], 0: []}
    df = spark.createDataFrame([(m,) for m in masks], "m long")
    assert {r.m: r.d for r in df.select("m", security.describe_mask("m").alias("d")).collect()} == masks
    row = security.decode_mode(spark.createDataFrame([(0o104752,)], "permissions int")).first()
    assert (row.setuid, row.setgid, row.sticky, row.rwx, row.world_writable) == (True, False, False, "rwxr-x-w-", True)


def test_retry_delays(spark):
    row = spark.range(1).select(rates.object_retry_delay(F.lit(3)), rates.object_retry_delay(F.lit(9)), rates.sync_retry_delay(F.lit(2))).first()
    assert tuple(row) == (8.0, 64.0, 0.4)


def _history(spark, values, **over):
    rows = [(str(i), "s", "d", T0 + dt.timedelta(days=i), float(v), 10, 10, 0, 1000, 1.0, 10.0, "success", 8, True) for i, v in enumerate(values)]
    schema = "id string, source string, destination string, started_at timestamp_ntz, avg_throughput double, total_files long, files_transferred long, files_failed long, bytes_transferred long, files_per_second double, duration_seconds double, status string, threads long, verify boolean"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ended_at", F.col("started_at")).withColumns({k: v for k, v in over.items()})


def test_metric_comparison(spark):
    entries = inventory.pick(_history(spark, [100, 120, 110, 130, 150]), ["0", "1", "2", "3", "4"])
    row = history.compare(entries).where("metric = 'throughput'").first()
    assert (row["min"], row["max"], row.avg, row.percent_change) == (100, 150, 122, 50)
    assert row["values"] == [100, 120, 110, 130, 150]
    assert row.stddev == pytest.approx(17.204650534085253)
    back = inventory.pick(_history(spark, [100, 120]), ["1", "nope", "0"])
    assert history.compare(back).where("metric = 'throughput'").first()["values"] == [120, 100]
    with pytest.raises(ValueError):
        history.compare(inventory.pick(_history(spark, [100, 120]), ["1", "nope"]))


def test_trends(spark):
    up = history.trend(_history(spark, [100, 110, 120, 130, 140])).first()
    assert (up.direction, up.prediction, up.slope) == ("improving", pytest.approx(150), pytest.approx(10))
    assert up.confidence == pytest.approx(1)
    assert history.trend(_history(spark, [140, 130, 120, 110, 100])).first().direction == "degrading"
    flat = history.trend(_history(spark, [5, 5, 5])).first()
    assert (flat.direction, flat.confidence, flat.strength) == ("stable", 0.0, 0.0)
    one = history.trend(_history(spark, [5])).first()
    assert (one.direction, one.prediction) == ("stable", None)


def test_anomalies_need_three_entries(spark):
    two = _history(spark, [1, 100], files_failed=F.lit(9))
    assert history.detect_anomalies(two).count() == 0
    many = _history(spark, [100] * 20 + [1], files_failed=F.when(F.col("id") == "3", 1).otherwise(0))
    found = {r.entry_id: r for r in history.detect_anomalies(many).collect()}
    assert found["20"].anomaly_type == "throughput_drop" and "deviations below the mean" in found["20"].description
    assert found["3"].description == "1 of 10 files failed, 10.0 percent"
    assert set(found) == {"20", "3"}


def test_stats_periods(spark):
    df = _history(spark, [10, 20, 30], status=F.when(F.col("id") == "1", "partialsuccess").otherwise("success"))
    rows = history.aggregate_stats(df, [1, 7], T0 + dt.timedelta(days=2)).collect()
    # the entry that ended exactly one day before is out
    assert [(r.period_days, r.total_jobs, r.failed_jobs) for r in rows] == [(1, 1, 0), (7, 3, 1)]


def test_recommendation_rules(spark):
    df = _history(spark, [100, 100, 100, 100], verify=F.lit(False), bytes_transferred=F.lit(20_000_000_000), threads=F.lit(2).cast("long"))
    got = {r.recommendation for r in history.recommendations(df).collect()}
    assert got == {history.ADVICE[k] for k in ("slow", "unverified", "threads")}


def test_schedule(spark):
    plan = bandwidth.business_hours(100, 5)
    at = [dt.datetime(2024, 1, 1, 9, 0), dt.datetime(2024, 1, 1, 18, 0), dt.datetime(2024, 1, 6, 10, 0), dt.datetime(2024, 1, 6, 23, 0), dt.datetime(2024, 1, 7, 5, 59), dt.datetime(2024, 1, 7, 6, 0)]
    df = spark.createDataFrame([(t,) for t in at], "ts timestamp")
    assert [(r.rule, r.limit) for r in bandwidth.apply_schedule(df, plan).collect()] == [
        ("Business hours", 100), (None, 100), (None, 100), ("Night hours", 5), ("Night hours", 5), (None, 100),
    ]
    assert [r.next_change_seconds for r in bandwidth.next_change(df, plan).collect()] == [540 * 60, 240 * 60, 480 * 60, 420 * 60, 60, 180 * 60]
    weekend = bandwidth.weekend_full_speed(7)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 23, 58),), (dt.datetime(2024, 1, 6, 23, 59),)], "ts timestamp")
    assert [r.limit for r in bandwidth.apply_schedule(df, weekend).collect()] == [0, 7]
    off = bandwidth.Schedule(plan.rules, 100, enabled=False)
    assert {r.limit for r in bandwidth.apply_schedule(df, off).collect()} == {0}
    added = plan.with_rule(bandwidth.Rule("First", 0, 1439, 1, None, 99))
    assert [r.name for r in added.rules] == ["First", "Business hours", "Night hours"]


def test_schedule_file(spark, tmp_path):
    doc = tmp_path / "s.json"
    doc.write_text('{"rules": [{"name": "r", "days": ["Monday"], "start_time": {"hour": 1, "minute": 2}, "end_time": {"hour": 3, "minute": 0}, "limit": 9, "priority": 1}], "default_limit": 4, "enabled": true}')
    assert bandwidth.read_schedule(spark, str(doc)) == bandwidth.Schedule((bandwidth.Rule("r", 62, 180, 9, ("Monday",), 1),), 4, True)


def test_latest_state(spark):
    log = [(1, 1, "running"), (1, 2, "cancelled"), (2, 1, "completed"), (2, 2, "cancelled"), (3, 1, "cancelled"), (4, 1, "running"), (4, 2, "cancelled"), (4, 3, "running"), (5, 1, "paused"), (5, 2, "cancelled")]
    df = spark.createDataFrame(log, "job int, at int, state string")
    got = {r.job: r.state for r in transfers.latest_state(df, "job", ["at"]).collect()}
    assert got == {1: "cancelled", 2: "completed", 3: "cancelled", 4: "running", 5: "paused"}


def test_resume_summary(spark):
    df = spark.createDataFrame([("t", "interrupted", "partial", 1000, 500)], "transfer_id string, status string, file_status string, size long, bytes_written long")
    row = transfers.resume_summary(df).first()
    assert (row.resumable, row.bytes_skipped, row.bytes_remaining, row.files_remaining) == (True, 500, 500, 1)


def test_task_stats(spark):
    df = spark.createDataFrame([("completed", 1)] * 50 + [("running", 1)] * 50, "status string, size long")
    row = transfers.task_stats(df).first()
    assert (row.submitted, row.completion_percent, row.is_complete) == (100, 50.0, False)


def test_system_status_degrades(spark):
    jobs = spark.createDataFrame([("running", 5, 1)], "status string, bytes_transferred long, files_transferred long")
    none = spark.createDataFrame([], "status string")
    some = spark.createDataFrame([("busy",)], "status string")
    assert transfers.system_status(jobs, none).first().health == "degraded"
    assert transfers.system_status(jobs, some).first().health == "healthy"
    text = "\n".join(r.value for r in transfers.metrics_text(transfers.metrics_table(jobs, some, "x")).collect())
    assert "# TYPE x_jobs_active gauge\nx_jobs_active 1" in text


def test_weak_checksum(spark):
    assert hashing.weak_checksum_bytes(b"Hello, World!") == 529597545
    a = b = 0
    data = bytes(range(256)) * 300
    for byte in data:
        a = (a + byte) & 0xFFFFFFFF
        b = (b + a) & 0xFFFFFFFF
    assert hashing.weak_checksum_bytes(data) == ((b << 16) & 0xFFFFFFFF) | (a & 0xFFFF)
    rolled = content.rolling_weak(data[:2000], 37)
    assert [int(w) for w in rolled] == [hashing.weak_checksum_bytes(data[i : i + 37]) for i in range(2000 - 37 + 1)]


def test_hashes(spark):
    import xxhash

    df = spark.createDataFrame([(b"Hello, World!",), (b"",), (None,)], "content binary")
    got = lambda algo: [r.hash for r in hashing.hash_content(df, "content", algo).collect()]
    assert got("sha256")[:2] == [hashlib.sha256(b"Hello, World!").hexdigest(), hashlib.sha256(b"").hexdigest()]
    assert got("xxh3_128") == [xxhash.xxh3_128_hexdigest(b"Hello, World!"), xxhash.xxh3_128_hexdigest(b""), None]
    assert got("xxhash64")[0] == xxhash.xxh64_hexdigest(b"Hello, World!", seed=0)
    hashing.register_hash("md5", lambda data: hashlib.md5(data).hexdigest())
    assert got("md5")[0] == hashlib.md5(b"Hello, World!").hexdigest()
    with pytest.raises(ValueError):
        hashing.content_hash("content", "nope")


def test_signature_of_repeated_bytes(spark):
    df = spark.createDataFrame([("f", bytes([0xAB]) * (5 << 20))], "path string, content binary")
    sigs = content.signatures(content.split_blocks(df, "content", 1 << 20), "xxh3_64")
    assert tuple(content.signature_summary(sigs).first()) == ("f", 5 << 20, 5)
    assert sigs.select("weak", "strong").distinct().count() == 1


def _delta(spark, old: bytes, new: bytes, block: int):
    frame = lambda data: content.split_blocks(spark.createDataFrame([("f", data)], "path string, content binary"), "content", block)
    base, target = frame(old), frame(new)
    matches = delta.match_chunks(content.signatures(target), content.signatures(base))
    ops = delta.delta_ops(matches, block)
    applied = delta.apply_delta(base, ops, delta.literal_blocks(target, matches), block)
    return matches, ops, applied


def test_delta_savings_and_round_trip(spark):
    old = bytes([0xAB]) * (3 << 20)
    new = bytes([0xCD]) * 1000 + old[1000:]
    matches, _, _ = _delta(spark, old, old, 1 << 20)
    assert delta.delta_summary(matches).first().savings_percent > 95
    assert [r.source_index for r in matches.collect()] == [0, 0, 0]
    matches, ops, applied = _delta(spark, old, new, 1 << 20)
    assert 50 < delta.delta_summary(matches).first().savings_percent < 70
    assert bytes(delta.assemble(applied).first().content) == new
    assert sorted((r.op, r.dest_offset, r["size"]) for r in ops.collect())[-1] == ("insert", 0, 1 << 20)


@pytest.mark.parametrize("letter", ["é", "漢", "😀"])
def test_blocks_cut_through_letters(spark, letter):
    """Characters of two, three and four bytes across block borders; an empty file beside them."""
    text = "a" + letter * 50
    df = spark.createDataFrame([("f", text), ("empty", "")], "path string, text string")
    blocks = content.split_blocks(df, "text", 16, keep=["path"])
    rows = sorted((r.block_index, bytes(r.data)) for r in blocks.collect())
    assert b"".join(d for _, d in rows) == text.encode() and {len(d) for _, d in rows[:-1]} == {16}
    sums = {r.path: (r.file_size, r.num_chunks) for r in content.signature_summary(content.signatures(blocks), files=df).collect()}
    assert sums == {"f": (len(text.encode()), len(rows)), "empty": (0, 0)}
    whole = {r.path: bytes(r.content) for r in delta.assemble(blocks, "offset", files=df).collect()}
    assert whole == {"f": text.encode(), "empty": b""}


def test_long_literals_are_cut(spark):
    matches, _, _ = _delta(spark, b"", bytes(range(250)) * 4, 100)
    whole = delta.delta_ops(matches, 100).collect()
    assert [(r.op, r.dest_offset, r["size"]) for r in whole] == [("insert", 0, 1000)]
    cut = sorted((r.dest_offset, r["size"], r.n_blocks) for r in delta.delta_ops(matches, 100, max_literal_blocks=3).collect())
    assert cut == [(0, 300, 3), (300, 300, 3), (600, 300, 3), (900, 100, 1)]


def test_shifted_blocks_are_found(spark):
    import random

    old = random.Random(1).randbytes(4000)
    new = b"inserted" + old
    frame = lambda data: spark.createDataFrame([("f", data)], "path string, content binary")
    base = content.signatures(content.split_blocks(frame(old), "content", 256))
    found = {(r.offset, r.source_index) for r in content.shifted_matches(frame(new), base, 256).collect()}
    assert found == {(8 + i * 256, i) for i in range(4000 // 256)}


def test_composite_hash(spark):
    values = [(-1 << 63) + i * 0x123456789ABCDEF for i in range(130)]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "path string, block_index long, h long")
    want = 0
    for i, v in enumerate(values):
        u, r = v & (2**64 - 1), i % 64
        want ^= ((u << r) | (u >> (64 - r))) & (2**64 - 1)
    assert delta.composite_hash(df, value="h").first().composite & (2**64 - 1) == want


def test_holes_of_binary_blocks(spark):
    data = bytes(8192) + b"x" * 4096 + bytes(4096) + b"y" + bytes(4095) + bytes(6000)
    blocks = content.split_blocks(spark.createDataFrame([("f", data)], "path string, content binary"), "content", 4096)
    assert sorted((r.offset, r.length) for r in content.find_holes(blocks, ["path"], 4096, 4096).collect()) == [(0, 8192), (12288, 4096), (20480, 6000)]
    row = content.sparse_summary(blocks, ["path"], 4096).first()
    assert (row.holes, row.space_saved, row.logical_size) == (3, 18288, len(data))


def test_encryption(spark):
    df = spark.createDataFrame([("a", b"secret"), ("b", b"")], "path string, content binary")
    key = F.lit(b"0123456789abcdef")
    sealed = content.encrypt_content(df, key)
    assert content.find_encrypted(sealed).count() == 2 and content.find_encrypted(df).count() == 0
    assert {bytes(r.content) for r in content.decrypt_content(sealed, key).collect()} == {b"secret", b""}
    assert content.decrypt_content(df, key).where("content IS NOT NULL").count() == 0
    wrong = content.decrypt_content(sealed, F.lit(b"fedcba9876543210"))
    assert wrong.where("content IS NOT NULL").count() == 0


def test_mounts(spark):
    files = spark.createDataFrame([("/data/x", 5), ("/database/y", 7), ("/data/deep/z", 1), ("other", 2)], "path string, size long")
    mounts = spark.createDataFrame([("/data", 10), ("/data/deep", 0), ("/", 100)], "mount_point string, available long")
    want = {"/data/x": "/data", "/database/y": "/data", "/data/deep/z": "/data/deep", "other": None}
    assert {r.path: r.mount for r in transfer.assign_mount(files, mounts).collect()} == want
    space = {r.mount: (r.required, r.fits) for r in transfer.check_space(files, mounts).collect()}
    assert space == {"/data": (12, False), "/data/deep": (1, False), None: (2, False)}
    assert transfer.assign_mount(files, mounts).columns == ["path", "size", "mount"]
    many = mounts.union(spark.range(300).selectExpr("concat('/none/', id)", "id"))
    assert {r.path: r.mount for r in transfer.assign_mount(files, many).collect()} == want
    assert transfer.assign_mount(files, mounts.where("false")).where("mount IS NULL").count() == 4


def test_pagination(spark):
    rows, head = inventory.paginate(spark.range(45), ["id"], page=3, per_page=20)
    assert [r.id for r in rows.collect()] == [40, 41, 42, 43, 44]
    assert head == {"total": 45, "page": 3, "per_page": 20, "total_pages": 3}


def test_paths_as_a_set(spark):
    rows = [(f"/data/project/module{i % 100}/file{i}.dat",) for i in range(10_000)]
    df = spark.createDataFrame(rows + rows[:10], "path string")
    assert tuple(inventory.path_stats(df).first()) == (10_010, 10_000, 10)
    approx = inventory.path_stats(df, approximate=True).first()
    assert abs(approx.distinct_paths - 10_000) < 300
    mixed = spark.createDataFrame([("b",), ("B",), ("é",), ("a/b",), ("a",)], "path string")
    assert [r.path for r in inventory.sorted_paths(mixed).collect()] == ["B", "a", "a/b", "b", "é"]


def test_order_none_keeps_rows(spark):
    df = _inv(spark, ("b", 2, T0), ("a", 2, T1), ("c", 1, T0))
    assert inventory.order_files(df, "none") is df
    assert [r.path for r in inventory.order_files(df, "largest").collect()] == ["a", "b", "c"]
    assert [r.path for r in inventory.order_files(df, "oldest").collect()] == ["b", "c", "a"]
