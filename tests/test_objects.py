"""Listings by tasks, contents read from them, and the stream of arrivals."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quayside.sources import objects, scan
from quayside.sources.stores import open_store, scheme_of
from quayside.streaming import live


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    files = {"a": b"1", ".x": b"22", "_y/.z/deep": b"333", "d/e.txt": b"", "d/_part-0.txt": b"4444"}
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "empty").mkdir()
    return root, {name: len(data) for name, data in files.items()}


def sizes(df):
    rows = df.collect()
    assert len({r.path for r in rows}) == len(rows)
    return {r.path: r["size"] for r in rows}


@pytest.mark.parametrize("wide", [20_000, 1])
@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_hidden_names_and_wide_directories(spark, tree, wide, scheme):
    root, files = tree
    found = objects.list_objects(spark, f"{scheme}{root}/", wide=wide)
    assert sizes(found) == files
    assert {r.root for r in found.collect()} == {f"{scheme}{root}"} and not any(r.is_dir for r in found.collect())
    times = {r.path: r.us for r in found.select("path", F.unix_micros("mtime").alias("us")).collect()}
    assert all(times[name] == os.stat(root / name).st_mtime_ns // 1000 for name in files)


def test_links_odd_names_and_missing_prefix(spark, tree):
    root, files = tree
    (root / "d/up").symlink_to(root)  # would be a loop
    (root / "copy").symlink_to(root / "_y/.z/deep")
    (root / "lost").symlink_to(root / "nowhere")
    with open(os.fsencode(root) + b"/bad\xff", "wb") as f:
        f.write(b"77")
    assert sizes(objects.list_objects(spark, str(root))) == files | {"copy": 3, "lost": len(str(root / "nowhere")), "bad\ufffd": 2}
    with pytest.raises(Exception, match="No such file"):
        objects.list_objects(spark, str(root / "missing")).collect()


def test_store_listing_equals_mounted_listing(tree):
    """What tasks do with a store's client, here over the same files."""
    root, files = tree
    place, base = open_store(str(root))
    todo, found = [b""], {}
    while todo:
        for raw, size, time, is_dir, described in objects._stored(place, base, todo.pop()):
            assert described
            if is_dir:
                todo.append(raw)
            else:
                found[raw.decode()] = size
                assert time == os.stat(root / raw.decode()).st_mtime_ns // 1000
    assert found == files


def test_schemes():
    assert [scheme_of(x) for x in ("/a/b", "file:/a", "file:///a", "s3a://b/c", "s3://b", "abfss://c@d/e", "viewfs://x/y", "hdfs://n:8020/")] == [
        "file", "file", "file", "s3", "s3", "abfs", "viewfs", "hdfs"
    ]
    with pytest.raises(ValueError, match="cannot open"):
        open_store("viewfs://store/x")
    assert open_store("file:/a/b/")[1] == open_store("/a/b")[1] == "/a/b"


def test_content(spark, tree):
    root, files = tree
    found = {r.path: (r.length, bytes(r.content)) for r in scan.scan_content(spark, [str(root)]).collect()}
    assert found == {f"{root}/{name}": (n, (root / name).read_bytes()) for name, n in files.items()}
    some = scan.scan_content(spark, [f"{root}/d", f"{root}/_y"], "*.txt").collect()
    assert {r.path for r in some} == {f"{root}/d/e.txt", f"{root}/d/_part-0.txt"}


def test_arrivals_once_each(spark, tree, tmp_path):
    root, files = tree
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def arrived() -> list[tuple[str, int, int]]:
        live.write_batches(live.stream_inventory(spark, str(root), levels=1), table, checkpoint).awaitTermination()
        rows = spark.read.option("basePath", table).parquet(f"{table}/batch=*").collect()
        return sorted((r.path, r["size"], r.batch) for r in rows)

    first = arrived()
    assert first == sorted((name, n, 0) for name, n in files.items())
    assert arrived() == first  # restarted, and nothing new
    (root / "d/e.txt").write_bytes(b"changed")
    (tmp_path / "old").write_bytes(b"moved in")
    os.utime(tmp_path / "old", (1_000_000_000, 1_000_000_000))  # much older than the first batch
    os.replace(tmp_path / "old", root / "empty/.old")
    (root / "new").mkdir()
    (root / "new/_f").write_bytes(b"1")
    second = [r for r in arrived() if r not in first]
    assert [r[:2] for r in second] == [("d/e.txt", 7), ("empty/.old", 8), ("new/_f", 1)]
    state = live.current_manifest(spark.read.option("basePath", table).parquet(f"{table}/batch=*"))
    assert sizes(state) == files | {"d/e.txt": 7, "empty/.old": 8, "new/_f": 1}


def test_footers_and_ranges(spark, tmp_path):
    from quayside.sources import footers, manifests

    path = str(tmp_path / "m")
    rows = spark.range(0, 4000, 1, 4).selectExpr("lpad(cast(pmod(id * 7919, 4000) as string), 5, '0') AS path", "id AS size", "cast(null as string) AS hash")
    rows.repartitionByRange(4, "path").sortWithinPartitions("path").write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).option(
        "parquet.block.size.row.check.min", 10
    ).option("parquet.page.size.row.check.min", 10).parquet(path)
    known = footers.manifest_footers(spark, path)
    total = footers.footer_totals(known).first()
    assert (total.files, total.entries, total["first"], total["last"]) == (4, 4000, "00000", "03999") and total.row_groups >= 4
    hit = footers.matching_groups(known, "01500", "01520").collect()
    assert 0 < len(hit) < total.row_groups
    found = footers.entries_between(spark, path, "01500", "01520", known)
    assert sorted(r.path for r in found.collect()) == [f"{i:05d}" for i in range(1500, 1521)] and found.columns == ["path", "size", "hash"]
    assert [r["size"] for r in footers.find_path(spark, path, "00007", known).collect()] == [r["size"] for r in rows.where("path = '00007'").collect()]
    assert footers.find_path(spark, path, "x", known).collect() == []
    # a file without statistics is always opened
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"path": ["x"], "size": [1]}), f"{path}/plain.parquet", write_statistics=False)
    assert [(r.path, r["size"], r["hash"]) for r in footers.find_path(spark, path, "x").collect()] == [("x", 1, None)]
    empty = str(tmp_path / "empty")
    rows.where("size < 0").write.parquet(empty)
    assert manifests.manifest_count(spark, empty).first()[0] == 0 and footers.entries_between(spark, empty, "", "z").collect() == []


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    import tarfile

    from quayside.sources import archives

    root = tmp_path / "in"
    root.mkdir()
    files = {f"f{k:03d}": bytes([k]) * (k * 50) for k in range(120)} | {"é" * 90: b"long name", "empty": b""}
    for name, data in files.items():
        (root / name).write_bytes(data)
    os.link(root / "f100", root / "second")
    files["second"] = files["f100"]
    batches = spark.createDataFrame([(n, len(d), 0) for n, d in files.items()], "path string, size long, batch long")
    assert archives.write_archives(batches, str(root), str(tmp_path / "a")).first().files == len(files)
    index = archives.archive_members(spark, str(tmp_path / "a"))
    by_index = sorted((r.path, r.offset, r["size"]) for r in index.collect())
    read = archives.read_members(index, tasks=5).withColumn("task", F.spark_partition_id()).collect()
    assert {r.path: bytes(r.content) for r in read} == files and len(read) == len(files) and len({r.task for r in read}) == 5
    # an archive from elsewhere has no index; one that was replaced has an old one
    (tmp_path / "a/batch-00000000-0000.tar.index").unlink()
    assert sorted((r.path, r.offset, r["size"]) for r in archives.archive_members(spark, str(tmp_path / "a")).collect()) == by_index
    with tarfile.open(tmp_path / "a/batch-00000000-0000.tar", "w") as tar:
        tar.add(root / "f001", "one")
    (tmp_path / "a/batch-00000000-0000.tar.index").write_text('[1]\n["other", 512, 50]\n')
    assert {r.path: bytes(r.content) for r in archives.read_archives(spark, str(tmp_path / "a")).collect()} == {"one": files["f001"]}


def test_one_archive_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    import tarfile

    from quayside.sources import archives

    monkeypatch.setattr(archives, "SLICE", 700)
    monkeypatch.setattr(archives, "INDEX_SLICE", 100)  # shorter than the longest line
    root = tmp_path / "in"
    root.mkdir()
    files = {f"f{k:03d}": bytes([k]) * (k * 50) for k in range(60)} | {"é" * 90: b"long name", "empty": b"", "exact": b"x" * 1400}
    for name, data in files.items():
        (root / name).write_bytes(data)
    os.symlink("f001", root / "link")
    rows = [(n, 0, 0) for n in [*files, "link", "gone", "f007"]] + [("none", 0, 1)]
    batches = spark.createDataFrame(rows, "path string, size long, batch long")
    out = {r.archive: r for r in archives.write_archives(batches, str(root), str(tmp_path / "a")).collect()}
    one, two = out["batch-00000000-0000.tar"], out["batch-00000001-0000.tar"]
    assert (one.files, one.missing, one.bytes) == (len(files) + 2, 1, sum(map(len, files.values())) + len(files["f007"]) + len(files["f001"]))
    assert (two.files, two.missing, two.bytes) == (0, 1, 0) and len(os.listdir(tmp_path / "a")) == 4
    # byte for byte what one writer makes of the same files
    with tarfile.open(tmp_path / "plain.tar", "w") as tar:
        for name in sorted([*files, "link", "f007"]):
            tar.add(root / name, name)
    assert (tmp_path / "a/batch-00000000-0000.tar").read_bytes() == (tmp_path / "plain.tar").read_bytes()
    index = archives.archive_members(spark, str(tmp_path / "a")).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in index}) > 1 and len(index) == len(files) + 1
    back = archives.read_archives(spark, str(tmp_path / "a")).collect()
    assert {r.path: bytes(r.content) for r in back} == files and len(back) == len(files) + 1
