"""Chains of operators end to end."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from test_literals import _history

from quayside import flows
from quayside.operators import content, delta, history, inventory
from quayside.plans import sync
from quayside.sources import manifests


def test_copy_and_verify_a_tree(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    (src / "sub").mkdir(parents=True)
    for i in range(20):
        (src / "sub" / f"f{i}").write_bytes(os.urandom(100 * i))
    run = flows.copy_tree(spark, str(src), str(dst), verify="sha256")
    assert run.summary.first().files_copied == 20 and run.scan_errors.isEmpty()
    assert sync.verify_summary(run.verification).first().asDict() == {"verified": 20, "passed": 20, "failed": 0}
    assert flows.verify_directories(spark, str(src), str(dst)).isEmpty()
    again = flows.copy_tree(spark, str(src), str(dst), incremental=True)
    assert again.summary.first().files_skipped == 20
    (dst / "sub" / "f3").write_bytes(b"x" * 300)
    os.utime(dst / "sub" / "f3", ns=(0, os.stat(src / "sub" / "f3").st_mtime_ns))
    (dst / "extra").write_bytes(b"1")
    by_time = {r.path: r.difference for r in flows.verify_directories(spark, str(src), str(dst)).collect()}
    by_hash = {r.path: r.difference for r in flows.verify_directories(spark, str(src), str(dst), "xxh3_128").collect()}
    assert by_time == {"extra": "Delete"}
    assert by_hash == {"extra": "missing_source", "sub/f3": "mismatch"}


def test_dry_run_creates_nothing(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a").write_bytes(b"12")
    run = flows.copy_tree(spark, str(tmp_path / "src"), str(tmp_path / "dst"), dry_run=True)
    assert [(r.status, r.bytes) for r in run.results.collect()] == [("planned", 2)]
    assert not (tmp_path / "dst").exists()


def test_compare_transfers(spark):
    entries = _history(spark, [100, 200, 300, 400])
    got = flows.compare_transfers(entries, ["3", "2", "1", "0"])
    assert [r.id for r in got.entries.orderBy("position").collect()] == ["3", "2", "1", "0"]
    assert got.trend.first().direction == "degrading"
    assert history.ADVICE["degrading"] in {r.recommendation for r in got.recommendations.collect()}
    assert got.anomalies.isEmpty()
    assert got.metrics.where("metric = 'throughput'").first().percent_change == -75


def test_delta_transfer(spark):
    frame = lambda data: spark.createDataFrame([("f", data)], "path string, content binary")
    old, new = bytes(range(256)) * 40, bytes(range(256)) * 20 + b"new" + bytes(range(253)) + bytes(range(256)) * 30
    ops, literals, summary = flows.delta_transfer(frame(old), frame(new), 256)
    base = content.split_blocks(frame(old), "content", 256)
    assert bytes(delta.assemble(delta.apply_delta(base, ops, literals, 256)).first().content) == new
    assert summary.first().transfer_size == 256


def test_bucketed_tables_plan_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("a", "b"):
            df = spark.range(100).select(F.col("id").cast("string").alias("path"), F.col("id").alias("size"), F.timestamp_seconds("id").alias("mtime"))
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")
            manifests.save_inventory_table(df, f"bucketed_{name}", 8)
        plan = sync.sync_plan(spark.table("bucketed_a"), spark.table("bucketed_b"), delete_extra=True)
        assert plan.where("action = 'Skip'").count() == 100
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("a", "b"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_pages_equal_sorted_rows(spark):
    df = spark.createDataFrame([(i, i * 7 % 50) for i in range(200)], "id long, v long")
    order = [F.desc("v"), F.col("id")]
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    for page in (1, 4, 7):
        assert [tuple(r) for r in inventory.paginate(df, order, page, 30)[0].collect()] == whole[30 * page - 30 : 30 * page]
