"""What the physical plans may and may not contain."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest
from conftest import SF

import __spark_entry__ as spark_entry

PACKAGE = Path(__file__).resolve().parent.parent / "quayside"


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "name",
    ["sync_plan", "manifest_diff", "apply_schedule", "next_change", "assign_mount", "system_status", "anomalies_overall", "object_sync_plan"],
)
def test_no_cross_join(spark, name):
    plan = _plan(spark_entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = _plan(spark_entry.queries()["category_summary"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_content_is_not_read_for_listings(spark, tmp_path):
    from quayside.sources.scan import list_objects

    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "a").chmod(0)
    df = list_objects(spark, str(tmp_path))
    assert "binaryFile" not in _plan(df) and "BinaryFile" not in _plan(df)
    assert [(r.path, r.size) for r in df.collect()] == [("a", 1)]


def test_filters_reach_the_scan(spark, tmp_path):
    from quayside.operators.filters import filter_size

    spark.range(10).selectExpr("cast(id as string) path", "id size").write.parquet(str(tmp_path / "inv"))
    plan = _plan(filter_size(spark.read.parquet(str(tmp_path / "inv")), 3, 5))
    assert "GreaterThanOrEqual(size,3)" in plan and "LessThanOrEqual(size,5)" in plan


def test_footer_count(spark, tmp_path):
    """A manifest is counted from its footers: no scan of its columns is planned."""
    from quayside.sources.manifests import manifest_count

    spark.range(1000).selectExpr("cast(id as string) path", "id size").write.parquet(str(tmp_path / "m"))
    df = manifest_count(spark, str(tmp_path / "m"))
    assert "FileScan" not in _plan(df) and "BatchScan" not in _plan(df) and df.first()[0] == 1000


def test_directory_sums_come_before_the_explode(spark):
    plan = _plan(spark_entry.queries()["dir_usage"](spark, SF))
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.index("Generate") < physical.rindex("HashAggregate")


def test_nothing_machine_local_or_unbounded():
    """No local checkpoints, no pandas collection of tables, no cross joins in the package."""
    for file in PACKAGE.rglob("*.py"):
        calls = {n.func.attr for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
        assert not calls & {"localCheckpoint", "toPandas", "crossJoin", "toLocalIterator", "cache"}, file


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from quayside.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)
