"""The manifest as a log of runs: any split of the changes gives the same state, and few files are read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators.manifest import newest_per_path, remove, upsert
from quayside.sources.manifest_log import ManifestLog, stream_manifest

SCHEMA = "path string, size long, mtime long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def folder(tmp_path, name="log"):
    return str(tmp_path / name)


def changes_of(seed: int, n: int = 60) -> list[tuple[str, str, int]]:
    rnd = random.Random(seed)
    return [(rnd.choice("uuug"), f"d/{rnd.randrange(12)}", k) for k in range(n)]


def expected(changes):
    state = {}
    for kind, path, k in changes:
        if kind == "u":
            state[path] = k
        else:
            state.pop(path, None)
    return sorted((p, k, k) for p, k in state.items())


@pytest.mark.parametrize("cut", [1, 7, 60])
def test_any_split_gives_the_same_state(spark, tmp_path, cut):
    changes = changes_of(3)
    log = ManifestLog.create(spark, folder(tmp_path), spark.createDataFrame([], SCHEMA).schema, buckets=2, fanout=3)
    sets = [changes[at : at + cut] for at in range(0, len(changes), cut)] if cut > 1 else [changes[:9]] + [[c] for c in changes[9:14]] + [changes[14:]]
    for part in sets:
        # within a set removals come first, so a set ends where a path is removed after a change
        while part:
            seen, n = set(), 0
            for kind, path, _ in part:
                if kind == "g" and path in seen:
                    break
                seen |= {path} if kind == "u" else set()
                n += 1
            now, part = part[:n], part[n:]
            log.apply(
                spark.createDataFrame([(p, k, k) for kind, p, k in now if kind == "u"], SCHEMA),
                spark.createDataFrame([(p,) for kind, p, _ in now if kind == "g"], "path string"),
                order=["mtime"],
            )
    assert rows_of(log.state()) == expected(changes)
    version = log.version()
    levels = max(r.level for r in version.runs) + 1
    assert len(version.runs) <= 2 * levels and 3 ** (levels - 1) <= version.next_set
    assert len(log.state().inputFiles()) <= 2 * len(version.runs)
    path = expected(changes)[0][0]
    assert rows_of(log.find(path)) == expected(changes)[:1] and rows_of(log.find("none")) == []
    assert len(log.find(path).inputFiles()) <= 2 * len(version.runs)
    assert "PartitionFilters: [isnotnull(bucket" in log.find(path)._jdf.queryExecution().toString()
    before = rows_of(log.state())
    assert log.vacuum() >= 0 and rows_of(log.state()) == before and log.vacuum() == 0


def test_versions_and_writers(spark, tmp_path):
    log = ManifestLog.create(spark, folder(tmp_path), spark.createDataFrame([], SCHEMA).schema, buckets=2)
    assert rows_of(log.state()) == []
    one, two = (spark.createDataFrame([("a", k, k)], SCHEMA) for k in (1, 2))
    assert log.apply(one, batch=0) and not log.apply(two, batch=0)  # a repeated micro-batch
    stale = log.version()
    assert log.apply(two, batch=1)
    assert rows_of(log.state()) == [("a", 2, 2)] and rows_of(log.state(1)) == [("a", 1, 1)]
    stale.number += 1
    with pytest.raises(Exception, match="exists"):
        log._commit(stale)  # another writer was first
    assert log.apply(gone=one) and rows_of(ManifestLog(spark, folder(tmp_path)).state()) == []
    with pytest.raises(FileNotFoundError):
        ManifestLog(spark, folder(tmp_path, "other")).version()


def test_stream_keeps_it_up_to_date(spark, tmp_path):
    log = ManifestLog.create(spark, folder(tmp_path), spark.createDataFrame([], SCHEMA).schema, buckets=2, fanout=2)
    for k, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 5, 2), ("a", 4, 1)], [("c", 9, 9)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream_manifest(stream, log, str(tmp_path / "cp"), ["mtime"]).awaitTermination()
    assert rows_of(log.state()) == [("a", 5, 2), ("b", 1, 1), ("c", 9, 9)] and log.version().batch == 2


def test_doubled_paths(spark):
    manifest = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA)
    changes = spark.createDataFrame([("a", 5, 7), ("a", 9, 3), ("c", 1, None), ("c", 2, None), ("d", None, 1)], SCHEMA)
    assert sorted(map(tuple, upsert(manifest, changes).collect()), key=repr) == sorted([("a", 5, 7), ("b", 1, 1), ("c", 2, None), ("d", None, 1)], key=repr)
    assert rows_of(newest_per_path(changes.where("path = 'a'"), ["size"])) == [("a", 9, 3)]


def test_a_join_by_path_keeps_the_partitions_of_the_session(spark):
    manifest = spark.createDataFrame([(f"p{k}", k, 1) for k in range(40)], SCHEMA)
    changes = spark.createDataFrame([(f"p{k % 50}", k, k) for k in range(30, 90)], SCHEMA)
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = upsert(manifest, changes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # the changes are reduced to a row per path once, not for the join as well, and the join's tasks are not put together
        assert plan.count("max(struct") == 2 and "REPARTITION_BY_NUM" in plan
        assert rows_of(found) == sorted((f"p{k % 50}", k, k) for k in range(40, 90))
        rest = remove(manifest, changes)
        assert "REPARTITION_BY_NUM" in rest._jdf.queryExecution().executedPlan().toString() and rows_of(rest) == []
        assert rows_of(remove(manifest, changes.where("path > 'p2'"))) == [("p0", 0, 1), ("p1", 1, 1), *[(f"p{k}", k, 1) for k in range(10, 20)], ("p2", 2, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    log = ManifestLog.create(spark, folder(tmp_path), spark.createDataFrame([], SCHEMA).schema, buckets=1, fanout=2)
    rows = spark.range(4000).selectExpr("concat('p', id % 3000) AS path", "id AS size", "id AS mtime")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log.apply(rows, order=["mtime"])
        log.apply(rows.where("mtime < 10"), rows.where("size >= 2990").select("path"), order=["mtime"])
        (run,) = log.version().runs
        found = spark.read.parquet(f"{log.path}/runs/{run.name}").groupBy(F.input_file_name()).agg(F.min("path").alias("low"), F.max("path").alias("high"))
        spans = sorted((r.low, r.high) for r in found.collect())
        assert len(spans) > 4  # one file of the bucket, and one task, before
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # ranges of paths that do not overlap
        assert rows_of(log.state()) == sorted([(f"p{k}", k, k) for k in range(10)] + [(f"p{k}", k, k) for k in range(1000, 2990)])  # p0 to p999 are rows 3000 to 3999, too, which went
        assert rows_of(log.find("p1500")) == [("p1500", 1500, 1500)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
