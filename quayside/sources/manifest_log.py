"""A manifest that takes steady upserts: sorted runs in levels, merged as levels fill.

Every change set is written as a run: buckets of paths, sorted by path and cut into ranges of paths where a bucket is large, with a number that grows from set to set. Deleted
paths are rows of their own kind (tombstones). When a level has ``fanout`` runs they are merged into one run of the next level,
newest row per path; a merge that reaches the oldest run drops the tombstones. So a path is rewritten once per level, there
are at most ``(fanout - 1) * levels`` runs, and levels grow with the logarithm of the number of change sets. A task writes one range of
(bucket, path), whose size adaptive execution bounds, so it does not grow with the manifest; small runs have one file per bucket.

Which runs make up the manifest is said by numbered version files. A version file can be created once only, so of two writers one fails and
repeats, and a reader that has opened a version keeps it; files that no version needs any more are deleted by :meth:`vacuum`.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quayside.operators.manifest import dealt_by_path, newest_per_path


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    first: int
    last: int


@dataclass
class Version:
    number: int
    buckets: int
    fanout: int
    schema: str
    next_set: int = 0
    batch: int = -1
    runs: list[Run] = field(default_factory=list)


class ManifestLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, buckets: int = 32, fanout: int = 4) -> ManifestLog:
        """An empty manifest of rows with a ``path`` column. ``buckets`` and ``fanout`` stay as they are."""
        log = cls(spark, path)
        log._commit(Version(0, buckets, max(2, fanout), schema.json()))
        return log

    # ------------------------------------------------------------ versions

    def _files(self, folder: str):
        place = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        store, place = self._files(folder)
        return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []

    def version(self, number: int | None = None) -> Version:
        """The latest version, or an earlier one."""
        known = sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[0] != ".")
        if not known:
            raise FileNotFoundError(f"no manifest at {self.path}")
        found = json.loads(self.spark.read.text(f"{self.path}/versions/{known[-1] if number is None else number:012d}.json", wholetext=True).first()[0])
        return Version(**found | {"runs": [Run(**r) for r in found["runs"]]})

    def _commit(self, version: Version) -> None:
        store, place = self._files(f"versions/{version.number:012d}.json")
        out = store.create(place, False)  # fails if another writer was first
        try:
            out.write(bytearray(json.dumps(asdict(version)).encode()))
        finally:
            out.close()

    # ------------------------------------------------------------ runs

    def _bucket(self, version: Version) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(version.buckets)).cast("int")

    def _schema(self, version: Version) -> StructType:
        return StructType.fromJson(json.loads(version.schema)).add("_set", "long").add("_gone", "boolean").add("bucket", "integer")

    def _read(self, version: Version, runs: list[Run]) -> DataFrame:
        schema = self._schema(version)
        if not runs:
            return self.spark.createDataFrame([], schema)
        out = None
        for run in runs:
            one = self.spark.read.schema(schema).parquet(f"{self.path}/runs/{run.name}")
            out = one if out is None else out.unionByName(one)
        return out

    def _write(self, version: Version, rows: DataFrame, level: int, first: int, last: int) -> Run:
        """Rows (one per path and bucket) as a run; they come in ranges of (bucket, path)."""
        run = Run(f"{first}-{last}-{uuid.uuid4().hex[:12]}", level, first, last)
        rows.sortWithinPartitions("bucket", "path").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/runs/{run.name}")
        return run

    def apply(self, changes: DataFrame | None = None, gone: DataFrame | None = None, order: list[str] | None = None, batch: int | None = None) -> bool:
        """Removes the paths of ``gone`` and then puts ``changes`` in place; False if ``batch`` was applied before.

        Of doubled paths in ``changes`` the row that is greatest by ``order`` (all columns without it) counts."""
        version = self.version()
        if batch is not None and batch <= version.batch:
            return False
        fields = StructType.fromJson(json.loads(version.schema)).fields
        parts = []
        if changes is not None:
            parts.append(changes.select(*[F.col(f.name).cast(f.dataType) for f in fields], F.lit(False).alias("_gone")))
        if gone is not None:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name != "path"]
            parts.append(gone.select("path", *nothing).select(*[f.name for f in fields], F.lit(True).alias("_gone")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        spread = rows.withColumn("bucket", self._bucket(version)).repartitionByRange("bucket", "path")
        kept = newest_per_path(spread, [F.col("_gone").cast("int") * -1, *(order or [f.name for f in fields if f.name != "path"])], ["bucket", "path"])
        version.runs.append(self._write(version, kept.withColumn("_set", F.lit(version.next_set).cast("long")), 0, version.next_set, version.next_set))
        version.number, version.next_set = version.number + 1, version.next_set + 1
        version.batch = version.batch if batch is None else batch
        self._compact(version)
        self._commit(version)
        return True

    def _compact(self, version: Version) -> None:
        level = 0
        while level <= max(r.level for r in version.runs):
            full = [r for r in version.runs if r.level == level]
            if len(full) >= version.fanout:
                rest = [r for r in version.runs if r.level != level]
                merged = newest_per_path(self._read(version, full).repartitionByRange("bucket", "path"), ["_set"], ["bucket", "path"])
                if not any(r.level > level for r in rest):
                    merged = merged.where("NOT _gone")
                version.runs = [*rest, self._write(version, merged, level + 1, min(r.first for r in full), max(r.last for r in full))]
            level += 1

    # ------------------------------------------------------------ reading

    def _newest(self, rows: DataFrame) -> DataFrame:
        return newest_per_path(rows, ["_set"], ["path"]).where("NOT _gone").drop("_set", "_gone", "bucket")

    def state(self, number: int | None = None) -> DataFrame:
        """All rows of the latest version (or an earlier one that was not vacuumed)."""
        version = self.version(number)
        return self._newest(dealt_by_path(self._read(version, version.runs)))

    def find(self, path: str) -> DataFrame:
        """The row of a path, from one bucket of each run."""
        version = self.version()
        place = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(path)), F.lit(version.buckets)).cast("int")).first()[0]
        return self._newest(self._read(version, version.runs).where((F.col("bucket") == place) & (F.col("path") == path)))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions, and runs that those do not need; tells how many runs went."""
        latest = self.version().number
        numbers = [n for n in range(max(0, latest - keep + 1), latest + 1)]
        needed = {r.name for n in numbers for r in self.version(n).runs}
        for name in self._names("versions"):
            if name.endswith(".json") and name[0] != "." and int(name.removesuffix(".json")) < numbers[0]:
                store, place = self._files(f"versions/{name}")
                store.delete(place, False)
        unused = [name for name in self._names("runs") if name not in needed]
        for name in unused:
            store, place = self._files(f"runs/{name}")
            store.delete(place, True)
        return len(unused)


def stream_manifest(stream: DataFrame, log: ManifestLog, checkpoint: str, order: list[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keeps a manifest up to date with a stream of entries: each micro-batch is one change set, applied once."""

    def save(df: DataFrame, batch: int) -> None:
        log.apply(df, order=order, batch=batch)

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
