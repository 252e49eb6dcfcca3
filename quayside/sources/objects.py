"""Listings of object stores and mounted trees by tasks, level by level, and contents read from them.

The frontier is a table of prefixes. Each pass spreads the prefixes of one level over all tasks, every task lists its share through
the store's own client, and the entries go to the shared folder; the driver holds the root and a yes or no per level.
Hidden names are entries like others. A mounted directory of very many entries is only named by the task that lists it: its entries
are then described (size, time) in ranges of names, each by a task of its own. A store's listing has both at once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import persist_shared
from quayside.sources.stores import KNOWN, open_store, scheme_of

#: One listed entry: its path below the root as bytes; ``described`` is false where size and time are still to come.
LISTED = "raw binary, size bigint, mtime_us bigint, is_dir boolean, described boolean"
#: Entries of a mounted directory that the listing task describes itself.
WIDE = 20_000
_ROWS = 10_000
_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
_NAMES = ["raw", "size", "mtime_us", "is_dir", "described"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _described(full: bytes) -> tuple[int, int] | None:
    """Size and time of a mounted file, by what a link points to; None if it has gone meanwhile."""
    try:
        info = os.stat(full)
    except OSError:
        try:
            info = os.lstat(full)  # a link to nowhere is an entry of its own
        except FileNotFoundError:
            return None
    return info.st_size, info.st_mtime_ns // 1000


def _mounted(base: str, raw: bytes, wide: int) -> Iterator[tuple]:
    """Entries of one mounted directory. Linked directories are not entered, so there are no loops."""
    with os.scandir(os.path.join(os.fsencode(base), raw)) as entries:
        for n, e in enumerate(entries):
            path = os.path.join(raw, e.name) if raw else e.name
            if e.is_dir(follow_symlinks=False):
                yield path, None, None, True, True
            elif e.is_symlink() and e.is_dir():
                continue
            elif n >= wide:
                yield path, None, None, False, False
            elif found := _described(e.path):
                yield path, *found, False, True


def _stored(place: fs.FileSystem, base: str, raw: bytes) -> Iterator[tuple]:
    """Entries of one prefix of a store."""
    here = f"{base}/{raw.decode()}" if raw else base
    for info in place.get_file_info(fs.FileSelector(here, recursive=False)):
        is_dir = info.type == fs.FileType.Directory
        time = info.mtime_ns // 1000 if info.mtime_ns is not None and not is_dir else None
        yield info.path.removeprefix(base + "/").encode(), None if is_dir else info.size, time, is_dir, True


def _list(batches: Iterator[pa.RecordBatch], root: str, wide: int) -> Iterator[pa.RecordBatch]:
    place, base = open_store(root)
    mounted = isinstance(place, fs.LocalFileSystem)
    rows: list[tuple] = []
    for batch in batches:
        for raw in batch.column("raw").to_pylist():
            for row in _mounted(base, raw, wide) if mounted else _stored(place, base, raw):
                rows.append(row)
                if len(rows) >= _ROWS:  # a huge directory is streamed, not held
                    yield _batch(rows)
                    rows = []
    yield _batch(rows)


def _describe(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    _, base = open_store(root)
    for batch in batches:
        found = [(raw, _described(os.path.join(os.fsencode(base), raw))) for raw in batch.column("raw").to_pylist()]
        yield _batch([(raw, *about, False, True) for raw, about in found if about])


def readable(raw: str) -> Column:
    """Text of path bytes; what is no UTF-8 becomes a replacement mark."""
    return F.make_valid_utf8(F.col(raw).cast("string"))


def list_objects(spark: SparkSession, prefix: str, tasks: int | None = None, wide: int = WIDE) -> DataFrame:
    """Every file below a prefix, hidden names included: (root, path, size, mtime, is_dir).

    ``prefix`` is a mounted path or a URI of a store that tasks can open (file, s3, gs, hdfs, abfs); of other file systems that only
    Spark knows Spark's own listing is taken, which leaves out names with a leading dot or underscore. Bytes of a path that are no
    UTF-8 become a replacement mark. A prefix that cannot be listed fails the job: a listing is whole or there is none."""
    root = prefix.rstrip("/") or "/"
    if scheme_of(prefix) not in KNOWN:
        return _listed_by_spark(spark, root)
    n = tasks or spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(b"", None, None, True, True)], LISTED)
    found = None
    while True:
        todo = level.where("is_dir").select("raw")
        if found is not None and todo.isEmpty():
            break
        level = persist_shared(todo.repartition(n).mapInArrow(lambda batches: _list(batches, root, wide), LISTED))
        found = level if found is None else found.unionByName(level)
    named = found.where("NOT described").select("raw").repartitionByRange(n, "raw")
    described = named.mapInArrow(lambda batches: _describe(batches, root), LISTED)
    files = found.where("described AND NOT is_dir").unionByName(described)
    return files.select(
        F.lit(root).alias("root"),
        readable("raw").alias("path"),
        "size",
        F.timestamp_micros("mtime_us").alias("mtime"),
        "is_dir",
    )


def _listed_by_spark(spark: SparkSession, root: str) -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.expr("substr(path, instr(path, below) + length(below) + 1)")
    rows = listed.select("path", "length", "modificationTime", F.lit("/" + root.split("://")[-1].partition("/")[2]).alias("below"))
    return rows.select(
        F.lit(root).alias("root"), below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(False).alias("is_dir")
    )


def read_content(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of listed files (root, path, size, mtime), spread over tasks by bytes; ``path`` has the root before it.

    A row holds a whole file, so at most 2 GB; :func:`quayside.sources.scan.read_blocks` has no such limit."""
    from quayside.sources.copying import balance_by_bytes

    spread = balance_by_bytes(files.select("root", "path", "size", "mtime"), tasks or files.sparkSession.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (root, path) in enumerate(zip(batch.column("root").to_pylist(), batch.column("path").to_pylist())):
                place, base = open_store(root)
                with place.open_input_stream(f"{base}/{path}") as source:
                    data = source.read()
                about = [pa.array([f"{root}/{path}"]), batch.column("mtime").slice(k, 1), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(about, names=["path", "modificationTime", "length", "content"])

    return spread.mapInArrow(read, "path string, modificationTime timestamp, length bigint, content binary")
