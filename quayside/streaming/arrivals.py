"""A streaming source of arriving files: a reader of Spark's Python data source interface.

An offset is a time, and a micro-batch has the files that changed after the start and up to the end of its times. The
driver looks at directories of the first levels only; each of them is a partition, and tasks list what lies below, hidden names included.
So neither the offset nor the driver grows with the number of files, and a batch that is run again after a failure lists the
same span of time again.

For mounted files "changed" is the later of modification and inode change: a file that is moved or copied in with an old
modification time still counts as arriving now. A store's own time of last modification is that of the upload. Files must be seen by a
listing ``settle`` seconds after they changed at the latest (clocks of kernels tick coarsely, those of stores may differ).
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quayside.sources.stores import open_store

SCHEMA = "path string, size bigint, mtime timestamp, changed timestamp"
_ROWS = 10_000


@dataclass
class Prefix(InputPartition):
    """Files right in a directory, or all below it, that changed in (start, end]."""

    directory: str
    below: bool
    start: int
    end: int


def _mounted(top: str, below: bool) -> Iterator[tuple[str, int, int, int]]:
    """(path, size, modification, change) of files, times in microseconds; linked directories are not entered."""
    waiting = [top]
    while waiting:
        try:
            with os.scandir(waiting.pop()) as entries:
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if below:
                                waiting.append(e.path)
                        elif not e.is_dir():
                            info = e.stat()
                            yield e.path, info.st_size, info.st_mtime_ns // 1000, max(info.st_mtime_ns, info.st_ctime_ns) // 1000
                    except FileNotFoundError:  # gone, or a link to nowhere
                        continue
        except FileNotFoundError:
            continue


def _stored(place: fs.FileSystem, top: str, below: bool) -> Iterator[tuple[str, int, int, int]]:
    for info in place.get_file_info(fs.FileSelector(top, recursive=below, allow_not_found=True)):
        if info.type == fs.FileType.File:
            changed = info.mtime_ns // 1000
            yield info.path, info.size, changed, changed


def _directories(place: fs.FileSystem, base: str, levels: int) -> Iterator[tuple[str, bool]]:
    """(directory, with all below it): whole directories ``levels`` deep, and those above without what is below."""
    todo = [(base, 0)]
    while todo:
        here, depth = todo.pop()
        yield here, depth >= levels
        if depth >= levels:
            continue
        if isinstance(place, fs.LocalFileSystem):
            with os.scandir(here) as entries:
                todo += [(e.path, depth + 1) for e in entries if e.is_dir(follow_symlinks=False)]
        else:
            found = place.get_file_info(fs.FileSelector(here, recursive=False))
            todo += [(i.path, depth + 1) for i in found if i.type == fs.FileType.Directory]


class ArrivalsReader(DataSourceStreamReader):
    def __init__(self, root: str, levels: int, settle: float):
        self.root, self.levels, self.settle = root, levels, settle

    def initialOffset(self) -> dict:
        return {"until": -(2**62)}

    def latestOffset(self) -> dict:
        now = time.time_ns() // 1000
        time.sleep(self.settle)
        return {"until": now}

    def partitions(self, start: dict, end: dict) -> list[Prefix]:
        place, base = open_store(self.root)
        return [Prefix(directory, below, start["until"], end["until"]) for directory, below in _directories(place, base, self.levels)]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        place, base = open_store(self.root)
        if isinstance(place, fs.LocalFileSystem):
            found = _mounted(partition.directory, partition.below)
        else:
            found = _stored(place, partition.directory, partition.below)
        types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC")]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["path", "size", "mtime", "changed"])

        for path, size, mtime, changed in found:
            if partition.start < changed <= partition.end:
                rows.append((os.fsencode(path.removeprefix(base + "/")).decode("utf-8", "replace"), size, mtime, changed))
                if len(rows) >= _ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class Arrivals(DataSource):
    """``spark.readStream.format("arrivals").option("root", ...)``; options ``levels`` (2) and ``settle`` (0.05 seconds)."""

    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArrivalsReader:
        options = self.options
        return ArrivalsReader(options["root"], int(options.get("levels", 2)), float(options.get("settle", 0.05)))
