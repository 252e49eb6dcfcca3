"""Inventories of directory trees and object prefixes."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import paths
from quayside.operators.filters import filter_globs, filter_size
from quayside.session import persist_shared
from quayside.sources.objects import list_objects, read_content

_LISTED = """root string, dir binary, depth int, above array<string>, path string, raw_path binary, size bigint,
mtime_us bigint, created_us bigint, is_dir boolean, is_symlink boolean, symlink_target string, permissions int, uid bigint,
gid bigint, st_blocks bigint, hidden boolean, descend boolean, error string"""
_NAMES = [part.split()[0] for part in _LISTED.replace("\n", " ").split(",")]


#: Bytes of a file that are read at a time.
SLICE = 4 << 20


def _entry(root: str, full: str, relative: str, depth: int, above: list[str], follow: bool) -> dict:
    """One listed entry, described by itself and not by what a link points to."""
    row = dict.fromkeys(_NAMES)
    name = os.path.basename(full)
    readable = _readable(relative)
    row.update(
        root=root, dir=os.fsencode(full), depth=depth, above=above, path=readable, hidden=name.startswith("."), descend=False
    )
    if readable.encode() != os.fsencode(relative):
        row["raw_path"] = os.fsencode(relative)
    try:
        info = os.lstat(full)
        link = stat.S_ISLNK(info.st_mode)
        row.update(
            size=info.st_size,
            mtime_us=info.st_mtime_ns // 1000,
            created_us=int(info.st_birthtime * 1e6) if hasattr(info, "st_birthtime") else None,
            is_dir=stat.S_ISDIR(info.st_mode),
            is_symlink=link,
            symlink_target=_readable(os.readlink(full)) if link else None,
            permissions=info.st_mode,
            uid=info.st_uid,
            gid=info.st_gid,
            st_blocks=info.st_blocks,
        )
        if link and follow and os.path.isdir(full):
            info = os.stat(full)
            ident = f"{info.st_dev}:{info.st_ino}"
            if ident in above:
                row["error"] = f"{_readable(full)}: link loop"
            else:
                row.update(descend=True, above=[*above, ident])
        elif row["is_dir"]:
            row.update(descend=True, above=[*above, f"{info.st_dev}:{info.st_ino}"])
    except OSError as e:
        row["error"] = f"{_readable(full)}: {e.strerror}"
    return row


def _readable(path: str) -> str:
    """The path as valid text; bytes that are none become a replacement mark."""
    return os.fsencode(path).decode("utf-8", "replace")


def _list_children(batches: Iterator[pd.DataFrame], follow: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for root, raw, depth, above in zip(pdf["root"], pdf["dir"], pdf["depth"], pdf["above"]):
            rows, directory = [], os.fsdecode(bytes(raw))
            prefix = root.rstrip("/") + "/"
            try:
                with os.scandir(directory) as entries:
                    for e in entries:
                        rows.append(
                            _entry(root, e.path, e.path.removeprefix(prefix), int(depth) + 1, list(above), follow)
                        )
                        if len(rows) >= 1000:  # a huge directory is streamed, not held
                            yield pd.DataFrame(rows, columns=_NAMES)
                            rows = []
            except OSError as e:
                row = dict.fromkeys(_NAMES)
                row.update(
                    root=root, dir=raw, path=_readable(directory.removeprefix(prefix)), depth=int(depth), above=[],
                    error=f"{_readable(directory)}: {e.strerror}", hidden=False, descend=False,
                )
                rows.append(row)
            if rows:
                yield pd.DataFrame(rows, columns=_NAMES)


def scan_inventory(
    spark: SparkSession,
    roots: list[str],
    follow_symlinks: bool = False,
    include_hidden: bool = False,
    max_depth: int | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    parallelism: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Walks directory trees and returns (inventory, errors).

    One Spark pass per level of the tree: the directories found so far are spread over all
    tasks, each lists its share, and the listing is kept in the shared folder. The driver
    holds the roots and nothing else. Hidden directories are left out of the inventory but
    still walked, and every root is an entry of its own with path ''. Roots must be mounted
    at the same place on all executors.
    """
    n = parallelism or spark.sparkContext.defaultParallelism
    starts = [os.path.realpath(r) for r in roots]
    missing = [r for r in starts if not os.path.exists(r)]
    if missing:
        raise FileNotFoundError(f"no such root: {missing}")
    tops = [_entry(r, r, "", 0, [], follow_symlinks) for r in starts]
    level = spark.createDataFrame([tuple(t[c] for c in _NAMES) for t in tops], _LISTED)
    found, depth = level, 0
    while max_depth is None or depth < max_depth:
        todo = level.where("descend").select("root", "dir", "depth", "above")
        if todo.isEmpty():
            break
        # round robin: neighbouring directories, often alike in size, go to different tasks
        level = persist_shared(
            todo.repartition(n).mapInPandas(lambda it: _list_children(it, follow_symlinks), _LISTED)
        )
        found = found.unionByName(level)
        depth += 1
    errors = found.where(F.col("error").isNotNull()).select("root", "path", F.col("error").alias("message"))
    rows = found.where(F.col("size").isNotNull()).select(
        "root",
        "path",
        "raw_path",
        "size",
        F.timestamp_micros("mtime_us").alias("mtime"),
        F.timestamp_micros("created_us").alias("created"),
        "is_dir",
        "is_symlink",
        "symlink_target",
        "permissions",
        "uid",
        "gid",
        "st_blocks",
        "hidden",
    )
    if not include_hidden:
        rows = rows.where(~F.col("hidden"))
    # filters judge files; directories are kept
    files = filter_globs(filter_size(rows.where("NOT is_dir"), min_size, max_size), include, exclude)
    return files.unionByName(rows.where("is_dir")).drop("hidden"), errors


def scan_content(spark: SparkSession, roots: list[str], glob: str | None = None) -> DataFrame:
    """File bytes: path, modificationTime, length, content. ``glob`` is matched with the name of the file.

    Tasks list and read the files, hidden ones included; see :mod:`quayside.sources.objects`."""
    listed = [list_objects(spark, root) for root in roots]
    files = listed[0]
    for more in listed[1:]:
        files = files.unionByName(more)
    if glob:
        files = files.where(paths.matches_any(paths.last_segment("path"), [glob]))
    return read_content(files)


def read_blocks(files: DataFrame, block: int, root: str | None = None, per_task: int | None = None) -> DataFrame:
    """Blocks of files by range reads: (path, block_index, offset, size, data).

    files: (path, size). The ranges, not the files, are spread over the tasks, so one file of
    any length is read by many of them. ``root`` is put before relative paths.
    """
    # a row per slice of whole blocks, not per block, is dealt out
    step = max(1, SLICE // block) * block
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(step).cast("bigint"))
    slices = files.where("size > 0").select("path", "size", F.explode(starts).alias("at"))
    slices = slices.select("path", "at", F.least(F.lit(step).cast("bigint"), F.col("size") - F.col("at")).alias("length"))
    tasks = per_task or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = slices.repartitionByRange(tasks, "path", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full_size = [], 0
        for batch in batches:
            for path, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "length"))):
                with open(os.path.join(root, path) if root else path, "rb") as handle:
                    handle.seek(at)
                    held.append((path, at, length, handle.read(length)))
                full_size += length
                if full_size >= SLICE:
                    yield _cut_blocks(held, block)
                    held, full_size = [], 0
        if held:
            yield _cut_blocks(held, block)

    return spread.mapInArrow(read, "path string, block_index bigint, offset bigint, size bigint, data binary")


def _cut_blocks(slices: list[tuple[str, int, int, bytes]], block: int) -> pa.RecordBatch:
    """Block rows of slices (path, offset, length, bytes). A file that has become shorter gives shorter or empty blocks."""
    counts = np.array([-(-length // block) for _, _, length, _ in slices])
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat([at for _, at, _, _ in slices], counts)
    offset = first + within * block
    size = np.minimum(block, np.repeat([length for _, _, length, _ in slices], counts) - within * block)
    data = [raw[i : i + block] for _, _, length, raw in slices for i in range(0, length, block)]
    paths_of = pa.array([s[0] for s in slices], pa.string()).take(pa.array(np.repeat(np.arange(len(slices)), counts)))
    columns = [paths_of, pa.array(offset // block), pa.array(offset), pa.array(size), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "block_index", "offset", "size", "data"])


def with_names(df: DataFrame) -> DataFrame:
    """Adds extension and parent directory."""
    return df.select("*", paths.extension("path").alias("extension"), paths.parent("path").alias("parent"))
