"""Jobs that move bytes: copies of files and ranges, block writers, hashes of files.

All of them are retry-safe: a file appears under its name only when complete (written beside
it and renamed), a range is written at its own offset, and a repeated task ends in the same
state. Speculative execution should be off, as two attempts would write the same bytes twice.
Roots must be mounted at the same place on all executors.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.hashing import incremental_digest
from quayside.operators.ordered import SEG, running
from quayside.sources.stores import open_store

BUFFER = 4 << 20

_RESULT = "path string, status string, bytes bigint, hash string, error string"
_RESULT_NAMES = ["path", "status", "bytes", "hash", "error"]


def balance_by_bytes(df: DataFrame, tasks: int, per_file: int = 64 * 1024, order: list[str] | None = None) -> DataFrame:
    """Rows spread over ``tasks`` partitions of about equal bytes.

    Each row weighs its size plus a fixed cost; its place on the running total of weights in ``order`` (the path
    without it; it must tell rows apart), cut into equal pieces, is its partition.
    """
    weighed = df.withColumn("_w", F.col("size") + per_file)
    placed = running(weighed, [], order or ["path"], {"_upto": "_w"}, totals={"_upto": "_all"})
    piece = F.least(F.floor((F.col("_upto") - F.col("_w")) / F.col("_all") * tasks), F.lit(tasks - 1))
    # partitionById: the piece number itself is the partition
    return placed.withColumn("_piece", piece.cast("int")).repartitionById(tasks, "_piece").drop(
        "_w", "_upto", "_all", "_piece", SEG
    )


def _copy_bytes(source: str, target: str, algorithm: str | None) -> tuple[int, str | None]:
    """Copies to a name beside ``target`` and renames; hashes the bytes it writes."""
    digest = incremental_digest(algorithm) if algorithm else None
    beside = f"{target}.part-{uuid.uuid4().hex}"
    done = 0
    try:
        with open(source, "rb") as src, open(beside, "wb") as dst:
            while piece := src.read(BUFFER):
                if digest:
                    digest.update(piece)
                dst.write(piece)
                done += len(piece)
        os.replace(beside, target)
    finally:
        if os.path.exists(beside):
            os.remove(beside)
    return done, digest.hexdigest() if digest else None


def _copy_between_stores(source_root: str, dest_root: str, path: str, size: int, dry_run: bool, incremental: bool, algorithm: str | None):
    """One file where a root is a URI (``s3://bucket/prefix``, ``hdfs://...``, ``file:///...``).

    An object appears when its upload is closed, so it needs no renaming; on other stores the
    file is written beside its name and moved.
    """
    (src, src_base), (dst, dst_base) = open_store(source_root), open_store(dest_root)
    source, target = f"{src_base}/{path}", f"{dst_base}/{path}"
    if incremental:
        here, there = src.get_file_info(source), dst.get_file_info(target)
        if there.is_file and there.size == here.size and there.mtime_ns >= here.mtime_ns:
            return path, "skipped", 0, None, None
    if dry_run:
        return path, "planned", int(size), None, None
    is_object = dst.type_name in ("s3", "gcs", "abfs")
    if not is_object:
        dst.create_dir(os.path.dirname(target), recursive=True)
    beside = target if is_object else f"{target}.part-{uuid.uuid4().hex}"
    digest, done = incremental_digest(algorithm) if algorithm else None, 0
    with src.open_input_stream(source) as reader, dst.open_output_stream(beside) as writer:
        while piece := reader.read(BUFFER):
            if digest:
                digest.update(piece)
            writer.write(piece)
            done += len(piece)
    if not is_object:
        dst.move(beside, target)
    return path, "copied", done, digest.hexdigest() if digest else None, None


def copy_files(
    plan: DataFrame,
    source_root: str,
    dest_root: str,
    dry_run: bool = False,
    incremental: bool = False,
    preserve: bool = True,
    hash_algorithm: str | None = None,
    on_error: str = "continue",
    tasks: int | None = None,
) -> DataFrame:
    """Copies the files of ``plan`` (path, size) and returns one result row per file.

    status is copied, skipped (``incremental``: same size and a destination not older),
    planned (``dry_run``: nothing is created) or failed with its error. ``hash_algorithm``
    hashes in the same pass. ``on_error='fail'`` fails the job at the first error. A root may
    also be a URI of an object store or distributed file system, where attributes are not kept.
    The result is lazy: reading it twice copies twice, so write it before using it.
    """
    spark = plan.sparkSession
    spread = balance_by_bytes(plan.select("path", "size"), tasks or spark.sparkContext.defaultParallelism)

    def one(path: str, size: int) -> tuple:
        source, target = os.path.join(source_root, path), os.path.join(dest_root, path)
        try:
            if "://" in source_root or "://" in dest_root:
                return _copy_between_stores(source_root, dest_root, path, size, dry_run, incremental, hash_algorithm)
            info = os.stat(source)
            if incremental and os.path.exists(target):
                there = os.stat(target)
                if there.st_size == info.st_size and there.st_mtime_ns >= info.st_mtime_ns:
                    return path, "skipped", 0, None, None
            if dry_run:
                return path, "planned", int(size), None, None
            os.makedirs(os.path.dirname(target), exist_ok=True)
            done, digest = _copy_bytes(source, target, hash_algorithm)
            if preserve:
                shutil.copystat(source, target)
            return path, "copied", done, digest, None
        except OSError as e:
            if on_error == "fail":
                raise
            return path, "failed", 0, None, f"{type(e).__name__}: {e.strerror}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(p, s) for p, s in zip(pdf["path"], pdf["size"])]
            yield pd.DataFrame(rows, columns=_RESULT_NAMES)

    return spread.mapInPandas(work, _RESULT)


def copy_chunks(chunks: DataFrame, source_root: str, dest_root: str, tasks: int | None = None) -> DataFrame:
    """Copies byte ranges of huge files into place: one result row per range.

    chunks: (path, file_size, part, offset, size) of :func:`quayside.plans.transfer.chunk_plan`.
    Many tasks write one file, each at its own offset of a file set to its full length; see
    :func:`chunk_completeness` for whole files.
    """
    n = tasks or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.select("path", "file_size", "part", F.coalesce("offset", F.lit(0)).alias("offset"), "size").repartition(n)

    def one(path, file_size, offset, size) -> tuple[int, str | None]:
        target = os.path.join(dest_root, path)
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(os.path.join(source_root, path), "rb") as src:
                # opened without truncation: other tasks may have written their ranges
                handle = os.open(target, os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    if os.fstat(handle).st_size != file_size:
                        os.ftruncate(handle, file_size)
                    src.seek(offset)
                    done = 0
                    while done < size and (piece := src.read(min(BUFFER, size - done))):
                        os.pwrite(handle, piece, offset + done)
                        done += len(piece)
                finally:
                    os.close(handle)
            return done, None
        except OSError as e:
            return 0, f"{type(e).__name__}: {e.strerror}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(p, int(f), int(o), int(s)) for p, f, o, s in zip(pdf["path"], pdf["file_size"], pdf["offset"], pdf["size"])]
            yield pdf[["path", "part", "file_size"]].assign(bytes=[r[0] for r in rows], error=[r[1] for r in rows])

    return spread.mapInPandas(work, "path string, part bigint, file_size bigint, bytes bigint, error string")


def write_ranges(ranges: DataFrame, files: DataFrame, base_root: str, new_root: str, dest_root: str, tasks: int | None = None) -> DataFrame:
    """Rebuilds files below ``dest_root`` from ranges (path, op, source_offset, dest_offset, size) of
    :func:`quayside.operators.delta.delta_ranges`: one result row per range.

    A copy is read from the old version below ``base_root``, an insert from the new one below ``new_root``, and each is written at its
    own offset of a file set to its length. files: (path, size) of the new version; those without ranges (empty ones) are made, too.
    Ranges are spread by bytes, so many tasks write one large file."""
    n = tasks or files.sparkSession.sparkContext.defaultParallelism
    wanted = files.select("path", F.col("size").alias("file_size")).join(ranges, "path", "left").fillna({"source_offset": 0, "dest_offset": 0, "size": 0})
    spread = balance_by_bytes(wanted, n, order=["path", "dest_offset"])

    def one(path, file_size, op, source_offset, dest_offset, size) -> tuple[int, str | None]:
        target = os.path.join(dest_root, path)
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            handle = os.open(target, os.O_WRONLY | os.O_CREAT, 0o644)  # not truncated: other tasks write here, too
            try:
                if os.fstat(handle).st_size != file_size:
                    os.ftruncate(handle, file_size)
                done = 0
                if size:
                    with open(os.path.join(base_root if op == "copy" else new_root, path), "rb") as source:
                        source.seek(source_offset)
                        while done < size and (piece := source.read(min(BUFFER, size - done))):
                            os.pwrite(handle, piece, dest_offset + done)
                            done += len(piece)
            finally:
                os.close(handle)
            return done, None if done == size else f"{size - done} bytes missing"
        except OSError as e:
            return 0, f"{type(e).__name__}: {e.strerror}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = ["path", "file_size", "op", "source_offset", "dest_offset", "size"]
            rows = [one(p, int(f), op, int(s), int(d), int(n)) for p, f, op, s, d, n in zip(*(pdf[c] for c in columns))]
            yield pdf[columns].assign(bytes=[r[0] for r in rows], error=[r[1] for r in rows])

    schema = "path string, file_size bigint, op string, source_offset bigint, dest_offset bigint, size bigint, bytes bigint, error string"
    return spread.select("path", "file_size", "op", "source_offset", "dest_offset", "size").mapInPandas(work, schema)


def chunk_completeness(results: DataFrame) -> DataFrame:
    """Per file: bytes written, ranges, and whether all of it arrived."""
    return results.groupBy("path").agg(
        F.max("file_size").alias("file_size"),
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("chunks"),
        F.count("error").alias("errors"),
    ).withColumn("complete", (F.col("bytes") == F.col("file_size")) & (F.col("errors") == 0))


def write_files(df: DataFrame, root: str, content: str = "content") -> DataFrame:
    """Writes (path, content) rows as files below ``root``; one result row per file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, value in zip(batch.column("path").to_pylist(), batch.column("_raw")):
                data = value.as_buffer()  # the batch's own bytes, not a copy
                target = os.path.join(root, path)
                beside = f"{target}.part-{uuid.uuid4().hex}"
                try:
                    out = open(beside, "wb")
                except FileNotFoundError:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    out = open(beside, "wb")
                with out:
                    out.write(data)
                os.replace(beside, target)
                sizes.append(data.size)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return df.select("path", F.col(content).cast("binary").alias("_raw")).mapInArrow(work, "path string, bytes bigint")


def hash_files(files: DataFrame, root: str, algorithm: str = "xxh3_128", tasks: int | None = None) -> DataFrame:
    """Hashes files (path, size) of any length by streaming them: path, size, algorithm, hash, error."""
    spread = balance_by_bytes(files.select("path", "size"), tasks or files.sparkSession.sparkContext.defaultParallelism)

    def one(path: str) -> tuple:
        digest, size = incremental_digest(algorithm), 0
        try:
            with open(os.path.join(root, path), "rb") as f:
                while piece := f.read(BUFFER):
                    digest.update(piece)
                    size += len(piece)
            return path, size, algorithm, digest.hexdigest(), None
        except OSError as e:
            return path, None, algorithm, None, f"{type(e).__name__}: {e.strerror}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(p) for p in pdf["path"]], columns=["path", "size", "algorithm", "hash", "error"])

    return spread.mapInPandas(work, "path string, size bigint, algorithm string, hash string, error string")
