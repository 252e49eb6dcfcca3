"""Archives of small files: one per batch, with an index of members beside it, and back to rows.

Members of plain archives are written and read by range, wherever in the archive they are, so one large archive is shared by many tasks,
and so is its index. Compressed ones have to be written and read from the front, each by one task and one member after the other.
"""

from __future__ import annotations

import json
import os
import tarfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators.ordered import running, with_position
from quayside.session import persist_shared
from quayside.sources.copying import BUFFER, balance_by_bytes
from quayside.sources.objects import list_objects
from quayside.sources.stores import open_store

# Archive suffix per format.
SUFFIX = {"tar": ".tar", "tar-gz": ".tar.gz", "tar-zstd": ".tar.zst"}
_MODE = {"tar": "w", "tar-gz": "w:gz", "tar-zstd": "w"}
#: Name of the index beside an archive: a line with the archive's size, then (path, offset, size) of each member.
INDEX = ".index"
#: Bytes of a member that a task writes at a time, and of an index that a task reads.
SLICE, INDEX_SLICE = 256 << 20, 4 << 20
MEMBERS = "root string, archive string, path string, offset bigint, size bigint"


def write_archives(
    batches: DataFrame, source_root: str, out_dir: str, fmt: str = "tar", max_members: int | None = None
) -> DataFrame:
    """Packs every batch (path, size, batch) into archives named by batch and part.

    Returns (archive, files, missing, bytes) rows. Only names are shuffled; tasks read the files themselves. Missing files
    are left out and counted. A batch is one archive; with ``max_members`` it is cut into several of at most that many files.
    A plain archive is written by many tasks, when this is called: sizes and headers tell where each member goes. It gets its
    index beside it. A compressed one is written by one task, when the result is read.
    """
    if fmt not in SUFFIX:
        raise ValueError(f"unknown archive format {fmt!r}")
    placed = with_position(batches.where("batch IS NOT NULL").select("path", "size", "batch"), ["batch"], ["path"], "_at")
    parts = placed.withColumn("part", F.floor(F.col("_at") / (max_members or 2**62)).cast("bigint"))
    if fmt == "tar":
        return _write_plain(parts.select("batch", "part", "path", "_at"), source_root, out_dir)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        name = _archive_name(pdf["batch"].iloc[0], pdf["part"].iloc[0], fmt)
        os.makedirs(out_dir, exist_ok=True)
        target = os.path.join(out_dir, name)
        beside = f"{target}.part-{uuid.uuid4().hex}"
        files = missing = total = 0
        with open(beside, "wb") as raw:
            sink = raw
            if fmt == "tar-zstd":
                import zstandard

                sink = zstandard.ZstdCompressor(level=3).stream_writer(raw, closefd=False)
            with tarfile.open(fileobj=sink, mode=_MODE[fmt]) as tar:
                for path in sorted(pdf["path"]):
                    full = os.path.join(source_root, path)
                    if not os.path.exists(full):
                        missing += 1
                        continue
                    info = _tar_info(tar, full, path)
                    if info.isreg():
                        with open(full, "rb") as body:
                            tar.addfile(info, body)
                    else:
                        tar.addfile(info)
                    files, total = files + 1, total + os.path.getsize(full)
            if sink is not raw:
                sink.close()
        os.replace(beside, target)
        return pd.DataFrame({"archive": [name], "files": [files], "missing": [missing], "bytes": [total]})

    return parts.groupBy("batch", "part").applyInPandas(
        pack, "archive string, files bigint, missing bigint, bytes bigint"
    )


def _archive_name(batch: int, part: int, fmt: str) -> str:
    return f"batch-{int(batch):08d}-{int(part):04d}{SUFFIX[fmt]}"


def _tar_info(tar: tarfile.TarFile, full: str, path: str) -> tarfile.TarInfo:
    info = tar.gettarinfo(full, arcname=path)
    if info.islnk():  # a second name of a file packed before: packed again, so that each member stands alone
        info.type, info.linkname, info.size = tarfile.REGTYPE, "", os.path.getsize(full)
    return info


def _header(info: tarfile.TarInfo) -> bytes:
    return info.tobuf(tarfile.DEFAULT_FORMAT, tarfile.ENCODING, "surrogateescape")


def _index_line(path: str, offset: int, size: int) -> bytes:
    """Its length does not depend on the offset, so lines have their places before offsets are known."""
    return f"[{json.dumps(path)}, {offset:>20}, {size}]\n".encode()


def _size_line(size: int) -> bytes:
    return f"[{size:>20}]\n".encode()


def _write_plain(parts: DataFrame, source_root: str, out_dir: str) -> DataFrame:
    """Plain archives of (batch, part, path, _at) rows, each member's slices written at their own offset by any task.

    The archives stand under their names only when all their slices are written."""
    n = parts.sparkSession.sparkContext.defaultParallelism
    token = uuid.uuid4().hex

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tarfile.open(fileobj=open(os.devnull, "wb"), mode="w") as tar:
            for pdf in batches:
                rows = []
                for path in pdf["path"]:
                    full = os.path.join(source_root, path)
                    if not os.path.exists(full):
                        rows.append((False, 0, 0, 0, 0, 0))
                        continue
                    info = _tar_info(tar, full, path)
                    tar.inodes.clear()
                    size, head = (info.size if info.isreg() else 0), len(_header(info))
                    line = len(_index_line(path, 0, size)) if info.isreg() else 0
                    rows.append((True, size, head, head + -(-size // 512) * 512, line, os.path.getsize(full)))
                facts = pd.DataFrame(rows, columns=["there", "size", "head", "space", "line", "counted"], index=pdf.index)
                yield pd.concat([pdf, facts], axis=1)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: tuple[int, int] | None = None
        archive = index = -1
        try:
            with tarfile.open(fileobj=open(os.devnull, "wb"), mode="w") as tar:
                for pdf in batches:
                    for row in pdf.itertuples(index=False):
                        if opened != (row.batch, row.part):
                            if opened:
                                os.close(archive)
                                os.close(index)
                                opened = None
                            os.makedirs(out_dir, exist_ok=True)
                            beside = os.path.join(out_dir, f"{_archive_name(row.batch, row.part, 'tar')}.part-{token}")
                            # two blocks of zeros end an archive, which is a whole number of records
                            length = -(-(row.all_space + 2 * 512) // tarfile.RECORDSIZE) * tarfile.RECORDSIZE
                            first = _size_line(length)
                            # opened without truncation: other tasks may have written their slices
                            archive, index = (os.open(p, os.O_WRONLY | os.O_CREAT, 0o644) for p in (beside, beside + INDEX))
                            opened = (row.batch, row.part)
                            for handle, whole in ((archive, length), (index, len(first) + row.all_lines)):
                                if os.fstat(handle).st_size != whole:
                                    os.ftruncate(handle, whole)
                            os.pwrite(index, first, 0)
                        if not row.there:
                            continue
                        full, begin = os.path.join(source_root, row.path), row.space_end - row.space
                        if row.slice_from == 0:
                            info = _tar_info(tar, full, row.path)
                            tar.inodes.clear()
                            head = _header(info)
                            if len(head) != row.head or (info.size if info.isreg() else 0) != row.size:
                                raise OSError(f"{full} changed while it was packed")
                            os.pwrite(archive, head, begin)
                            if row.line:
                                os.pwrite(index, _index_line(row.path, begin + row.head, row.size), len(first) + row.line_end - row.line)
                        if row.size:
                            done, end = row.slice_from, min(row.slice_from + SLICE, row.size)
                            with open(full, "rb") as body:
                                body.seek(done)
                                while done < end:
                                    piece = body.read(min(BUFFER, end - done))
                                    if not piece:
                                        raise OSError(f"{full} changed while it was packed")
                                    os.pwrite(archive, piece, begin + row.head + done)
                                    done += len(piece)
                    whole = pdf["slice_from"] == 0
                    yield pd.DataFrame({
                        "batch": pdf["batch"], "part": pdf["part"], "files": (whole & pdf["there"]).astype("int64"),
                        "missing": (whole & ~pdf["there"]).astype("int64"), "bytes": pdf["counted"].where(whole, 0),
                    })
        finally:
            if opened:
                os.close(archive)
                os.close(index)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = [_archive_name(b, p, "tar") for b, p in zip(pdf["batch"], pdf["part"])]
            for target in (os.path.join(out_dir, name) for name in names):
                # of a repeated attempt, what the one before has named is left alone
                for place in (INDEX, ""):
                    if os.path.exists(f"{target}.part-{token}{place}"):
                        os.replace(f"{target}.part-{token}{place}", target + place)
            yield pdf.assign(archive=names)[["archive", "files", "missing", "bytes"]]

    # stored, as cutting it into segments reads it twice
    measured = persist_shared(parts.repartition(n).mapInPandas(
        measure, "batch bigint, part bigint, path string, _at bigint, there boolean, size bigint, head bigint, space bigint, line bigint, counted bigint"
    ))
    laid = running(
        measured, ["batch", "part"], ["path", "_at"], {"space_end": "space", "line_end": "line"}, totals={"space_end": "all_space", "line_end": "all_lines"}
    )
    sliced = laid.select("*", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {SLICE}L)")).alias("slice_from"))
    weighed = sliced.withColumns({"whole": F.col("size"), "size": F.least(F.col("size") - F.col("slice_from"), F.lit(SLICE))})
    spread = balance_by_bytes(weighed, n, per_file=4096, order=["batch", "part", "path", "_at", "slice_from"])
    ordered = spread.withColumn("size", F.col("whole")).drop("whole").sortWithinPartitions("batch", "part", "space_end", "slice_from")
    # all slices are in place, once, before any archive gets its name
    written = persist_shared(ordered.mapInPandas(write, "batch bigint, part bigint, files bigint, missing bigint, bytes bigint").groupBy("batch", "part").agg(
        *[F.sum(c).alias(c) for c in ("files", "missing", "bytes")]
    ))
    return persist_shared(written.mapInPandas(finish, "archive string, files bigint, missing bigint, bytes bigint"))


def _index_size(place: fs.FileSystem, full: str, size: int) -> int | None:
    """Bytes of the index beside an archive; None if there is none, or it is of another archive."""
    found = place.get_file_info(full + INDEX)
    if found.type != fs.FileType.File:
        return None
    with place.open_input_file(full + INDEX) as source:
        first = source.read_at(min(64, found.size), 0).split(b"\n")[0]
    try:
        return found.size if json.loads(first) == [size] else None
    except ValueError:
        return None


def _index_slice(place: fs.FileSystem, full: str, begin: int, end: int) -> list[tuple[str, int, int]]:
    """Members by the lines of an index that begin in a range of its bytes."""
    with place.open_input_file(full + INDEX) as source:
        at = max(begin - 1, 0)
        data = source.read_at(end - at, at)
        data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""  # the line that began before, or the archive's size
        while data and not data.endswith(b"\n"):
            rest = source.read_at(64 << 10, end)
            end += len(rest)
            data += rest[: rest.find(b"\n") + 1] if b"\n" in rest else rest or b"\n"
    return [tuple(json.loads(line)) for line in data.split(b"\n") if line]


def _by_headers(place: fs.FileSystem, full: str) -> list[tuple[str, int, int]]:
    """Members by the headers of a plain archive; their bytes are skipped, not read."""
    with place.open_input_file(full) as source, tarfile.open(fileobj=source, mode="r:") as tar:
        return [(m.name, m.offset_data, m.size) for m in tar if m.isfile()]


def archive_members(spark: SparkSession, directory: str) -> DataFrame:
    """(root, archive, path, offset, size): members of all plain archives below a folder, from their indexes or their headers."""
    listed = list_objects(spark, directory).where(F.col("path").endswith(".tar")).select("root", "path", "size")

    n = spark.sparkContext.defaultParallelism

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = []
            for root, archive, size in zip(pdf["root"], pdf["path"], pdf["size"]):
                place, base = open_store(root)
                found = _index_size(place, f"{base}/{archive}", int(size))
                sizes.append(-1 if found is None else found)
            yield pd.DataFrame({"root": pdf["root"], "archive": pdf["path"], "index_size": sizes})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, archive, index_size, begin in zip(*(batch.column(c).to_pylist() for c in ("root", "archive", "index_size", "begin"))):
                place, base = open_store(root)
                full = f"{base}/{archive}"
                found = _by_headers(place, full) if index_size < 0 else _index_slice(place, full, begin, min(begin + INDEX_SLICE, index_size))
                columns = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array([root] * len(found), pa.string()), pa.array([archive] * len(found), pa.string()), pa.array(columns[0], pa.string()),
                     pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                    names=["root", "archive", "path", "offset", "size"],
                )

    looked = listed.repartition(n).mapInPandas(look, "root string, archive string, index_size bigint")
    slices = looked.select("*", F.explode(F.expr(f"sequence(0L, greatest(index_size - 1, 0L), {INDEX_SLICE}L)")).alias("begin"))
    return slices.repartition(n).mapInArrow(read, MEMBERS)


def read_members(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """(archive, path, size, content) of indexed members, spread by bytes; each is read by its range of the archive."""
    n = tasks or members.sparkSession.sparkContext.defaultParallelism
    spread = balance_by_bytes(members, n, per_file=4096, order=["root", "archive", "offset", "path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, str] | None = None
        source: Any = None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if opened != (row["root"], row["archive"]):
                        if source:
                            source.close()
                        place, base = open_store(row["root"])
                        opened, source = (row["root"], row["archive"]), place.open_input_file(f"{base}/{row['archive']}")
                    data = source.read_at(row["size"], row["offset"]) if row["size"] else b""
                    yield _member(row["archive"], row["path"], data)
        finally:
            if source:
                source.close()

    return spread.mapInArrow(read, "archive string, path string, size bigint, content binary")


def _member(archive: str, path: str, data: bytes) -> pa.RecordBatch:
    columns = [pa.array([archive]), pa.array([path]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["archive", "path", "size", "content"])


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    """Members of all archives in a folder: archive, path, size, content. Links are no members."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, archive in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist()):
                place, base = open_store(root)
                with place.open_input_stream(f"{base}/{archive}", compression=None) as source:
                    reader = source
                    if archive.endswith(".zst"):
                        import zstandard

                        reader = zstandard.ZstdDecompressor().stream_reader(source)
                    with tarfile.open(fileobj=reader, mode="r|" if archive.endswith(".zst") else "r|*") as tar:
                        for member in tar:
                            if member.isfile():
                                yield _member(archive, member.name, tar.extractfile(member).read())

    plain = read_members(persist_shared(archive_members(spark, directory)))
    packed = list_objects(spark, directory).where(F.col("path").rlike(r"\.tar\.(gz|zst)\z")).select("root", "path")
    streamed = packed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(stream, "archive string, path string, size bigint, content binary")
    return plain.unionByName(streamed)
