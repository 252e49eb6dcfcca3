"""Content at the level of blocks: split, sign, flag, measure, encrypt, resume."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quayside.functions.hashing import content_hash, weak_checksum
from quayside.functions.rates import ratio
from quayside.operators.islands import runs
from quayside.sources.stores import open_store


def split_blocks(
    df: DataFrame, content: str = "content", block: int = 1024 * 1024, keep: list[str] | None = None
) -> DataFrame:
    """One row per fixed-size block of a content column: block_index, offset, size, data.

    Text is cut by its UTF-8 bytes; ``data`` is binary. The last block may be shorter; empty
    content has none. The blocks are cut into one array per row before the explode, so that
    exploded rows do not each drag the whole content along.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != content]
    raw = df.select(*keep, F.col(content).cast("binary").alias("_raw"))
    n = F.floor((F.length("_raw") + (block - 1)) / block).cast("int")
    cut = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: F.substring(F.col("_raw"), i * block + 1, F.lit(block)),
        ),
    )
    return raw.select(*keep, F.posexplode(cut).alias("_i", "data")).select(
        *keep,
        F.col("_i").cast("bigint").alias("block_index"),
        (F.col("_i").cast("bigint") * block).alias("offset"),
        F.length("data").cast("bigint").alias("size"),
        "data",
    )


def signatures(blocks: DataFrame, strong: str = "sha256") -> DataFrame:
    """Blocks with ``weak`` and ``strong`` in place of their data."""
    rest = [c for c in blocks.columns if c != "data"]
    return blocks.select(*rest, weak_checksum("data").alias("weak"), content_hash("data", strong).alias("strong"))


def for_all_files(sums: DataFrame, files: DataFrame | None, keys: list[str], **empty) -> DataFrame:
    """``sums`` of blocks with a row for every file: one of ``files`` that has no blocks gets the values of ``empty``."""
    if files is None:
        return sums
    return files.select(*keys).join(sums, keys, "left").na.fill(empty)


def signature_summary(sigs: DataFrame, key: str = "path", files: DataFrame | None = None) -> DataFrame:
    """File size and number of chunks per signature; empty files have a row if ``files`` names them."""
    sums = sigs.groupBy(key).agg(F.sum("size").alias("file_size"), F.count("*").alias("num_chunks"))
    return for_all_files(sums, files, [key], file_size=0, num_chunks=0)


def rolling_weak(data: bytes, window: int) -> np.ndarray:
    """Weak checksum of every window of ``data``, from prefix sums of bytes and weighted bytes."""
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(values) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    weighted = np.concatenate(
        [[np.uint64(0)], np.cumsum(values * np.arange(len(values), dtype=np.uint64), dtype=np.uint64)]
    )
    start = np.arange(n, dtype=np.uint64)
    a = total[window:] - total[:n]
    # sum of (window - (j - start)) * byte j, all modulo 2^64
    b = (np.uint64(window) + start) * a - (weighted[window:] - weighted[:n])
    mask = np.uint64(0xFFFFFFFF)
    return (((b << np.uint64(16)) & mask) | (a & np.uint64(0xFFFF))).astype(np.int64)


def rolling_signatures(
    df: DataFrame,
    window: int,
    key: str = "path",
    content: str = "content",
    among: str | None = None,
) -> DataFrame:
    """(key, offset, weak, strong) for every byte offset of contents held in a row.

    With ``among``, a column of weak checksums, only offsets whose checksum is one of them are
    emitted, which is how shifted blocks are looked for. A content is worked off in slices.
    """
    key_type = df.schema[key].dataType.simpleString()

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = 1 << 18
        for pdf in batches:
            wanted = pdf[among] if among else [None] * len(pdf)
            for k, value, weak_set in zip(pdf[key], pdf[content], wanted):
                data = value.encode() if isinstance(value, str) else bytes(value)
                for at in range(0, len(data) - window + 1, step):
                    weak = rolling_weak(data[at : at + step + window - 1], window)
                    hit = np.arange(len(weak)) if among is None else np.flatnonzero(np.isin(weak, weak_set))
                    strong = [hashlib.sha256(data[at + o : at + o + window]).hexdigest() for o in hit]
                    yield pd.DataFrame({key: k, "offset": at + hit, "weak": weak[hit], "strong": strong})

    columns = [key, content] + ([among] if among else [])
    return df.select(*columns).mapInPandas(
        roll, f"`{key}` {key_type}, offset bigint, weak bigint, strong string"
    )


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(factor)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def filter_places(weak: np.ndarray, bits: np.ndarray | int, probes: int = 7) -> np.ndarray:
    """The bits of a Bloom filter that belong to each weak checksum: checksums x probes."""
    first, step = _mixed(weak, 0x9E3779B97F4A7C15) >> np.uint64(16), _mixed(weak, 0xD6E8FEB86659FD93) >> np.uint64(17) | np.uint64(1)
    places = first[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]
    return (places % np.asarray(bits, dtype=np.uint64).reshape(-1, 1)).astype(np.int64)


def weak_filters(base: DataFrame, bits_per_block: int = 10) -> DataFrame:
    """(path, bits, words, values): a Bloom filter of the weak checksums of each base file, by its words of 64 bits that are not 0.

    Words are put together by a combined OR before and after the shuffle, so no task sees the signatures of a whole file."""
    sizes = base.groupBy("path").agg((F.max("block_index") * bits_per_block + 64).alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            places = filter_places(batch.column("weak").to_numpy(), bits)
            row = pa.array(np.repeat(np.arange(len(places)), places.shape[1]))
            values = (np.uint64(1) << (places.ravel() & 63).astype(np.uint64)).view(np.int64)
            columns = [batch.column("path").take(row), batch.column("bits").take(row), pa.array(places.ravel() >> 6), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "bits", "word", "value"])

    marks = base.select("path", "weak").distinct().join(sizes, "path").select("path", "weak", "bits")
    words = marks.mapInArrow(run, "path string, bits bigint, word bigint, value bigint").groupBy("path", "bits", "word").agg(F.bit_or("value").alias("value"))
    gathered = words.groupBy("path", "bits").agg(F.collect_list(F.struct("word", "value")).alias("w"))
    return gathered.select("path", "bits", F.col("w.word").alias("words"), F.col("w.value").alias("values"))


def _constant(data: np.ndarray, window: int) -> np.ndarray:
    """Which windows have one and the same byte throughout."""
    change = np.concatenate([[0], np.cumsum(data[1:] != data[:-1])])
    return change[window - 1 :] == change[: len(data) - window + 1]


def _rolled(data: bytes, at: int, window: int, wanted: np.ndarray, bits: int) -> list[tuple[int, int, int, str]]:
    """(first, last, weak, strong) of runs of offsets with equal windows that the filter lets through."""
    weak = rolling_weak(data, window)
    hit = np.arange(len(weak))
    for probes in (slice(0, 1), slice(1, 7)):  # most offsets are looked up once
        places = filter_places(weak[hit], bits)[:, probes] if probes.start else filter_places(weak, bits, 1)
        hit = hit[((wanted[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1).all(axis=1)]
    constant = _constant(np.frombuffer(data, dtype=np.uint8), window)[hit]
    found: list[tuple[int, int, int, str]] = []
    known: dict[int, str] = {}
    for o, same in zip(hit.tolist(), constant.tolist()):
        if same and found and found[-1][1] == at + o - 1 and known.get(data[o]) == found[-1][3]:
            found[-1] = (found[-1][0], at + o, *found[-1][2:])
            continue
        strong = known.get(data[o]) if same else None
        if strong is None:
            strong = hashlib.sha256(data[o : o + window]).hexdigest()
            if same:
                known[data[o]] = strong
        found.append((at + o, at + o, int(weak[o]), strong))
    return found


_HITS = "path string, first bigint, last bigint, weak bigint, strong string"


def _hits(slices: DataFrame, window: int, read: Callable[[str, int, int], bytes] | None) -> DataFrame:
    """Candidates in slices (path, at, bits, words, values and data, or length to ``read``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bits, wanted = None, 0, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                path, at = row["path"].as_py(), row["at"].as_py()
                if path != last:
                    last, bits = path, row["bits"].as_py()
                    wanted = np.zeros(bits // 64 + 1, dtype=np.uint64)
                    wanted[row["words"].values.to_numpy()] = row["values"].values.to_numpy().view(np.uint64)
                data = read(path, at, row["length"].as_py()) if read else row["data"].as_py()
                found = _rolled(data, at, window, wanted, bits) if len(data) >= window else []
                columns = list(zip(*found)) or [()] * 4
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=["path", "first", "last", "weak", "strong"],
                )

    return slices.mapInArrow(run, _HITS)


def _confirmed(hits: DataFrame, base: DataFrame) -> DataFrame:
    """Offsets whose strong hash is that of a base block, with the lowest such block. Runs of equal windows are one row until here."""
    first = base.groupBy("path", "weak", "strong").agg(F.min("block_index").alias("source_index"))
    found = hits.join(first, ["path", "weak", "strong"])
    return found.select("path", F.explode(F.sequence("first", "last")).alias("offset"), "source_index")


def shifted_matches(new: DataFrame, base_signatures: DataFrame, window: int, content: str = "content", span: int = 1 << 20) -> DataFrame:
    """Offsets of the new content where a whole base block of the same file reappears: (path, offset, source_index).

    Contents are cut into slices of ``span`` offsets that overlap by a window. A Bloom filter of the base's weak checksums tells which
    offsets are candidates, the strong hash is computed for those only and decides."""
    base = base_signatures.where(F.col("size") == window)
    raw = new.select("path", F.col(content).cast("binary").alias("_raw")).join(weak_filters(base), "path")
    n = F.floor((F.length("_raw") - window) / F.lit(span)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col("_raw"), i * span + 1, F.lit(span + window - 1)))
    slices = raw.where(F.length("_raw") >= window).select("path", "bits", "words", "values", F.posexplode(cut).alias("_i", "data"))
    return _confirmed(_hits(slices.withColumn("at", F.col("_i").cast("bigint") * span), window, None), base)


def shifted_matches_in_files(files: DataFrame, root: str, base_signatures: DataFrame, window: int, span: int = 32 << 20, tasks: int | None = None) -> DataFrame:
    """The same for files (path, size) below ``root``, of any length: slices, not files, are spread over the tasks, which read them."""
    base = base_signatures.where(F.col("size") == window)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - window, F.lit(span).cast("bigint"))
    slices = files.where(F.col("size") >= window).select("path", "size", F.explode(starts).alias("at"))
    slices = slices.select("path", "at", F.least(F.lit(span + window - 1), F.col("size") - F.col("at")).alias("length"))
    spread = slices.join(weak_filters(base), "path").repartition(tasks or files.sparkSession.sparkContext.defaultParallelism)
    return _confirmed(_hits(spread, window, _ranged(root)), base)


def _ranged(root: str) -> Callable[[str, int, int], bytes]:
    def read(path: str, at: int, length: int) -> bytes:
        place, base = open_store(root)
        with place.open_input_file(f"{base}/{path}") as source:
            return source.read_at(length, at)

    return read


def flag_zero(blocks: DataFrame) -> DataFrame:
    """Adds ``is_zero``: every byte of the block is zero. ``data`` is text or binary."""
    return blocks.withColumn("is_zero", F.col("data") == _zeros(blocks))


def _zeros(blocks: DataFrame) -> Column:
    zeros = F.repeat(F.lit("\0"), F.col("size").cast("int"))
    return zeros.cast("binary") if dict(blocks.dtypes)["data"] == "binary" else zeros


def find_holes(blocks: DataFrame, keys: list[str], block: int, min_hole: int = 4096) -> DataFrame:
    """Holes: maximal runs of zero blocks, at least ``min_hole`` bytes: offset, length."""
    zero = flag_zero(blocks).where("is_zero")
    found = runs(zero, keys, "block_index", "size")
    return found.where(F.col("size") >= min_hole).select(
        *keys, (F.col("first") * block).alias("offset"), F.col("size").alias("length")
    )


def sparse_summary(
    blocks: DataFrame, keys: list[str], block: int, min_hole: int = 4096, files: DataFrame | None = None
) -> DataFrame:
    """Per file: logical size, hole bytes, written bytes, holes, ratio of holes. Empty files have a row if ``files`` names them."""
    whole = for_all_files(blocks.groupBy(*keys).agg(F.sum("size").alias("logical_size")), files, keys, logical_size=0)
    holes = find_holes(blocks, keys, block, min_hole).groupBy(*keys).agg(
        F.sum("length").alias("space_saved"), F.count("*").alias("holes")
    )
    out = whole.join(holes, keys, "left").na.fill(0, ["space_saved", "holes"])
    return out.select(
        *keys,
        "logical_size",
        "space_saved",
        (F.col("logical_size") - F.col("space_saved")).alias("bytes_written"),
        "holes",
        ratio("space_saved", "logical_size").alias("sparse_ratio"),
    )


def with_sparse_flag(df: DataFrame) -> DataFrame:
    """Adds allocated bytes (512 per ``st_blocks``), likely_sparse and sparse_ratio."""
    allocated = F.col("st_blocks") * 512
    return df.select(
        "*",
        allocated.alias("allocated"),
        (allocated < F.greatest(F.col("size") - 4096, F.lit(0))).alias("likely_sparse"),
        F.when(F.col("size") > 0, F.greatest(F.lit(1.0) - ratio(allocated, "size"), F.lit(0.0)))
        .otherwise(F.lit(0.0))
        .alias("sparse_ratio"),
    )


#: Bytes written before each compressed block to hold its length.
FRAME_BYTES = 4


def _compressor(codec: str, level: int):
    if codec == "zlib":
        return lambda data: len(zlib.compress(data, level))
    if codec == "zstd":
        import zstandard

        made = zstandard.ZstdCompressor(level=level)
        return lambda data: len(made.compress(data))
    raise ValueError(f"unknown codec {codec!r}")


def measure_compression(blocks: DataFrame, codec: str = "zlib", level: int = 3) -> DataFrame:
    """Blocks with ``compressed_size`` (frame included) in place of their data."""
    rest = [c for c in blocks.columns if c != "data"]

    @F.pandas_udf(LongType())
    def compressed(data: pd.Series) -> pd.Series:
        size = _compressor(codec, level)
        return data.map(lambda v: size(v.encode() if isinstance(v, str) else bytes(v)) + FRAME_BYTES)

    return blocks.select(*rest, compressed("data").alias("compressed_size"))


def compression_stats(measured: DataFrame, by: list[Column | str]) -> DataFrame:
    """Original and compressed bytes, ratio and saved percent per group (extension, directory)."""
    sums = measured.groupBy(*by).agg(
        F.sum("size").alias("original_size"), F.sum("compressed_size").alias("compressed_size")
    )
    r = ratio("compressed_size", "original_size")
    return sums.select(
        "*",
        r.alias("ratio"),
        F.when(F.col("original_size") > 0, (F.lit(1.0) - r) * 100.0).otherwise(F.lit(0.0)).alias("saved_percent"),
    )


def partial_checksum(content: Column | str, n: Column | str) -> Column:
    """sha256 of the first ``n`` bytes."""
    c = F.col(content) if isinstance(content, str) else content
    return F.sha2(F.substring(c, F.lit(1), (F.col(n) if isinstance(n, str) else n).cast("int")), 256)


def resume_actions(states: DataFrame, source: DataFrame, partial: DataFrame) -> DataFrame:
    """What to do with each interrupted file, and from which offset.

    states (path, size, bytes_written, partial_checksum), source (path, size), partial (path,
    checksum of the destination's first bytes_written bytes). A source of another size is an
    error; a destination that does not match its checksum is restarted; else it is resumed.
    """
    joined = states.join(source.select("path", F.col("size").alias("source_size")), "path", "left").join(
        partial.select("path", "checksum"), "path", "left"
    )
    differs = F.col("partial_checksum").isNotNull() & ~F.col("partial_checksum").eqNullSafe(F.col("checksum"))
    action = (
        F.when(F.col("source_size").isNull(), "source_missing")
        .when(F.col("source_size") != F.col("size"), "source_changed")
        .when(F.col("bytes_written") == 0, "start")
        .when(differs, "restart")
        .otherwise("resume")
    )
    offset = F.when(F.col("action") == "resume", F.col("bytes_written")).otherwise(F.lit(0))
    ok = F.col("action").isin("start", "restart", "resume")
    return joined.withColumn("action", action).select(
        "path",
        "action",
        F.when(ok, offset).cast("bigint").alias("offset"),
        F.when(ok, F.col("size") - offset).cast("bigint").alias("remaining"),
    )


#: First bytes of content written by :func:`encrypt_content`.
MAGIC = b"QSENC\x01"


def encrypt_content(df: DataFrame, key: Column, content: str = "content") -> DataFrame:
    """``content`` replaced by MAGIC + AES-GCM ciphertext; ``key`` is a 16, 24 or 32 byte
    binary column expression, so that it can come from a secret table."""
    sealed = F.concat(F.lit(MAGIC), F.aes_encrypt(F.col(content).cast("binary"), key, F.lit("GCM")))
    return df.withColumn(content, sealed)


def decrypt_content(df: DataFrame, key: Column, content: str = "content") -> DataFrame:
    """The reverse; content without the header is null."""
    body = F.substring(F.col(content), len(MAGIC) + 1, 2**31 - 1)
    return df.withColumn(
        content, F.when(is_encrypted(content), F.try_aes_decrypt(body, key, F.lit("GCM")))
    )


def is_encrypted(content: Column | str) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.substring(c, 1, len(MAGIC)) == F.lit(MAGIC)


def find_encrypted(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose content carries the header."""
    return df.where(is_encrypted(content))


def encryption_overhead(plain: Column, sealed: Column) -> Column:
    """Growth in percent; 0 for empty input."""
    return F.when(plain > 0, (sealed.cast("double") / plain - 1.0) * 100.0).otherwise(F.lit(0.0))
