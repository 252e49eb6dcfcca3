"""Content hashes and block checksums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from quayside.functions.paths import _col

_REGISTERED: dict[str, Callable[[bytes], str]] = {}


def register_hash(name: str, digest: Callable[[bytes], str]) -> None:
    """Makes ``digest`` (bytes to text) usable as an algorithm of :func:`content_hash`."""
    _REGISTERED[name] = digest


def _package_digest(algorithm: str) -> Callable[[bytes], str]:
    if algorithm in ("xxhash64", "xxh3_64", "xxh3_128"):
        try:
            import xxhash
        except ImportError as e:
            raise ValueError(f"{algorithm} needs the optional package xxhash") from e
        make = {"xxhash64": xxhash.xxh64, "xxh3_64": xxhash.xxh3_64, "xxh3_128": xxhash.xxh3_128}
        maker = make[algorithm]
        return lambda data: maker(data, seed=0).hexdigest()
    if algorithm == "blake3":
        try:
            import blake3
        except ImportError as e:
            raise ValueError("blake3 needs the optional package blake3") from e
        return lambda data: blake3.blake3(data).hexdigest()
    raise ValueError(f"unknown hash algorithm {algorithm!r}")


def incremental_digest(algorithm: str):
    """A hasher with update() and hexdigest(), for bytes that arrive in pieces."""
    if algorithm == "sha256":
        import hashlib

        return hashlib.sha256()
    _package_digest(algorithm)
    if algorithm == "blake3":
        import blake3

        return blake3.blake3()
    import xxhash

    return {"xxhash64": xxhash.xxh64, "xxh3_64": xxhash.xxh3_64, "xxh3_128": xxhash.xxh3_128}[algorithm]()


def content_hash(content: Column | str, algorithm: str = "xxh3_128") -> Column:
    """Lowercase hex hash of a binary or text column.

    sha256 is Spark's own and stays in the JVM. The xxhash family (seed 0) and blake3 run as
    Arrow batches: Spark's ``xxhash64`` has another seed. ``xxh3_128`` and ``xxh3_64`` are
    different hashes and never compare equal.
    """
    if algorithm == "sha256":
        return F.sha2(_col(content), 256)
    digest = _REGISTERED.get(algorithm) or _package_digest(algorithm)

    @F.arrow_udf(StringType())
    def apply(values: pa.Array) -> pa.Array:
        # bytes of one value at a time: a batch is never copied as a whole
        return pa.array((digest(v.as_buffer().to_pybytes()) if v.is_valid else None for v in values), pa.string())

    return apply(_col(content))


def hash_content(df: DataFrame, content: str = "content", algorithm: str = "xxh3_128") -> DataFrame:
    """Adds algorithm and hash."""
    return df.select("*", F.lit(algorithm).alias("algorithm"), content_hash(content, algorithm).alias("hash"))


def quick_hash(content: Column | str) -> Column:
    """64-bit change hash: Spark's xxhash64. Good for equality within this library only."""
    return F.xxhash64(_col(content))


def weak_checksums(values: pa.Array, step: int = 1 << 20) -> np.ndarray:
    """Weak checksums of binary or text values, from running sums over about ``step`` bytes at a time."""
    large = values.cast(pa.large_binary())
    ends = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    raw = np.frombuffer(large.buffers()[2], dtype=np.uint8) if large.buffers()[2] else np.zeros(0, dtype=np.uint8)
    out, at = np.zeros(len(large), dtype=np.int64), 0
    while at < len(large):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + step, side="right")) - 1)
        piece = raw[ends[at] : ends[upto]].astype(np.uint64)
        plain, placed = np.zeros((2, len(piece) + 1), dtype=np.uint64)
        np.cumsum(piece, out=plain[1:])
        np.cumsum(piece * np.arange(len(piece), dtype=np.uint64), out=placed[1:])
        begin, end = ends[at:upto] - ends[at], ends[at + 1 : upto + 1] - ends[at]
        a = plain[end] - plain[begin]
        b = end.astype(np.uint64) * a - (placed[end] - placed[begin])
        out[at:upto] = (((b << np.uint64(16)) & np.uint64(0xFFFFFFFF)) | (a & np.uint64(0xFFFF))).astype(np.int64)
        at = upto
    return out


def weak_checksum_bytes(data: bytes) -> int:
    """a = sum of bytes, b = sum of (n - i) * byte i; ``b << 16 | a & 0xffff`` in 32 bits."""
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    a = int(values.sum())
    b = int((values * np.arange(len(values), 0, -1, dtype=np.uint64)).sum())
    return ((b << 16) & 0xFFFFFFFF) | (a & 0xFFFF)


@F.arrow_udf(LongType())
def weak_checksum(data: pa.Array) -> pa.Array:
    """Weak block checksum (unsigned 32 bits, held in a bigint)."""
    return pa.array(weak_checksums(data), mask=data.is_null().to_numpy(zero_copy_only=False))


def hash_to_bigint(hex_hash: Column | str) -> Column:
    """First 64 bits of a hex digest as a signed bigint with the same bits."""
    return F.conv(F.substring(_col(hex_hash), 1, 16), 16, -10).cast("bigint")


def rotate_left(value: Column, bits: Column) -> Column:
    """64-bit rotation; ``bits`` is 0 to 63."""
    turned = F.call_function("shiftleft", value, bits).bitwiseOR(
        F.call_function("shiftrightunsigned", value, F.lit(64) - bits)
    )
    return F.when(bits == 0, value).otherwise(turned)


def xor_digests(hex_digests: Column | str, width: int = 64) -> Column:
    """Aggregate: XOR of hex digests of ``width`` digits, as hex. Sixteen digits at a time are one number for
    ``bit_xor``, which Spark combines before the shuffle."""
    digest = _col(hex_digests)
    parts = [F.conv(F.substring(digest, i, 16), 16, -10).cast("bigint") for i in range(1, width, 16)]
    return F.concat(*[F.lower(F.lpad(F.hex(F.bit_xor(p)), 16, "0")) for p in parts])
