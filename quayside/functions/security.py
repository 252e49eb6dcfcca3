"""Unix mode bits and access masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.paths import _col


def _bit(mode: Column, value: int) -> Column:
    return mode.bitwiseAND(F.lit(value).cast(mode_type)) != 0


mode_type = "bigint"


def decode_mode(df: DataFrame, mode: str = "permissions") -> DataFrame:
    """Adds setuid, setgid, sticky, the ``rwxr-x---`` text and world_writable."""
    m = F.col(mode).cast(mode_type)
    letters = [
        F.when(_bit(m, 1 << (8 - i)), "rwx"[i % 3]).otherwise("-") for i in range(9)
    ]
    return df.select(
        "*",
        _bit(m, 0o4000).alias("setuid"),
        _bit(m, 0o2000).alias("setgid"),
        _bit(m, 0o1000).alias("sticky"),
        F.concat(*letters).alias("rwx"),
        _bit(m, 0o0002).alias("world_writable"),
    )


# Access-mask bits and the right each group of bits grants.
FULL_CONTROL = 0x001F01FF
RIGHTS = [
    ("Read", [0x80000000, 0x00000001]),
    ("Write", [0x40000000, 0x00000002]),
    ("Execute", [0x20000000, 0x00000020]),
    ("Delete", [0x00010000]),
    ("Change Permissions", [0x00040000]),
    ("Take Ownership", [0x00080000]),
]


def describe_mask(mask: Column | str) -> Column:
    """Array of the rights in an access mask; full control is reported alone."""
    m = _col(mask).cast("bigint")
    rights = [F.when(m.bitwiseAND(F.lit(sum(bits)).cast("bigint")) != 0, name) for name, bits in RIGHTS]
    full = m.bitwiseAND(F.lit(FULL_CONTROL).cast("bigint")) == FULL_CONTROL
    return F.when(full, F.array(F.lit("Full Control"))).otherwise(F.array_compact(F.array(*rights)))


def acl_rights(df: DataFrame, entries: str = "entries") -> DataFrame:
    """One row per access-control entry with its rights, from an array of
    struct(ace_type, access_mask, sid)."""
    rest = [c for c in df.columns if c != entries]
    return df.select(*rest, F.explode(entries).alias("_ace")).select(
        *rest,
        "_ace.ace_type",
        "_ace.sid",
        "_ace.access_mask",
        describe_mask(F.col("_ace.access_mask")).alias("rights"),
    )
