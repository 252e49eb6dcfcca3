"""Size classes, size and bandwidth texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.paths import _col

KIB, MIB, GIB, TIB = 1024, 1024**2, 1024**3, 1024**4

# Upper bounds (exclusive) of the size classes, smallest first.
SIZE_CLASSES = [("tiny", 4 * KIB), ("small", MIB), ("medium", 100 * MIB), ("large", GIB)]
LARGEST_CLASS = "huge"


def _by_class(size: Column, values: list, last) -> Column:
    out = None
    for (_, bound), value in zip(SIZE_CLASSES, values):
        test = size < bound
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(last)


def size_category(size: Column | str) -> Column:
    return _by_class(_col(size), [name for name, _ in SIZE_CLASSES], LARGEST_CLASS)


def task_priority(size: Column | str) -> Column:
    """0 for the smallest class (copied first) to 4 for the largest."""
    n = len(SIZE_CLASSES)
    return _by_class(_col(size), list(range(n)), n)


def size_threshold_class(size: Column | str, threshold: int) -> Column:
    return F.when(_col(size) < threshold, "below").otherwise("at_or_above")


# SQL text of the parsers, used both for columns and for the registered SQL functions.
_NUMBER = r"\\A[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(E[+-]?[0-9]+)?\\z"
_TO_BYTES = """CASE WHEN NOT ({num}) RLIKE '%s' THEN NULL
  WHEN CAST({num} AS DOUBLE) * {factor} >= 9.2233720368547758E18D THEN 9223372036854775807L
  WHEN CAST({num} AS DOUBLE) < 0 THEN 0L
  ELSE CAST(floor(CAST({num} AS DOUBLE) * {factor}) AS BIGINT) END""" % _NUMBER


def parse_size_sql(text: str) -> str:
    """Bytes of a size text such as ``1.5G``, ``10 kb`` or ``7``; null if malformed.

    The unit may repeat its letters (``1KB``), is case-insensitive and a power of 1024.
    """
    t = f"upper(trim({text}))"
    units = [("T", TIB), ("G", GIB), ("M", MIB), ("K", KIB)]
    num = f"trim(regexp_replace({t}, CASE " + " ".join(
        f"WHEN {t} RLIKE '{u}B?\\\\z' THEN '[{u}B]+\\\\z'" for u, _ in units
    ) + " ELSE 'B+\\\\z' END, ''))"
    factor = "(CASE " + " ".join(
        f"WHEN {t} RLIKE '{u}B?\\\\z' THEN {f}D" for u, f in units
    ) + " ELSE 1D END)"
    return _TO_BYTES.format(num=num, factor=factor)


def parse_bandwidth_sql(text: str) -> str:
    """Bytes per second of ``100M``, ``1GB``, ``500k`` or ``1024``; null if malformed.

    Unlike sizes there is no tera unit and no bare ``B``.
    """
    t = f"upper(trim({text}))"
    units = [("G", GIB), ("M", MIB), ("K", KIB)]
    num = f"trim(regexp_replace({t}, CASE " + " ".join(
        f"WHEN {t} RLIKE '{u}B?\\\\z' THEN '{u}*({u}B)*\\\\z'" for u, _ in units
    ) + " ELSE '(?!)' END, ''))"
    factor = "(CASE " + " ".join(
        f"WHEN {t} RLIKE '{u}B?\\\\z' THEN {f}D" for u, f in units
    ) + " ELSE 1D END)"
    return _TO_BYTES.format(num=num, factor=factor)


def parse_size(column: str) -> Column:
    return F.expr(parse_size_sql(column))


def parse_bandwidth(column: str, positive_only: bool = False) -> Column:
    """``positive_only`` gives null instead of 0, as a throttle of 0 is no throttle."""
    rate = F.expr(parse_bandwidth_sql(column))
    return F.when(rate > 0, rate) if positive_only else rate
