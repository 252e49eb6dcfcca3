"""Row filters over an inventory. All of them are plain predicates, so Catalyst can merge
them and push the ones on stored columns into the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import paths


def filter_size(df: DataFrame, minimum: int | None = None, maximum: int | None = None) -> DataFrame:
    """Both bounds are inclusive."""
    if minimum is not None:
        df = df.where(F.col("size") >= minimum)
    if maximum is not None:
        df = df.where(F.col("size") <= maximum)
    return df


def filter_globs(
    df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, path: str = "path"
) -> DataFrame:
    """Kept: rows matching any include glob (or no include given) and no exclude glob."""
    if include:
        df = df.where(paths.matches_any(path, include))
    if exclude:
        df = df.where(~paths.matches_any(path, exclude))
    return df


def filter_hidden(df: DataFrame, path: str = "path") -> DataFrame:
    """Drops entries whose own name starts with a dot; what lies below stays."""
    return df.where(~paths.is_hidden(path))


def filter_depth(df: DataFrame, limit: int, path: str = "path") -> DataFrame:
    return df.where(paths.depth(path) <= limit)
