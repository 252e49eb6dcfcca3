"""Totals, orderings and set operations over inventories (path, size, mtime, ...)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import paths, sizes
from quayside.operators.ordered import with_position


def scan_totals(df: DataFrame) -> DataFrame:
    """Files, directories and bytes of files; ``is_dir`` is optional."""
    is_dir = F.col("is_dir") if "is_dir" in df.columns else F.lit(False)
    return df.agg(
        F.count_if(~is_dir).alias("file_count"),
        F.count_if(is_dir).alias("dir_count"),
        F.coalesce(F.sum(F.when(~is_dir, F.col("size"))), F.lit(0)).alias("total_size"),
    )


def dir_usage(df: DataFrame) -> DataFrame:
    """File count and bytes below every directory.

    Files are first summed per parent directory; only those sums are repeated for the
    directories above, so the explode does not grow with the number of files.
    """
    own = df.groupBy(paths.parent("path").alias("parent")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )
    above = own.select(
        F.explode(paths.ancestors(F.concat("parent", F.lit("/")))).alias("directory"), "files", "bytes"
    ).where(F.col("directory") != "")
    return above.groupBy("directory").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def category_summary(df: DataFrame) -> DataFrame:
    """Count and bytes per size class."""
    return df.groupBy(sizes.size_category("size").alias("category")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


def split_by_size(df: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Rows below the threshold and the others."""
    return df.where(F.col("size") < threshold), df.where(F.col("size") >= threshold)


def split_summary(df: DataFrame, threshold: int) -> DataFrame:
    return df.groupBy(sizes.size_threshold_class("size", threshold).alias("side")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


def path_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct paths and duplicate rows; the approximate form needs no shuffle of paths."""
    if approximate:
        return df.agg(
            F.count("path").alias("rows"), F.approx_count_distinct("path", 0.01).alias("distinct_paths")
        ).withColumn("duplicates", F.greatest(F.col("rows") - F.col("distinct_paths"), F.lit(0)))
    per_path = df.groupBy("path").agg(F.count("*").alias("n"))
    return per_path.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_paths")
    ).withColumn("duplicates", F.col("rows") - F.col("distinct_paths"))


def duplicate_paths(df: DataFrame) -> DataFrame:
    return df.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def dedup_paths(df: DataFrame) -> DataFrame:
    """One row per path; of several the one that is greatest by its other columns, in their order."""
    rest = [c for c in df.columns if c != "path"]
    if not rest:
        return df.distinct()
    return df.groupBy("path").agg(F.max(F.struct(*rest)).alias("_r")).select("path", "_r.*").select(*df.columns)


def sorted_paths(df: DataFrame) -> DataFrame:
    """All distinct paths in byte order."""
    return df.select("path").distinct().orderBy("path")


def paths_in(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose path is in ``members``."""
    return df.join(members.select("path").distinct(), "path", "left_semi")


ORDERINGS = {
    "smallest": [F.asc, "size"],
    "largest": [F.desc, "size"],
    "newest": [F.desc, "mtime"],
    "oldest": [F.asc, "mtime"],
}


def order_files(df: DataFrame, strategy: str = "smallest") -> DataFrame:
    """``smallest``, ``largest``, ``newest``, ``oldest`` first, ties by path; ``none`` keeps the rows as they are."""
    if strategy == "none":
        return df
    direction, column = ORDERINGS[strategy]
    return df.orderBy(direction(column), F.asc("path"))


def next_tasks(df: DataFrame, k: int) -> DataFrame:
    """The next ``k`` files to copy: small classes first, then by size."""
    return (
        df.withColumn("priority", sizes.task_priority("size"))
        .orderBy("priority", "size", "path")
        .limit(k)
    )


def paginate(df: DataFrame, order: list, page: int = 1, per_page: int = 20) -> tuple[DataFrame, dict]:
    """Rows of one page (counted from 1) and its header.

    A sorted limit keeps all rows up to the page's end in one task, so pages are picked by the rows' positions, which
    are worked out in parallel.
    """
    if page < 1:
        raise ValueError("pages are counted from 1")
    total, first = df.count(), (page - 1) * per_page
    placed = with_position(df, [], order, "_position")
    rows = placed.where(F.col("_position").between(first, first + per_page - 1)).orderBy("_position").drop("_position")
    header = {
        "total": total,
        "page": page,
        "per_page": per_page,
        "total_pages": math.ceil(total / per_page) if per_page > 0 else 0,
    }
    return rows, header


def pick(df: DataFrame, ids: list, id_column: str = "id") -> DataFrame:
    """Rows of the given ids in the given order (``position``); unknown ids are dropped."""
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    wanted = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(i).cast(kind) for i in ids])).alias("position", id_column)
    )
    # the list was written by the caller: one literal per row
    return df.join(F.broadcast(wanted), id_column).select("position", *df.columns)


def latest_first(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def manifest_head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("path").limit(n)
