"""Maximal runs of consecutive integer indices (gaps and islands) on two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], index: str, size: str, bucket: int = 4096) -> DataFrame:
    """Runs of consecutive ``index`` values per key: keys, first, last, n, size.

    Level one works inside blocks of ``bucket`` indices, so no task ever holds more than
    ``bucket`` rows of one key's window however large a single file is. Only runs that touch
    a block border take part in level two, at most two per block.
    """
    bucketed = df.select(*keys, F.col(index).alias("_i"), F.col(size).alias("_size")).withColumn(
        "_bucket", F.floor(F.col("_i") / bucket)
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_i")
    local = (
        bucketed.withColumn("_island", F.col("_i") - F.row_number().over(inside))
        .groupBy(*keys, "_bucket", "_island")
        .agg(
            F.min("_i").alias("first"),
            F.max("_i").alias("last"),
            F.sum("_size").alias("size"),
        )
        .drop("_island")
    )
    at_border = (F.col("first") % bucket == 0) | (F.col("last") % bucket == bucket - 1)
    inner = local.where(~at_border).select(*keys, "first", "last", "size")
    across = Window.partitionBy(*keys).orderBy("first")
    opens = F.when(F.lag("last").over(across) == F.col("first") - 1, 0).otherwise(1)
    border = (
        local.where(at_border)
        .withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(across))
        .groupBy(*keys, "_island")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"))
        .drop("_island")
    )
    return inner.unionByName(border).withColumn("n", F.col("last") - F.col("first") + 1)
