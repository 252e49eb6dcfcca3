"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(v, l) for every end of the links (a, b): l is the least end of its component.

    A round takes the least label among a node and its neighbours, then the label of that label, so the
    number of rounds grows with the logarithm of the longest path. Labels are stored each round; nothing but the
    number of changes comes to the driver. Links to oneself are fine; an empty table has no components.
    """
    ends = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(ends.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("l")))
    while True:
        near = ends.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("l").alias("m"))
        lower = stored(
            labels.join(near, F.col("v") == F.col("a"))
            .select("v", F.least("l", "m").alias("l"), (F.col("m") < F.col("l")).alias("changed"))
        )
        if not lower.where("changed").limit(1).count():
            return labels
        of = lower.select(F.col("v").alias("x"), F.col("l").alias("y"))
        labels = stored(lower.join(of, F.col("l") == F.col("x")).select("v", F.col("y").alias("l")))
