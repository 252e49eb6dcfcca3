"""Tables out of the text that transfer tools print (one line per row, column ``value``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.rates import ratio


#: Date, time, size and object address; anything after them is not looked at.
LISTING = r"\A\s*(\S+)\s+(\S+)\s+\+?([0-9]+)\s+s3://[^/\s]*/?(\S*)"


def parse_listing(lines: DataFrame) -> DataFrame:
    """Objects from ``date time size s3://bucket/key`` lines; other lines are left out.

    ``last_modified`` holds the line's date and time, in UTC.
    """
    part = lambda i: F.regexp_extract("value", LISTING, i)
    stamp = F.concat_ws(" ", part(1), part(2))
    return lines.where(F.col("value").rlike(LISTING)).select(
        part(4).alias("key"),
        part(3).try_cast("bigint").alias("size"),
        F.unix_seconds(F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd HH:mm:ss"))).alias("last_modified"),
    )


def log_stats(lines: DataFrame) -> DataFrame:
    """Counts of a bulk tool's output: failed, else uploaded, else downloaded lines."""
    v = F.col("value")
    line_class = (
        F.when(v.contains("ERROR") | v.contains("error"), "failed")
        .when(v.startswith("upload") | v.contains(" -> s3://"), "uploaded")
        .when(v.startswith("download") | v.contains("s3://"), "downloaded")
    )
    classed = lines.select(line_class.alias("c"))
    return classed.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("c") == "uploaded").alias("uploaded"),
        F.count_if(F.col("c") == "downloaded").alias("downloaded"),
        F.count_if(F.col("c") == "failed").alias("failed"),
    )


def sync_log_stats(lines: DataFrame, seconds: float | None = None) -> DataFrame:
    """Bytes after the words ``sent`` and ``received`` of summary lines, and file lines.

    Any non-empty line that does not start with ``sending``, ``sent`` or ``total`` counts as
    a file, as the tool prints one per file. With ``seconds`` a throughput is added.
    """
    v = F.col("value")
    summary = v.contains("sent") & v.contains("bytes")
    # the number is checked after its word was found as a whole word
    found = F.regexp_extract_all(v, F.lit(r"(?:^|\s)(?:sent|received)(?=\s+([0-9,]*[0-9][0-9,]*)(?:\s|$))"), 1)
    numbers = F.transform(found, lambda n: F.regexp_replace(n, ",", "").try_cast("bigint"))
    line_bytes = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, n: a + F.coalesce(n, F.lit(0)))
    is_file = ~(v.startswith("sending") | v.startswith("sent") | v.startswith("total") | (v == ""))
    out = lines.agg(
        F.coalesce(F.sum(F.when(summary, line_bytes)), F.lit(0)).alias("bytes_transferred"),
        F.count_if(is_file).alias("files_transferred"),
    )
    if seconds is None:
        return out
    return out.withColumn("throughput", ratio("bytes_transferred", F.lit(seconds)))
