"""Statistics of a stored Parquet manifest from the footers of its files, and look-ups that open the matching row groups only.

Footers are read by tasks, a row per row group: how many entries, the least and the greatest path, and how many bytes. Counts come from those rows
alone; a look-up keeps the row groups whose range can hold what is asked for and reads just these. Manifests are sorted by
path within each file, so that is one or two groups of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quayside.session import persist_shared
from quayside.sources.objects import list_objects
from quayside.sources.stores import open_store

FOOTERS = "root string, file string, row_group int, entries bigint, first string, last string, bytes bigint, file_bytes bigint"


def manifest_footers(spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """A row per row group (one without a group per empty file); ``first`` and ``last`` are null where a footer does not tell."""
    files = list_objects(spark, path).where(F.col("path").endswith(".parquet") & ~F.col("path").rlike(r"(^|/)[._]")).select("root", "path", "size")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "file", "row_group", "entries", "first", "last", "bytes", "file_bytes"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for root, file, size in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "size"))):
                place, base = open_store(root)
                with place.open_input_file(f"{base}/{file}") as source:
                    footer = pq.read_metadata(source)
                columns = [i for i in range(footer.num_columns) if footer.schema.column(i).path == key]
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    told = group.column(columns[0]).statistics if columns else None
                    low, high = (told.min, told.max) if told is not None and told.has_min_max else (None, None)
                    rows.append((root, file, g, group.num_rows, low, high, group.total_byte_size, size))
                if not footer.num_row_groups:
                    rows.append((root, file, None, 0, None, None, 0, size))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(read, FOOTERS)


def footer_totals(footers: DataFrame) -> DataFrame:
    """One row: files, row groups, entries, least and greatest path."""
    return footers.agg(
        F.countDistinct("root", "file").alias("files"), F.count("row_group").alias("row_groups"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )


def entries_between(spark: SparkSession, path: str, low: str, high: str, footers: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Entries with ``low <= path <= high``, from the row groups that can hold them.

    ``footers`` may be the stored rows of :func:`manifest_footers`, so that many look-ups read the footers once."""
    from quayside.sources.manifests import read_manifest

    schema = read_manifest(spark, path).schema
    target = to_arrow_schema(schema)
    known = persist_shared(manifest_footers(spark, path, key)) if footers is None else footers
    groups = matching_groups(known, low, high)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, file, group in zip(*(batch.column(c).to_pylist() for c in ("root", "file", "row_group"))):
                place, base = open_store(root)
                with place.open_input_file(f"{base}/{file}") as source:
                    for rows in pq.ParquetFile(source).iter_batches(row_groups=[group]):
                        wanted = rows.filter(pc.and_(pc.greater_equal(rows.column(key), low), pc.less_equal(rows.column(key), high)))
                        columns = [
                            wanted.column(f.name).cast(f.type) if f.name in wanted.schema.names else pa.nulls(len(wanted), f.type) for f in target
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=target.names)

    spread = groups.select("root", "file", "row_group").repartition(spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(read, schema)


def matching_groups(footers: DataFrame, low: str, high: str) -> DataFrame:
    """Row groups that can hold paths from ``low`` to ``high``; those whose footer does not tell always can."""
    can = F.coalesce((F.col("last") >= low) & (F.col("first") <= high), F.lit(True))
    return footers.where(F.col("row_group").isNotNull() & (F.col("entries") > 0) & can)


def find_path(spark: SparkSession, path: str, wanted: str, footers: DataFrame | None = None) -> DataFrame:
    """The entries of one path."""
    return entries_between(spark, path, wanted, wanted, footers)
