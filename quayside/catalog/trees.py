"""Contents of the given tables as real files below the shared folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.catalog.tables import Tables
from quayside.sources import copying
from quayside.streaming.live import new_folder


def mounted(folder: str) -> str:
    """Path of a folder for plain file access."""
    path = re.sub(r"\Afile:(//)?", "", folder)
    if "://" in path:
        raise RuntimeError(f"files need a shared folder that is mounted, not {folder}")
    return path


def tree(t: Tables, contents: DataFrame | None = None, path: str = "path") -> str:
    """Contents (path, text), those of the documents if none are given, as a tree of files; empty ones included."""
    root = mounted(new_folder(t.spark, "tree"))
    rows = (t.content() if contents is None else contents).select(F.expr(path).alias("path"), F.col("text").alias("content"))
    copying.write_files(rows, root).agg(F.sum("bytes")).collect()
    return root


def sizes(contents: DataFrame) -> DataFrame:
    return contents.select("path", F.octet_length("text").cast("bigint").alias("size"))
