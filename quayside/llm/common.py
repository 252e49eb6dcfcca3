"""What the corpus operators share: reading tables, words, shared-folder tables, and fresh column names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayside.session import shared_dir

#: Fixed value: the white space that separates words, as characters and as a class for Java patterns.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the folder all executors share, and read from there.

    Later readers neither compute it again nor depend on an executor that may be lost. The
    folder is ``spark.checkpoint.dir``; its owner clears it, as with checkpoints."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_at(df))


def stored_at(df: DataFrame, **options: str) -> str:
    """``df`` written like that, and where; tasks may open it by themselves."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return path


def range_bits_of(docs: DataFrame, least: int = 10, rows: int = 2000) -> int:
    """Bits of hash ranges that leave a range the tokens of about ``rows`` documents; footers have the count."""
    return max(least, min(24, (max(1, docs.count()) // rows).bit_length()))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def relaxed(schema: StructType) -> StructType:
    """``schema`` with nulls allowed everywhere, as Arrow tables declare it."""
    text = schema.json()
    for name in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{name}":false', f'"{name}":true')
    return StructType.fromJson(json.loads(text))


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null or blank texts. Evaluates ``text`` twice."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_CLASS + "+")
    )


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` changes other letters, too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
