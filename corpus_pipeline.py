"""A corpus pipeline of the operators in ``quayside.llm``, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last
return the columns of documents, in their order and whatever their names; rows that stay are as they were, but for the
text (and n_chars) in line dedup. Null ids, languages and sources are values like others. Empty tables give empty results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import decontamination, line_dedup, packing, quality_rules, shingle_join
from quayside.llm.common import fresh, stored, table
from quayside.llm.queries import small_batches, tokenizer_path
from quayside.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the label model believes good.

    Null, empty and blank texts have no words and go; repeated rows are judged alike; texts of any length are judged whole."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; n_chars follows the text. Documents that consist of nothing else go.

    A null text stays null, an empty one is an empty line that is no run by itself; rows of equal id and text are one document and treated alike; of ties
    the document with the least id has the first copy."""
    facts = fresh(docs, "_facts")
    cleaned = line_dedup.delete_copies(docs, facts=facts)
    whole = (F.col(f"{facts}.n_deleted") > 0) & (F.col(f"{facts}.n_deleted") == F.col(f"{facts}.n_lines"))
    cleaned = cleaned.where(~whole).drop(facts)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, null ids last.

    Null and empty texts are linked with nothing and stay; of repeated rows one stays; texts below five words are linked if they are equal."""
    small_batches(spark)
    return shingle_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item (nor a whole shorter item).

    Null and empty texts hold none and stay, repeated rows are treated alike; null items and items without words match nothing."""
    small_batches(spark)
    return decontamination.drop_hit(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and place, for every document.

    A null or empty text is one piece with the end id alone; repeated rows are packed each; long texts are cut, never dropped."""
    small_batches(spark)
    return packing.pack(stored(packing.pieces(docs, tokenizer_path())))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("decontamination", benchmark),
    ("packing", pack),
]

#: The label model and the packing are no SQL; tests hold the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
