"""One query per operator over the whole of its table, and SQL oracles where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import (
    code_compression, decontamination, html_extract, line_dedup, lm_bloom, oracles, packing, pii, piece_codec, quality_rules, sharding,
    shingle_join, suffix_dedup, whitening,
)
from quayside.llm.common import stored, table

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers some hundred at a time, so that long ones do not fill their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Key of the registered query; in production the caller keeps its own.
PII_KEY = b"a key of the registered query, not a secret"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op2_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stored(packing.pieces(documents(spark, sf_dir), tokenizer_path())))


def op4_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.delete_copies(documents(spark, sf_dir).select("doc_id", "text"), facts="facts")
    kept = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id", "facts.*", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256")
    )


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score(documents(spark, sf_dir))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontamination.build_index(documents(spark, sf_dir))
    hits = decontamination.search(index, table(spark, sf_dir, "benchmark"), size=10, slop=1)
    return decontamination.verdicts(hits)


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    narrow = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    none = F.lit(None).cast("int").alias("grown_shard")
    return sharding.shuffle(narrow, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.FACTS, "base_failed", "kept", "p_good"
    )


def op11_characteristic_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(documents(spark, sf_dir), tokenizer_path(PIECE_MODEL))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_adaptive_prefix_join": op2_adaptive_prefix_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_blocks": op4_line_blocks,
    "op5_suffix_family": op5_suffix_family,
    "op6_line_runs": op6_line_runs,
    "op7_bloom_lm": op7_bloom_lm,
    "op8_positional_index": op8_positional_index,
    "op9_hypergeometric_shards": op9_hypergeometric_shards,
    "op10_quality_rules": op10_quality_rules,
    "op11_characteristic_whitening": op11_characteristic_whitening,
    "op12_merge_rounds": op12_merge_rounds,
    "op13_pivot_codes": op13_pivot_codes,
}

ORACLES: dict[str, str] = {
    "op2_adaptive_prefix_join": oracles.SHINGLE_JOIN,
    "op5_suffix_family": oracles.REPEATS,
    "op6_line_runs": oracles.LINE_RUNS,
    "op8_positional_index": oracles.DECONTAMINATION,
    "op13_pivot_codes": oracles.PIVOT_CODES,
}
