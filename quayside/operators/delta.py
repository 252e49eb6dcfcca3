"""Content deltas: which blocks of a new version the old one already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.hashing import hash_to_bigint, rotate_left
from quayside.operators.content import for_all_files
from quayside.operators.islands import runs
from quayside.session import persist_shared

SIGNATURE = ["path", "weak", "strong", "size"]


def match_chunks(new: DataFrame, base: DataFrame) -> DataFrame:
    """Every block signature of ``new`` with ``source_index``: the lowest base block of the
    same file with equal weak checksum, strong hash and size, or null.

    The base is reduced to one row per signature before the join, so that zero blocks or
    boilerplate cannot multiply; on the new side such blocks are a hot key, which adaptive execution splits. The base
    side and the matches are written once as narrow rows: whoever reads the matches again neither joins nor
    reads a content again.
    """
    lowest = persist_shared(base.groupBy(*SIGNATURE).agg(F.min("block_index").alias("source_index")))
    return persist_shared(new.join(lowest, SIGNATURE, "left"))


def delta_ops(matches: DataFrame, block: int, max_literal_blocks: int | None = None) -> DataFrame:
    """Delta instructions in (path, dest_offset) order: op, source_index, dest_offset, size, first_block, n_blocks.

    A matched block is a ``copy`` of its own; consecutive unmatched blocks become one
    ``insert``. Literal bytes are not gathered into the row - a literal may be as long as the
    file - but stay in the block rows ``first_block`` .. ``first_block + n_blocks - 1``.
    ``max_literal_blocks`` cuts long literals into several inserts with the same result.
    """
    copies = matches.where(F.col("source_index").isNotNull()).select(
        "path",
        F.lit("copy").alias("op"),
        "source_index",
        (F.col("block_index") * block).alias("dest_offset"),
        "size",
        F.col("block_index").alias("first_block"),
        F.lit(1).cast("bigint").alias("n_blocks"),
    )
    literal = runs(matches.where(F.col("source_index").isNull()), ["path"], "block_index", "size")
    if max_literal_blocks:
        pieces = literal.select(
            "path", "first", "last", "size", F.explode(F.sequence("first", "last", F.lit(max_literal_blocks))).alias("_at")
        )
        end = F.least(F.col("_at") + max_literal_blocks - 1, F.col("last"))
        # all blocks of a run but its last are full
        size = F.when(end == F.col("last"), F.col("size") - (F.col("_at") - F.col("first")) * block).otherwise(
            F.lit(max_literal_blocks * block)
        )
        literal = pieces.select(
            "path", F.col("_at").alias("first"), size.cast("bigint").alias("size"), (end - F.col("_at") + 1).alias("n")
        )
    inserts = literal.select(
        "path",
        F.lit("insert").alias("op"),
        F.lit(None).cast("bigint").alias("source_index"),
        (F.col("first") * block).alias("dest_offset"),
        "size",
        F.col("first").alias("first_block"),
        F.col("n").alias("n_blocks"),
    )
    return copies.unionByName(inserts)


def delta_ranges(ops: DataFrame, block: int, most: int = 64 << 20) -> DataFrame:
    """Instructions as byte ranges: (path, op, source_offset, dest_offset, size), none longer than ``most``.

    Copies that follow each other in both versions become one range. An ``insert`` is read from the new version, at the
    offset where it goes. The rows carry no bytes: whoever writes them (sources.copying.write_ranges) reads both versions by range."""
    copies = ops.where("op = 'copy'").withColumn("_shift", F.col("source_index") - F.col("first_block"))
    together = runs(copies, ["path", "_shift"], "first_block", "size")
    copied = together.select(
        "path", F.lit("copy").alias("op"), ((F.col("first") + F.col("_shift")) * block).alias("source_offset"), (F.col("first") * block).alias("dest_offset"), "size"
    )
    inserted = ops.where("op = 'insert'").select("path", "op", F.col("dest_offset").alias("source_offset"), "dest_offset", "size")
    cut = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(most).cast("bigint"))
    pieces = copied.unionByName(inserted).select("*", F.explode(cut).alias("_at"))
    return pieces.select(
        "path", "op", (F.col("source_offset") + F.col("_at")).alias("source_offset"), (F.col("dest_offset") + F.col("_at")).alias("dest_offset"),
        F.least(F.lit(most).cast("bigint"), F.col("size") - F.col("_at")).alias("size"),
    )


def literal_blocks(new_blocks: DataFrame, matches: DataFrame) -> DataFrame:
    """The block rows (with data) that a delta has to carry."""
    missing = matches.where(F.col("source_index").isNull()).select("path", "block_index")
    return new_blocks.join(missing, ["path", "block_index"], "left_semi")


def apply_delta(base_blocks: DataFrame, ops: DataFrame, literals: DataFrame, block: int) -> DataFrame:
    """Target contents of a table as block rows (path, dest_offset, size, data, op).

    ``literals`` are block rows (path, block_index, data). The bytes of all blocks are joined here; files are rebuilt by
    :func:`delta_ranges` instead, which moves none. See :func:`assemble` for contents that fit a row.
    """
    copies = ops.where("op = 'copy'").select("path", "source_index", "dest_offset", "size", "op")
    source = base_blocks.select("path", F.col("block_index").alias("source_index"), "data")
    copied = copies.join(source, ["path", "source_index"], "left")
    written = literals.select(
        "path",
        (F.col("block_index") * block).alias("dest_offset"),
        F.length("data").cast("bigint").alias("size"),
        F.lit("insert").alias("op"),
        "data",
    )
    return copied.drop("source_index").unionByName(written)


def apply_summary(applied: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Bytes copied from the old version and bytes written from literals, per file; empty files have a row if ``files`` names them."""
    sums = applied.groupBy("path").agg(
        F.coalesce(F.sum(F.when(F.col("op") == "copy", F.col("size"))), F.lit(0)).alias("bytes_copied"),
        F.coalesce(F.sum(F.when(F.col("op") == "insert", F.col("size"))), F.lit(0)).alias("bytes_written"),
    )
    return for_all_files(sums, files, ["path"], bytes_copied=0, bytes_written=0)


def assemble(blocks: DataFrame, offset: str = "dest_offset", files: DataFrame | None = None) -> DataFrame:
    """One row per file with its whole content (binary), for files that came from one row; empty files if ``files`` names them.

    Larger files stay in blocks and are written at their offsets (see sources.copying).
    """
    parts = F.array_sort(F.collect_list(F.struct(offset, "data")))
    # joined as hex text: concatenating binary step by step would copy it once per block
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["data"])), ""))
    whole = for_all_files(blocks.groupBy("path").agg(joined.alias("content")), files, ["path"])
    return whole.withColumn("content", F.coalesce("content", F.lit(b"")))


def delta_summary(matches: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per file: target size, bytes to transfer, saved percent, chunks matched and in all; empty files have a
    row if ``files`` names them."""
    literal = F.col("source_index").isNull()
    sums = matches.groupBy("path").agg(
        F.sum("size").alias("target_size"),
        F.coalesce(F.sum(F.when(literal, F.col("size"))), F.lit(0)).alias("transfer_size"),
        F.count_if(~literal).alias("matched_chunks"),
        F.count("*").alias("total_chunks"),
    )
    sums = for_all_files(sums, files, ["path"], target_size=0, transfer_size=0, matched_chunks=0, total_chunks=0)
    saved = (F.col("target_size") - F.col("transfer_size")).cast("double") / F.col("target_size") * 100.0
    return sums.withColumn("savings_percent", F.when(F.col("target_size") > 0, saved).otherwise(F.lit(0.0)))


def composite_hash(
    chunks: DataFrame, key: str = "path", value: Column | str | None = None, files: DataFrame | None = None
) -> DataFrame:
    """File hash from 64-bit chunk hashes: XOR of each rotated left by its index mod 64.

    ``value`` defaults to the first 64 bits of ``strong``. XOR is combined map-side.
    """
    h = hash_to_bigint("strong") if value is None else (F.col(value) if isinstance(value, str) else value)
    turned = rotate_left(h, (F.col("block_index") % 64).cast("int"))
    return for_all_files(chunks.groupBy(key).agg(F.bit_xor(turned).alias("composite")), files, [key], composite=0)
