"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniformly random permutation of all rows, how many rows of each partition end in each target is multivariate
hypergeometric. So that matrix is drawn first, from nothing but the partition sizes and the exact target sizes. Each partition
then permutes its rows and deals them out as its line of the matrix says, the rows are exchanged, and each target permutes
what it received. The result is a uniform permutation cut into targets, without a global sort or random keys, and no
target is a row too large or too small. A target is a part of a shard with some thousand rows, so a shard is worked on by many
tasks; its place in the shard is known beforehand, so slots are gapless without counting.

The matrix is drawn as a tree, in tasks: all rows are split among the shards, then every shard among at most eight parts,
and so on down to the targets. A node of the tree is a group of (partition, rows), one row for each partition that has any there, and only
such cells are kept, so no table of the tree has more rows than the documents or than the cells. The matrix is stored
by blocks of partitions, and a task reads the lines of its own; neither the driver nor a broadcast holds any of it.

Rows are known by the partition that stored them and their number in it, so a lost task that runs again makes the same choices.
Law ``rows``: shard sizes differ by at most one row.

Defined cases: nulls, repeated rows and texts of any length are rows like others; with fewer rows than shards some shards stay empty;
an empty table gives an empty result; extra columns are carried through, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quayside.llm.common import fresh, relaxed, stored
from quayside.session import shared_dir
from quayside.sources.stores import open_store

FAN_OUT = 8  # parts that a node of the tree is split into
BLOCK = 64  # partitions whose lines are stored together


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good. numpy's own up to its limit of 10**9 rows; beyond it
    the distribution within twelve deviations of the mean, from the ratios of neighbouring terms."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(good, n)
    mean = n * good / (good + bad)
    spread = 12 * np.sqrt(max(1.0, mean * bad / (good + bad) * (good + bad - n) / (good + bad))) + 12
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    ratios = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(weights, rng.random() * weights[-1])])


def spread(rng: np.random.Generator, held: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn from all that partitions hold, come from each. Partitions are dealt with one by one until
    what is left is within numpy's limit."""
    out, behind, at = np.zeros(len(held), dtype=np.int64), int(held.sum()), 0
    while behind >= 10**9:
        behind -= int(held[at])
        out[at] = hypergeometric(rng, int(held[at]), behind, n)
        n -= int(out[at])
        at += 1
    if at < len(held):
        out[at:] = rng.multivariate_hypergeometric(held[at:], n, method="marginals")
    return out


def matrix(sizes: list[int] | np.ndarray, targets: list[int], seed: int | list[int]) -> np.ndarray:
    """Rows: partitions, columns: targets. Column by column from what the partitions still hold."""
    rng = np.random.default_rng(seed)
    held, out = np.array(sizes, dtype=np.int64), np.zeros((len(sizes), len(targets)), dtype=np.int64)
    for j, n in enumerate(targets):
        out[:, j] = spread(rng, held, n)
        held -= out[:, j]
    return out


def even(n: int, parts: int) -> list[int]:
    """n rows in parts that differ by at most one."""
    return [n // parts + (k < n % parts) for k in range(parts)]


def lines(sizes: DataFrame, total: int, shards: int, seed: int, target_rows: int) -> DataFrame:
    """(shard, first, rows, part, n) of a table (part, n): the target of a shard that begins at slot ``first`` and has
    ``rows`` rows gets n of them from the partition."""

    def split(node: pa.Table) -> pa.Table:
        k, first, rows = (node[c][0].as_py() for c in ("shard", "first", "rows"))
        if k >= 0 and rows <= target_rows:
            return node
        node = node.sort_by("part")
        pieces = even(rows, shards if k < 0 else min(FAN_OUT, -(-rows // target_rows)))
        drawn = matrix(node["n"].to_numpy(), pieces, [seed, 0, k + 1, first, rows])
        child, at = np.nonzero(drawn.T)
        begins = first + np.concatenate([[0], np.cumsum(pieces)[:-1]])
        columns = [
            child if k < 0 else np.full(len(child), k),
            np.zeros(len(child)) if k < 0 else begins[child],
            np.array(pieces)[child],
            node["part"].to_numpy()[at],
            drawn[at, child],
        ]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["shard", "first", "rows", "part", "n"])

    found = sizes.select(
        F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.lit(total).cast("long").alias("rows"), "part", "n"
    )
    largest = None
    while largest is None or largest > target_rows:  # the tree's depth follows from the number of rows alone
        found = found.groupBy("shard", "first", "rows").applyInArrow(split, "shard long, first long, rows long, part long, n long")
        pieces = shards if largest is None else min(FAN_OUT, -(-largest // target_rows))
        largest = -(-(total if largest is None else largest) // pieces)
    return found


@lru_cache(maxsize=2)
def line_of(path: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards and first slots of the targets that a partition deals to, and its rows to all targets up to each."""
    place, base = open_store(f"{path}/block={part // BLOCK}")
    own = ds.dataset(base, filesystem=place, format="parquet").to_table(columns=["shard", "first", "n"], filter=ds.field("part") == part)
    own = own.sort_by([("shard", "ascending"), ("first", "ascending")])
    return own["shard"].to_numpy().astype(np.int32), own["first"].to_numpy(), np.cumsum(own["n"].to_numpy())


def shuffle(docs: DataFrame, shards: int = 8, seed: int = 7, target_rows: int = 20_000) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, its place in the shard from 0 on (under fresh names if those are taken)."""
    place, shard, slot = fresh(docs, "_place"), fresh(docs, "shard"), fresh(docs, "slot")
    held = stored(docs.withColumn(place, F.monotonically_increasing_id()))
    sizes = held.groupBy(F.shiftright(place, 33).alias("part")).agg(F.count("*").alias("n"))
    drawn = lines(sizes, held.count(), shards, seed, target_rows)
    path = f"{shared_dir(held.sparkSession)}/lines-{uuid.uuid4().hex}"
    block = F.floor(F.col("part") / BLOCK).alias("block")
    drawn.select("shard", "first", "part", "n", block).repartition("block").sortWithinPartitions("block", "part").write.partitionBy("block").parquet(path)
    to_shard, to_first = fresh(docs, "_shard"), fresh(docs, "_first")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, np.ndarray] | None = None
        for batch in batches:
            places = batch.column(place).to_numpy()
            shard_of, first_of = np.empty(len(places), dtype=np.int32), np.empty(len(places), dtype=np.int64)
            for p in np.unique(places >> 33).tolist():
                own_shards, own_firsts, upto = line_of(path, p)
                if known is None or known[0] != p:
                    known = (p, np.random.default_rng([seed, 1, p]).permutation(int(upto[-1])))
                mine = places >> 33 == p
                to = np.searchsorted(upto, known[1][places[mine] & ((1 << 33) - 1)], side="right")
                shard_of[mine], first_of[mine] = own_shards[to], own_firsts[to]
            names = [*batch.schema.names, to_shard, to_first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of), pa.array(first_of)], names=names)

    def settle(table: pa.Table) -> pa.Table:
        order = np.argsort(table[place].to_numpy())
        k, first = table[to_shard][0].as_py(), table[to_first][0].as_py()
        at = np.empty(len(order), dtype=np.int64)
        at[order] = first + np.random.default_rng([seed, 2, k, first]).permutation(len(order))
        table = table.drop_columns([place, to_shard, to_first])
        return table.append_column(shard, pa.array(np.full(len(order), k, dtype=np.int32))).append_column(slot, pa.array(at))

    target = [StructField(to_shard, IntegerType()), StructField(to_first, LongType())]
    dealt = held.mapInArrow(deal, relaxed(StructType([*held.schema.fields, *target])))
    out = StructType([*docs.schema.fields, StructField(shard, IntegerType()), StructField(slot, LongType())])
    return dealt.groupBy(to_shard, to_first).applyInArrow(settle, relaxed(out))
