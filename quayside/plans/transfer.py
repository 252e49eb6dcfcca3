"""Copy plans: chunking, batching, directories, keys, commands, space."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import paths
from quayside.functions.sizes import MIB
from quayside.operators.ordered import TOP, Jumps, Shortcut, fold, last_jump, run_ends, running
from quayside.session import persist_shared


def chunk_plan(
    df: DataFrame, chunk: int = 64 * MIB, minimum: int = 100 * MIB, inclusive: bool = True
) -> DataFrame:
    """Byte ranges to copy: files from ``minimum`` on become ranges of ``chunk`` bytes.

    ``inclusive=False`` with 8 MiB chunks is the multipart rule of object stores (strictly
    larger than the minimum). Whole files come first, then ranges by size: ``priority, size``.
    """
    big = (F.col("size") >= minimum) if inclusive else (F.col("size") > minimum)
    n = F.when(big, F.floor((F.col("size") + (chunk - 1)) / F.lit(chunk))).otherwise(1)
    start = F.col("part") * F.lit(chunk).cast("bigint")
    return (
        df.select("path", "size", big.alias("_big"), F.explode(F.sequence(F.lit(0), n.cast("bigint") - 1)).alias("part"))
        .select(
            "path",
            F.col("size").alias("file_size"),
            F.col("part").cast("bigint").alias("part"),
            F.when(F.col("_big"), start).alias("offset"),
            F.when(F.col("_big"), F.least(F.lit(chunk).cast("bigint"), F.col("size") - start))
            .otherwise(F.col("size"))
            .alias("size"),
            F.col("_big").cast("int").alias("priority"),
        )
    )


def multipart_plan(df: DataFrame, chunk: int = 8 * MIB, minimum: int = 100 * MIB) -> DataFrame:
    """Object upload parts, numbered from 1; a file that is not split has part number null."""
    plan = chunk_plan(df, chunk, minimum, inclusive=False)
    return plan.withColumn(
        "part_number", F.when(F.col("priority") == 1, F.col("part") + 1)
    ).drop("part", "priority")


def ordered_chunks(plan: DataFrame) -> DataFrame:
    return plan.orderBy("priority", "size", "path", "part")


def assign_batches(
    df: DataFrame,
    order: list[str],
    limit: int = 64 * MIB,
    threshold: int = MIB,
    shard: list[str] | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Next-fit batches of small files in order: adds ``batch``, null from ``threshold`` bytes on.

    A batch is closed when the next file would push it over ``limit``. The rule runs over the
    whole estate (or each ``shard``) in order; :func:`fold` runs it on all segments at once,
    jumping from one batch border to the next by searching the running byte total. What a segment does to a batch that is open
    when it begins depends on the bytes in that batch alone, and is put together over segments in pairs.
    """
    shard = shard or []

    def step(state, rows):
        used, filled = state or (0, False)
        before = np.concatenate([[0], np.cumsum(rows["size"].astype(np.int64))])
        n, at = len(before) - 1, 0
        opens = np.zeros(n, dtype=np.int64)
        opens[0] = 0 if filled else 1
        while at < n:
            end = max(at, int(np.searchsorted(before, before[at] + limit - used, side="right")) - 1)
            if end == at and not filled:
                end = at + 1  # an empty batch takes any file
            used, filled = used + int(before[end] - before[at]), True
            if end < n:
                opens[end], used, filled = 1, 0, False
            at = end
        return (used, filled), {"_opens": opens}

    def jumps(rows):
        # a batch opened at row p ends at row end[p]; the last one of each chain stays open
        before = np.concatenate([[0], np.cumsum(rows["size"].astype(np.int64))])
        n = len(before) - 1
        end = np.maximum(np.searchsorted(before, before[:-1] + limit, side="right") - 1, np.arange(1, n + 1))
        last = last_jump(np.where(end < n, end, np.arange(n)))
        left = before[n] - before[last]
        # the batch that was open before can end no later than an empty one would
        reach = min(n - 1, int(np.searchsorted(before, limit, side="right")) - 1)
        groups = run_ends(left[: reach + 1])[::-1]
        # filled up to ``limit - before[p + 1]`` or less, it takes row p; the less it holds the later it ends
        upto = limit - before[groups + 1]
        return Jumps.of([*upto.tolist(), TOP], [True, *[False] * len(groups)], [int(before[n]), *left[groups].tolist()])

    small = df.where(F.col("size") < threshold)
    shortcut = Shortcut(["size"], jumps, lambda used: (used, True), lambda state: state[0])
    opened = fold(small, shard, order, step, {"_opens": "bigint"}, segments, True, shortcut)
    numbered = running(persist_shared(opened), shard, order, {"_n": "_opens"}, segmented=True)
    batched = numbered.select(*df.columns, (F.col("_n") - 1).alias("batch"))
    large = df.where(F.col("size") >= threshold).withColumn("batch", F.lit(None).cast("bigint"))
    return batched.unionByName(large)


def batch_summary(batches: DataFrame) -> DataFrame:
    return batches.groupBy("batch").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def plan_dirs(plan: DataFrame, existing: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Directories the files of a plan need and the destination lacks, parents first."""
    parents = plan.select(F.concat(paths.parent(path), F.lit("/")).alias("_dir")).distinct()
    needed = parents.select(F.explode(paths.ancestors("_dir")).alias("path")).where("path <> ''").distinct()
    if existing is not None:
        needed = needed.join(existing.select("path"), "path", "left_anti")
    return needed.withColumn("depth", paths.depth("path").cast("bigint")).orderBy("depth", "path")


def map_keys(df: DataFrame, prefix: str) -> DataFrame:
    """Adds the object key of every relative path."""
    return df.withColumn("key", F.concat(F.lit(prefix + "/"), F.col("path")))


def strip_keys(df: DataFrame, prefix: str) -> DataFrame:
    """Adds the relative path of every object key below (or outside) ``prefix``."""
    key = F.col("key")
    rest = F.when(key.startswith(prefix), F.substring(key, len(prefix) + 1, 2**31 - 1)).otherwise(key)
    return df.withColumn("path", F.regexp_replace(rest, r"\A/+", ""))


# Command word per action of the bulk command file.
COMMANDS = {"copy": "cp", "move": "mv", "sync": "sync", "delete": "rm"}


def to_commands(operations: DataFrame) -> DataFrame:
    """Text lines ``cp a b``, ``mv a b``, ``sync a b``, ``rm a`` from (operation, source, destination)."""
    word = None
    for name, command in COMMANDS.items():
        test = F.col("operation") == name
        word = F.when(test, command) if word is None else word.when(test, command)
    target = F.when(F.col("operation") != "delete", F.col("destination"))
    # concat_ws leaves out the missing destination of a delete
    return operations.select(F.concat_ws(" ", word, "source", target).alias("value"))


def plan_to_commands(plan: DataFrame, source_root: str, dest_root: str) -> DataFrame:
    """Command lines of a sync plan: a copy per new or updated file, a delete per extra one."""
    operation = F.when(F.col("action") == "Delete", "delete").otherwise("copy")
    moves = plan.where(F.col("action").isin("CopyNew", "Update", "Delete")).select(
        operation.alias("operation"),
        F.when(F.col("action") == "Delete", paths.under(dest_root, "path"))
        .otherwise(paths.under(source_root, "path"))
        .alias("source"),
        paths.under(dest_root, "path").alias("destination"),
    )
    return to_commands(moves)


def select_pattern(
    df: DataFrame, pattern: str, operation: str, root: str, destination: str | None = None
) -> DataFrame:
    """Copy or delete plan of everything a wildcard selects. It only lists; nothing is run."""
    hit = df.where(paths.matches_any("path", [pattern]))
    return hit.select(
        F.lit(operation).alias("operation"),
        paths.under(root, "path").alias("source"),
        (paths.under(destination, "path") if destination else F.lit(None).cast("string")).alias("destination"),
    )


def assign_mount(df: DataFrame, mounts: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``mount``: the longest mount point that is a text prefix of the path, or null.

    A prefix is an equality on a cut of the path, so this is an equi-join per path prefix and
    not a range join: the path is cut at every length any mount point has (a handful), and
    the longest hit is kept with one aggregate per row's own array, without a shuffle of paths.
    """
    points = mounts.select(F.col("mount_point").alias("mount")).distinct()
    lengths = [r[0] for r in points.select(F.length("mount")).distinct().collect()]
    cuts = F.array(*[F.substring(path, 1, size) for size in sorted(lengths, reverse=True)])
    per_path = df.select(path).distinct()
    hits = (
        per_path.select(path, F.explode(F.array_distinct(cuts)).alias("mount"))
        .join(points, "mount")
        .groupBy(path)
        .agg(F.max_by("mount", F.length("mount")).alias("mount"))
    )
    return df.join(hits, path, "left").select(*df.columns, "mount")


def check_space(plan: DataFrame, mounts: DataFrame, path: str = "path") -> DataFrame:
    """Per mount: bytes the plan needs, bytes available, and whether they suffice. Paths on
    no known mount are reported with nothing available."""
    needed = assign_mount(plan, mounts, path).groupBy("mount").agg(F.sum("size").alias("required"))
    room = mounts.select(F.col("mount_point").alias("mount"), "available")
    return needed.join(room, "mount", "left").select(
        "mount",
        "required",
        F.coalesce("available", F.lit(0)).alias("available"),
        (F.coalesce("available", F.lit(0)) >= F.col("required")).alias("fits"),
    )
