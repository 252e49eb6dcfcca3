"""Order-dependent work (running sums, positions, folds) without one task per key.

A key may hold a large share of all rows, so a plain window or a collected list per key is
not enough. Rows are range-partitioned by (keys, order) into contiguous, evenly sized
*segments*; each segment is worked on alone, and what crosses a segment border - at most
one key per border - is carried over in a table of at most two rows per segment.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.session import persist_shared

SEG = "_seg"


def segment(df: DataFrame, keys: list[str], order: list[str | Column], segments: int | None = None) -> DataFrame:
    """``df`` cut into contiguous runs of (keys, order), numbered in ``_seg``. ``order`` holds
    column names or sort expressions such as ``F.desc("size")``.

    Without ``segments`` the session's shuffle partitions bound their number, and adaptive
    execution joins neighbours until each is worth a task. The cut points come from sampling,
    so the result is written to the shared folder once: every later pass then sees the same
    segments.
    """
    cols = [*keys, *order]
    ranged = df.repartitionByRange(segments, *cols) if segments else df.repartitionByRange(*cols)
    cut = ranged.sortWithinPartitions(*cols)
    return persist_shared(cut.withColumn(SEG, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    sums: dict[str, Column | str],
    totals: dict[str, str] | None = None,
    lows: dict[str, Column | str] | None = None,
    segments: int | None = None,
    segmented: bool = False,
) -> DataFrame:
    """Running sums (current row included) per key in order; ``totals`` names the matching
    whole-key sums: ``{sum_name: total_name}``, ``lows`` adds whole-key minima.

    ``order`` must be a total order within a key. ``segmented`` says that ``df`` still has
    the segments of an earlier :func:`segment`.
    """
    totals = totals or {}
    values = {name: F.expr(v) if isinstance(v, str) else v for name, v in sums.items()}
    raw = {f"_v_{name}": value for name, value in values.items()}
    minima = {name: F.expr(v) if isinstance(v, str) else v for name, v in (lows or {}).items()}
    raw |= {f"_v_{name}": value for name, value in minima.items()}
    seg = df.select("*", *[v.alias(n) for n, v in raw.items()])
    if not segmented:
        seg = segment(seg, keys, order, segments)

    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    edges = seg.groupBy(SEG).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    # totals of the first and last key of every segment: at most two rows per segment
    parts = (
        seg.join(F.broadcast(edges), SEG)
        .where((key == F.col("_first")) | (key == F.col("_last")))
        .groupBy(SEG, key.alias("_key"))
        .agg(
            *[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in values],
            *[F.min(f"_v_{n}").alias(f"_p_{n}") for n in minima],
        )
    )
    earlier = Window.partitionBy("_key").orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    carry = parts.select(
        F.col(SEG),
        F.col("_key"),
        *[F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in values],
        *[F.sum(f"_p_{n}").over(whole).alias(f"_t_{n}") for n in totals],
        *[F.min(f"_p_{n}").over(whole).alias(f"_t_{n}") for n in minima],
    )
    inside = Window.partitionBy(SEG, *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = Window.partitionBy(SEG, *keys)
    out = seg.select(
        "*",
        key.alias("_key"),
        *[F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in values],
        *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in totals],
        *[F.min(f"_v_{n}").over(local).alias(f"_l_{n}") for n in minima],
    ).join(F.broadcast(carry), [SEG, "_key"], "left")
    return out.select(
        *[c for c in df.columns if c != SEG],
        *[(F.col(f"_r_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in values],
        *[F.coalesce(f"_t_{n}", f"_l_{n}").alias(t) for n, t in totals.items()],
        *[F.coalesce(f"_t_{n}", f"_l_{n}").alias(n) for n in minima],
    )


def with_position(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """Zero-based position of each row within its key."""
    out = running(df, keys, order, {"_pos": F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col("_pos") - 1).drop("_pos")


Columns = dict[str, np.ndarray]
#: One fold step: (state or None at the key's first row, rows of one key in order)
#: -> (state after those rows, output columns of the same length).
Step = Callable[[Any, Columns], tuple[Any, Columns]]


@dataclass(frozen=True)
class Jumps:
    """What some rows do to a state that is one integer: piece by piece, it becomes a constant or is shifted.

    Piece i is for states up to ``ends[i]`` (included) and beyond the piece before; the last one has no end (``TOP``)."""

    ends: np.ndarray
    shifts: np.ndarray
    amounts: np.ndarray

    @staticmethod
    def of(ends: list[int] | np.ndarray, shifts: list[bool] | np.ndarray, amounts: list[int] | np.ndarray) -> Jumps:
        """Pieces in order; empty ones and those like their neighbour are left out."""
        ends, shifts, amounts = np.asarray(ends, dtype=np.int64), np.asarray(shifts, dtype=bool), np.asarray(amounts, dtype=np.int64)
        full = np.concatenate([[True], ends[1:] > ends[:-1]])
        ends, shifts, amounts = ends[full], shifts[full], amounts[full]
        last = np.append((shifts[1:] != shifts[:-1]) | (amounts[1:] != amounts[:-1]), True)
        return Jumps(ends[last], shifts[last], amounts[last])

    @staticmethod
    def constant(state: int) -> Jumps:
        return Jumps.of([TOP], [False], [state])

    def apply(self, state: int) -> int:
        at = int(np.searchsorted(self.ends, state, side="left"))
        return int(self.amounts[at]) + (state if self.shifts[at] else 0)

    def then(self, other: Jumps) -> Jumps:
        """Both, one after the other."""
        ends, shifts, amounts, low = [], [], [], BOTTOM
        for end, shift, amount in zip(self.ends.tolist(), self.shifts.tolist(), self.amounts.tolist()):
            if not shift:
                ends.append(end)
                shifts.append(False)
                amounts.append(other.apply(amount))
            else:
                first = int(np.searchsorted(other.ends, low + amount, side="right" if low > BOTTOM else "left"))
                last = int(np.searchsorted(other.ends, end + amount, side="left")) if end < TOP else len(other.ends) - 1
                own = other.ends[first : last + 1]
                ends += [min(e - amount, end) if e < TOP else end for e in own.tolist()]
                shifts += other.shifts[first : last + 1].tolist()
                amounts += [x + amount if s else x for x, s in zip(other.amounts[first : last + 1].tolist(), other.shifts[first : last + 1].tolist())]
            low = end
        return Jumps.of(ends, shifts, amounts)


#: No state is greater or less.
TOP, BOTTOM = 2**62, -(2**62)


@dataclass(frozen=True)
class Shortcut:
    """How a fold whose state is one integer jumps over rows, so that segments can be put together before any is replayed.

    ``jumps`` tells what the rows of a segment (``columns`` only) do to any state; ``enter`` and ``leave`` turn the integer
    into the fold's state and back."""

    columns: list[str]
    jumps: Callable[[Columns], Jumps]
    enter: Callable[[int], Any] = int
    leave: Callable[[Any], int] = int


def last_jump(following: np.ndarray) -> np.ndarray:
    """Where the chain i -> following[i] ends for every i; an end points to itself."""
    while True:
        further = following[following]
        if np.array_equal(further, following):
            return following
        following = further


def run_ends(values: np.ndarray) -> np.ndarray:
    """Index of the last element of every run of equal values."""
    return np.flatnonzero(np.append(values[1:] != values[:-1], True))


def _key_runs(pdf: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """[start, end) of the runs of equal keys in a sorted frame."""
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for key in keys:
        codes = pd.factorize(pdf[key], use_na_sentinel=False)[0]
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    return list(zip(starts, np.append(starts[1:], len(pdf))))


def _same_key(a: tuple, b: tuple) -> bool:
    """Equal keys; missing values (NaN where a numeric key has nulls) equal each other."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _same(a: Any, b: Any) -> bool:
    """Equal states; floating parts may differ by rounding only."""
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-13 * max(abs(a), abs(b))
    return a == b


def fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Step,
    outputs: dict[str, str],
    segments: int | None = None,
    keep_segments: bool = False,
    shortcut: Shortcut | None = None,
) -> DataFrame:
    """A sequential fold per key, run in parallel over segments; adds the ``outputs`` columns.

    A segment that begins in the middle of a key needs the state its predecessor ends with.
    Those end states are first worked out from a fresh state each; where a segment turns out
    to have begun with another state, it is worked out again, until nothing changes. Only
    rows of keys that cross a border take part in this. Folds that forget their past (moving
    averages, buckets) settle after a round or two; any other fold is still exact, it just
    takes more rounds; their small states, one per segment, are held by the driver. With a ``shortcut``
    there are no rounds and no states on the driver: what segments do to a state is put together in pairs, pairs of
    pairs and so on, and the states are handed down again, in logarithmically many passes over rows that
    are few. All columns of ``df`` go through Arrow, so select the needed ones first.
    """
    seg = segment(df, keys, order, segments)
    fields = [f for f in seg.schema.fields if keep_segments or f.name != SEG]
    cols = [f.name for f in fields]
    key_cols = list(keys)
    incoming: dict[int, Any] = {} if shortcut else _border_states(seg, key_cols, cols, step)
    rows = _with_composed_states(seg, key_cols, cols, step, shortcut) if shortcut else seg

    def begin(pdf: pd.DataFrame) -> Any:
        if not shortcut:
            return incoming.get(int(pdf[SEG].iloc[0]))
        known = pdf[_STATE].iloc[0]
        return None if pd.isna(known) else shortcut.enter(int(known))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: Any = None
        previous: tuple | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            produced: dict[str, list[np.ndarray]] = {name: [] for name in outputs}
            arrays = {c: pdf[c].to_numpy() for c in cols}
            for start, end in _key_runs(pdf, key_cols):
                key = tuple(arrays[k][start] for k in key_cols)
                if previous is None:
                    state = begin(pdf)
                elif not _same_key(key, previous):
                    state = None
                previous = key
                state, out = step(state, {c: a[start:end] for c, a in arrays.items()})
                for name in outputs:
                    produced[name].append(out[name])
            yield pdf[cols].assign(**{n: np.concatenate(v) for n, v in produced.items()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += "".join(f", `{n}` {t}" for n, t in outputs.items())
    return rows.mapInPandas(replay, schema)


_STATE = "_state"
_JUMPS = "no bigint, ends array<bigint>, shifts array<boolean>, amounts array<bigint>"


def _jumps_row(no: int, jumps: Jumps) -> pd.DataFrame:
    return pd.DataFrame({"no": [no], "ends": [jumps.ends], "shifts": [jumps.shifts], "amounts": [jumps.amounts]})


def _with_composed_states(seg: DataFrame, keys: list[str], cols: list[str], step: Step, shortcut: Shortcut) -> DataFrame:
    """``seg`` with the state (or null) in which each segment begins, in ``_state``."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    edges = seg.groupBy(SEG).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    line = Window.orderBy(SEG)  # one row per segment
    numbered = persist_shared(
        edges.select(
            SEG, "_last", (F.row_number().over(line) - 1).cast("bigint").alias("_no"),
            F.coalesce(F.lag("_last").over(line).eqNullSafe(F.col("_first")) & (F.row_number().over(line) > 1), F.lit(False)).alias("_goes_on"),
            F.col("_first").eqNullSafe(F.col("_last")).alias("_whole"),
        )
    )
    ending = seg.join(F.broadcast(numbered), SEG).where(key.eqNullSafe(F.col("_last")))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a segment does to the state it begins with: nothing depends on that if its last key begins in it."""
        state, no, through = None, None, False
        kept: dict[str, list[np.ndarray]] = {c: [] for c in shortcut.columns}
        for pdf in batches:
            if not len(pdf):
                continue
            no, through = int(pdf["_no"].iloc[0]), bool(pdf["_goes_on"].iloc[0] and pdf["_whole"].iloc[0])
            if through:
                for c in kept:
                    kept[c].append(pdf[c].to_numpy())
            else:
                state, _ = step(state, {c: pdf[c].to_numpy() for c in cols})
        if through:
            yield _jumps_row(no, shortcut.jumps({c: np.concatenate(v) for c, v in kept.items()}))
        elif no is not None:
            yield _jumps_row(no, Jumps.constant(shortcut.leave(state)))

    def read(row: pd.Series) -> Jumps:
        return Jumps(np.asarray(row["ends"]), np.asarray(row["shifts"]), np.asarray(row["amounts"]))

    def pair(key: tuple, two: pd.DataFrame) -> pd.DataFrame:
        rows = [read(r) for _, r in two.sort_values("no").iterrows()]
        return _jumps_row(int(key[0]), rows[0].then(rows[1]) if len(rows) == 2 else rows[0])

    # upwards: blocks of 1, 2, 4, ... segments
    levels, blocks = [persist_shared(ending.mapInPandas(one, _JUMPS))], numbered.count()
    while (blocks := (blocks + 1) // 2) > 1:
        levels.append(persist_shared(levels[-1].groupBy(F.floor(F.col("no") / 2).alias("no")).applyInPandas(pair, _JUMPS)))

    def hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple[int, int]] = []
            for _, row in pdf.iterrows():
                out.append((2 * int(row["block"]), int(row["state"])))
                if row["ends"] is not None:
                    out.append((2 * int(row["block"]) + 1, read(row).apply(int(row["state"]))))
            yield pd.DataFrame(out, columns=["block", "state"], dtype="int64")

    # downwards: a block's first half begins as the block does, its second half as the first one ends
    states = seg.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("state"))
    for level in reversed(levels):
        halves = level.where("no % 2 = 0").select((F.col("no") / 2).cast("bigint").alias("block"), "ends", "shifts", "amounts")
        states = states.join(halves, "block", "left").mapInPandas(hand_down, "block bigint, state bigint")
    begins = numbered.join(states, F.col("_no") == F.col("block")).select(SEG, F.when(F.col("_goes_on"), F.col("state")).alias(_STATE))
    return seg.join(F.broadcast(persist_shared(begins)), SEG).select(*seg.columns, _STATE)


def _border_states(seg: DataFrame, keys: list[str], cols: list[str], step: Step) -> dict[int, Any]:
    """State with which every segment that begins in the middle of a key begins, by rounds."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    edges = seg.groupBy(SEG).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    known = sorted((r[SEG], r["_first"], r["_last"]) for r in edges.collect())  # one row per segment
    borders = [(a[0], b[0]) for a, b in zip(known, known[1:]) if a[2] == b[1]]
    if not borders:
        return {}
    whole = {s for s, first, last in known if first == last}
    ending = seg.join(F.broadcast(edges), SEG).where(key.eqNullSafe(F.col("_last"))).select(*seg.columns)

    def ends(incoming: dict[int, Any], only: list[int]) -> dict[int, Any]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, number = None, None
            for pdf in batches:
                if not len(pdf):
                    continue
                if number is None:
                    number = int(pdf[SEG].iloc[0])
                    state = incoming.get(number) if number in whole else None
                state, _ = step(state, {c: pdf[c].to_numpy() for c in cols})
            if number is not None:
                yield pd.DataFrame({"seg": [number], "state": [json.dumps(state)]})

        # the segments stay in their partitions: a broadcast join moves no row of theirs
        rows = ending.where(F.col(SEG).isin(only)).mapInPandas(run, "seg int, state string")
        return {r.seg: json.loads(r.state) for r in rows.collect()}

    leading = {a for a, _ in borders}
    incoming: dict[int, Any] = {}
    states = ends(incoming, sorted(leading))
    while True:
        again = []
        for before, here in borders:
            if here in incoming and _same(incoming[here], states[before]):
                continue
            incoming[here] = states[before]
            # a segment of one key passes what it was given on to the next border
            if here in whole and here in leading:
                again.append(here)
        if not again:
            return incoming
        states.update(ends(incoming, again))
