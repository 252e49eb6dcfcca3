"""Codes of four bytes for vectors, with codebooks fitted by an exact integer k-means whose nearest-entry search is LAESA.

Components become integers, vectors are cut into equal consecutive parts, and every part position has a codebook. The nearest entry
of a part is found with pivots: some entries of the first codebook, far from each other, stay fixed, and the distance of every part
to every pivot is computed once and stored beside the vector. A round computes the distances of the pivots to its entries; since
|d(part, pivot) - d(pivot, entry)| never exceeds d(part, entry), the greatest of these differences is a lower bound. Entries are looked
at in the order of their bounds, in waves of growing size, and a part leaves the search when the next bound exceeds the best exact
distance so far. Distances are compared as exact integer squares; pivot distances are single precision, and the rounding is given
away, so no nearest entry is missed and ties go to the lower index.

A task returns sums and counts per entry, at most parts x entries rows; codebooks (parts x entries x width numbers) are all the driver sees.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; fewer vectors than entries give as
many entries as there are vectors; repeated rows and repeated ids are coded each (the first codebook takes equal ids by vector, null ids
last); equal entries leave the later one unused, so it stays; null labels share one error sum; an empty table gives an
empty result; extra columns do not matter. Vectors of several lengths, a length that the parts do not divide, or components whose squared
distances exceed a long raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import stored
from quayside.llm.vectors import as_lists, dimension, integers, slices, whole_vectors

PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 16
#: Ends of the waves in which entries are looked at.
WAVES = (1, 8, 64)
CODED = "vec_id long, label string, code string, error long"


def fixed_pivots(codebook: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: each next one is the farthest from those taken."""
    entries = codebook.astype(np.float64)
    chosen = [0]
    nearest = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return codebook[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to the few rows of ``b``, in single precision."""
    return np.stack([np.sqrt(((a - row).astype(np.float64) ** 2).sum(axis=1)) for row in b], axis=1).astype(np.float32)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, codebook: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, exact squared distance) of each part, and how many distances were evaluated."""
    n, k = len(parts), len(codebook)
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(codebook).max(initial=0)))
    if codebook.shape[1] * (2 * most) ** 2 < 2**31:  # exact in half the memory
        parts, codebook = parts.astype(np.int32), codebook.astype(np.int32)
    bounds, difference = np.zeros((n, k), dtype=np.float32), np.empty((n, k), dtype=np.float32)
    for p in range(to_pivots.shape[1]):
        np.subtract(to_pivots[:, p, None], entry_pivots[None, :, p], out=difference)
        np.maximum(bounds, np.abs(difference, out=difference), out=bounds)
    # what rounding to single precision can add to a difference
    slack = np.float32(2.0**-22) * max(to_pivots.max(initial=0), entry_pivots.max(initial=0))
    bounds -= slack
    order = np.argsort(bounds, axis=1)
    bounds = np.take_along_axis(bounds, order, axis=1)
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    radius = np.full(n, np.inf)
    open_rows, done, evaluated = np.arange(n), 0, 0
    for end in (*[w for w in WAVES if w < k], k):
        open_rows = open_rows[bounds[open_rows, done] <= radius[open_rows]]
        if not len(open_rows):
            break
        wanted = bounds[open_rows, done:end] <= radius[open_rows, None]
        row, column = np.nonzero(wanted)
        entry = order[open_rows[row], column + done]
        apart = parts[open_rows[row]] - codebook[entry]
        squares = np.einsum("ij,ij->i", apart, apart)
        evaluated += len(squares)
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))  # every open row has its next entry here
        least = np.minimum.reduceat(squares, begin)
        first = np.minimum.reduceat(np.where(squares == least[row], entry, k), begin)
        better = (least < best[open_rows]) | ((least == best[open_rows]) & (first < index[open_rows]))
        changed = open_rows[better]
        best[changed], index[changed] = least[better], first[better]
        radius[changed] = np.sqrt(best[changed].astype(np.float64)) * (1 + 1e-9)
        done = end
    return index, best, evaluated


class Codebooks:
    """Entries of every part position, with the fixed pivots and their distances to the entries."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots  # parts x entries x width, parts x pivots x width
        self.to_pivots = [distances(own, fixed) for own, fixed in zip(entries, pivots)]

    def assign(self, vectors: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), vectors x parts."""
        parts = vectors.reshape(len(vectors), len(self.entries), -1)
        found = [nearest(parts[:, j], to_pivots[:, j], self.entries[j], self.to_pivots[j]) for j in range(len(self.entries))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _read(batch: pa.RecordBatch, parts: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    vectors = batch.column("x").flatten().to_numpy().reshape(n, -1)
    return vectors, batch.column("to_pivots").flatten().to_numpy().reshape(n, parts, pivots)


def prepare(df: DataFrame, column: str, parts: int, entries: int, pivots: int) -> tuple[DataFrame, Codebooks] | None:
    """Stored (vec_id, label, x, to_pivots) with the distances to the fixed pivots, and the first codebooks; None for an empty table."""
    kept = whole_vectors(df, column)
    dim = dimension(kept, column)
    if dim is None:
        return None
    if not dim or dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    label = F.col("label").cast("string") if "label" in df.columns else F.lit(None).cast("string")
    narrow = kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(column).alias("x"))
    first = narrow.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = integers(pa.array([r["x"] for r in first], pa.list_(pa.float64())), dim).reshape(len(first), parts, -1).transpose(1, 0, 2)
    start = np.ascontiguousarray(start)
    fixed = np.stack([fixed_pivots(own, pivots) for own in start])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = integers(batch.column("x"), dim)
            if x.size and 4 * (dim // parts) * int(np.abs(x).max()) ** 2 >= 2**62:
                raise ValueError("squared distances of such vectors exceed a long")
            cut = x.reshape(len(x), parts, -1)
            to = np.stack([distances(cut[:, j], fixed[j]) for j in range(parts)], axis=1)
            columns = [batch.column("vec_id"), batch.column("label"), as_lists(x), as_lists(to.reshape(len(x), -1))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "to_pivots"])

    return stored(narrow.mapInArrow(run, "vec_id long, label string, x array<long>, to_pivots array<float>")), Codebooks(start, fixed)


def improved(prepared: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one round: entries become the floored means of their parts, unused ones stay."""
    parts, k, width = books.entries.shape
    pivots = books.pivots.shape[1]
    model = prepared.sparkSession.sparkContext.broadcast(books)
    names = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * k, width), dtype=np.int64), np.zeros(parts * k, dtype=np.int64)
        for batch in slices(batches):
            vectors, to = _read(batch, parts, pivots)
            codes, _ = model.value.assign(vectors, to)
            cell = (codes + np.arange(parts) * k).ravel()
            np.add.at(sums, cell, vectors.reshape(-1, width))
            counts += np.bincount(cell, minlength=parts * k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), *(pa.array(sums[used, j]) for j in range(width))], names=["cell", "n", *names]
        )

    found = prepared.select("x", "to_pivots").mapInArrow(run, ", ".join(["cell int", "n long", *(f"{c} long" for c in names)]))
    entries = books.entries.copy().reshape(parts * k, width)
    for r in found.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ["n", *names])).collect():  # parts x entries rows at most
        entries[r["cell"]] = [r[c] // r["n"] for c in names]
    return Codebooks(entries.reshape(parts, k, width), books.pivots)


def encode(prepared: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every prepared vector."""
    parts, pivots = books.entries.shape[0], books.pivots.shape[1]
    model = prepared.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, squares = model.value.assign(*_read(batch, parts, pivots))
            text = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), text, pa.array(squares.sum(axis=1))], names=["vec_id", "label", "code", "error"]
            )

    return prepared.mapInArrow(run, CODED)


def compress(
    df: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole vector. ``entries`` is 256 at most, two hex digits."""
    ready = prepare(df, column, parts, entries, pivots)
    if ready is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    prepared, books = ready
    for _ in range(rounds):
        books = improved(prepared, books)
    coded = stored(encode(prepared, books)).withColumn("_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = coded.groupBy("_key").agg(F.sum("error").alias("label_error"))
    return coded.join(sums, "_key").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
