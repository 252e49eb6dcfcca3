"""Whitening of vectors by an exact characteristic polynomial.

Components become integers u, and n, the sums S and the products G = sum of u u' are exact integers, summed by Spark. The integer scatter
C = n G - S S' is n squared times the covariance (a shift of u changes nothing). Its characteristic polynomial is found modulo many
primes, each in a task, by reduction to Hessenberg form and the recurrence of the leading minors; remainders are put together by
the Chinese remainder theorem, with enough primes for the proven bound of the coefficients. All roots are real, so the sign changes of the
coefficients of p(x + a) count the roots above a exactly (Descartes): each of the largest roots is isolated by bisection of that count and
then of the sign of p, to some 200 bits. Its component solves (C - root I) v = b by inverse iteration in fixed-point numbers with far more
bits than the root has; equal roots give as many orthogonal components. One task does one component. Doubles come in at the end only.

What the driver holds is bounded by the number of components d: d squared sums, d coefficients for each prime (about
d log2(trace) / 31 primes).

Defined cases: rows whose vector is null or holds null or non-finite entries are left out; components without variance
(root zero, such as with fewer vectors than dimensions) are not returned, so a table whose vectors are all equal gives no rows;
repeated rows count each; an empty table gives an empty result; null ids are kept; extra columns do not matter. Vectors of several
lengths and entries of 2^40 or more raise an error. A squared deviation that does not fit is null: as decimal beyond 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb, gcd, isqrt, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import stored
from quayside.llm.vectors import as_lists, dimension, integers, slices, whole_vectors

COMPONENTS = 8
#: Bits of an isolated root, and of the fixed-point numbers of the inverse iteration.
ROOT_BITS, POINT_BITS = 200, 640
_LIMB = 20


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b as Python integers: float products where they are exact, of parts of 20 bits else. At most 8192 rows."""

    def bits(x: np.ndarray) -> int:
        return int(np.abs(x).max(initial=0)).bit_length()

    if bits(a) + bits(b) + len(a).bit_length() <= 53:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)
    if bits(a) < bits(b):
        return exact_products(b, a).T
    return exact_products(a >> _LIMB, b) * (1 << _LIMB) + exact_products(a & ((1 << _LIMB) - 1), b)


def scatter(vectors: DataFrame, column: str, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums, and n G - S S' of the integer vectors. A task sends d (d + 3) / 2 + 1 rows."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, sums, products = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in slices(batches):
            u = integers(batch.column("x"), dim)
            n, sums, products = n + len(u), sums + u.sum(axis=0).astype(object), products + exact_products(u, u)
        if n:
            i = np.concatenate([[-1], np.full(dim, -1), upper[0]]).astype(np.int32)
            j = np.concatenate([[-1], np.arange(dim), upper[1]]).astype(np.int32)
            values = [Decimal(int(v)) for v in (n, *sums, *products[upper])]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(values, pa.decimal128(38, 0))], names=["i", "j", "v"])

    parts = vectors.select(F.col(column).alias("x")).mapInArrow(run, "i int, j int, v decimal(38,0)")
    n, sums, products = 0, [0] * dim, np.zeros((dim, dim), dtype=object)
    for r in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect():
        v = int(r["v"])
        if r["j"] < 0:
            n = v
        elif r["i"] < 0:
            sums[r["j"]] = v
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = v
    s = np.array(sums, dtype=object)
    return n, sums, products * n - np.outer(s, s)


def is_prime(n: int) -> bool:
    """Certain below 2^32 with these three witnesses."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 7, 61):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``bound``."""
    out, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo p, the constant first: Hessenberg form, then leading minors."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        h[[m, pivot]] = h[[pivot, m]]
        h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), dtype=np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        weights, below = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (weights[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d].tolist()


def polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(x I - matrix) of a positive semi-definite integer matrix, the constant first; a task per prime."""
    d, trace = len(matrix), int(np.trace(matrix))
    # sums of products of k of d non-negative roots are greatest if all are equal
    primes = primes_for(max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1)))
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [polynomial_mod(shared.value, p) for p in batch["p"].tolist()]
            yield pd.DataFrame({"p": batch["p"], "remainders": found})

    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    remainders = {r["p"]: r["remainders"] for r in table.mapInPandas(run, "p long, remainders array<long>").collect()}
    product = 1
    for p in primes:
        product *= p
    parts = [(p, product // p * pow(product // p, -1, p)) for p in primes]
    out = []
    for k in range(d + 1):  # coefficient of x^k has the sign of (-1)^(d - k)
        sign = -1 if (d - k) % 2 else 1
        out.append(sign * (sum(sign * remainders[p][k] % p * part for p, part in parts) % product))
    return out


def roots_above(coefficients: list[int], a: int) -> int:
    """Roots greater than a, with multiplicity, of a polynomial with real roots only: sign changes of p(x + a)."""
    c = list(coefficients)
    if a:
        for k in range(len(c) - 1):
            for i in range(len(c) - 2, k - 1, -1):
                c[i] += a * c[i + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolate(coefficients: list[int], k: int, bits: int = ROOT_BITS) -> tuple[int, int, int] | None:
    """(root times 2^shift, shift, number of larger roots) of the k-th largest root; None if it is not positive.

    Roots that agree in all bits asked for count as one root of several components."""
    if roots_above(coefficients, 0) < k:
        return None
    d = len(coefficients) - 1
    trace = -coefficients[d - 1]
    shift = max(0, bits - trace.bit_length())
    scaled = [c << (shift * (d - i)) for i, c in enumerate(coefficients)]
    low, high = 0, (trace << shift) + 1
    above_low, above_high = roots_above(scaled, 0), 0

    def value(x: int) -> int:
        out = 0
        for c in reversed(scaled):
            out = out * x + c
        return out

    while high - low > 1:
        middle = (low + high) // 2
        if above_low - above_high == 1:
            at = value(middle)  # above the root p has the sign of (-1)^(larger roots), as it has no other root here
            higher = at != 0 and (at > 0) != (above_high % 2 == 0)
        else:
            n = roots_above(scaled, middle)
            higher = n >= k
            if higher:
                above_low = n
            else:
                above_high = n
        low, high = (middle, high) if higher else (low, middle)
    return high, shift, above_high


def _solver(matrix: np.ndarray, root: int, shift: int):
    """Solves (matrix - root / 2^shift) x = b in fixed point, up to a factor."""
    d, size = len(matrix), root.bit_length()
    one = 1 << POINT_BITS
    a = np.array([[int(matrix[i, j]) << shift for j in range(d)] for i in range(d)], dtype=object)
    for i in range(d):
        a[i, i] -= root
    a = (a * one) >> size
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] * one) // a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :]) >> POINT_BITS

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for i in range(1, d):
            x[i] -= int((a[i, :i] * x[:i]).sum()) >> POINT_BITS
        for i in range(d - 1, -1, -1):
            rest = x[i] - (int((a[i, i + 1 :] * x[i + 1 :]).sum()) >> POINT_BITS if i + 1 < d else 0)
            x[i] = rest * one // a[i, i]
        return x

    return solve


def component(matrix: np.ndarray, root: int, shift: int, number: int = 0) -> list[float]:
    """Unit vector number ``number`` (from 0) of the null space of matrix - root / 2^shift, each entry rounded once."""
    d, one = len(matrix), 1 << POINT_BITS
    solve = _solver(matrix, root, shift)
    found: list[np.ndarray] = []

    def unit(v: np.ndarray) -> np.ndarray:
        most = max(abs(x) for x in v) or 1
        v = v * one // most
        for w in found:  # twice is enough
            v = v - (w * (int((v * w).sum()) >> POINT_BITS) >> POINT_BITS)
        length = isqrt(int((v * v).sum())) or 1
        return v * one // length

    for k in range(number + 1):
        v = np.array([one + (i * 7919 + k * 104729) % 1009 * (one >> 10) * (-1) ** (i // (k + 1)) for i in range(d)], dtype=object)
        for _ in range(3):
            v = unit(unit(solve(unit(v))))
        found.append(v)
    return [int(x) / one for x in found[-1]]


@dataclass
class Whitener:
    """n and sums of the fit list, unit components as columns, their eigenvalues and shares of the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]

    @property
    def dim(self) -> int:
        return len(self.sums)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all rows, which must have whole vectors; None for an empty table."""
    spark = vectors.sparkSession
    dim = dimension(vectors, column)
    if dim is None:
        return None
    n, sums, c = scatter(vectors, column, dim)
    divisor = 0
    for x in c.ravel():
        divisor = gcd(divisor, int(x))
    if not divisor:
        return Whitener(n, sums, np.zeros((dim, 0)), [], [])
    matrix = c // divisor
    coefficients = polynomial(spark, matrix)
    shared = spark.sparkContext.broadcast((matrix, coefficients))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, p = shared.value
        for batch in batches:
            rows = []
            for k in batch["k"].tolist():
                if (found := isolate(p, k)) is not None:
                    root, shift, larger = found
                    rows.append((k, str(root), shift, component(own, root, shift, k - larger - 1)))
            yield pd.DataFrame(rows, columns=["k", "root", "shift", "vector"])

    asked = spark.createDataFrame([(k,) for k in range(1, min(components, dim) + 1)], "k int").repartition(min(components, dim))
    found = sorted(asked.mapInPandas(run, "k int, root string, shift int, vector array<double>").collect(), key=lambda r: r["k"])
    trace = int(np.trace(matrix))
    return Whitener(
        n,
        sums,
        np.array([r["vector"] for r in found]).T.reshape(dim, len(found)),
        [int(r["root"]) * divisor / (n * n << r["shift"]) for r in found],
        [int(r["root"]) / (trace << r["shift"]) for r in found],
    )


def squared_lengths(v: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows of an integer matrix."""
    most, d = int(np.abs(v).max(initial=0)), v.shape[1]
    if v.dtype != object and most * most * d < 2**63:
        return (v * v).sum(axis=1).tolist()
    if v.dtype != object and most < 2**52 and d < 2**10:
        high, low = v >> 26, v & (2**26 - 1)
        sums = [(x * y).sum(axis=1).tolist() for x, y in ((high, high), (high, low), (low, low))]
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*sums)]
    return [int(x) for x in (v.astype(object) ** 2).sum(axis=1)]


def transform(vectors: DataFrame, model: Whitener, column: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>) of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            u = integers(batch.column("x"), own.dim)
            fits = own.n * int(np.abs(u).max(initial=0)) + max(map(abs, own.sums)) < 2**63
            kind = np.int64 if fits else object
            centred = u.astype(kind) * own.n - np.array(own.sums, dtype=kind)
            squares = [Decimal(x) if x < 10**38 else None for x in squared_lengths(centred)]
            whitened = (centred.astype(np.float64) / own.n) @ own.components / np.sqrt(own.eigenvalues)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(squares, pa.decimal128(38, 0)), as_lists(whitened)], names=["vec_id", "deviation", "whitened"]
            )

    narrow = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).alias("x"))
    return narrow.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(transformed: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    if not k:
        return 0.0
    means = transformed.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k))).first()
    centred = [F.col("whitened")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = transformed.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per whole vector and component."""
    vectors = whole_vectors(df, column)
    model = fit(vectors, column, components)
    k = len(model.eigenvalues) if model else 0
    if not k:
        return df.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        )
    rows = stored(transform(vectors, model, column))
    explained = F.array(*(F.lit(x) for x in model.explained))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return each.select(
        "vec_id", (F.col("_i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("_i")].alias("explained"), F.lit(identity_error(rows, k)).alias("identity_error"),
    )
