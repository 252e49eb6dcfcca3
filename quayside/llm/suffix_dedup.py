"""Byte-exact removal of repeated passages with a logarithmic family of sparse suffix arrays.

Every byte covered by a string of ``length`` bytes that starts anywhere else, too, is removed. Not all suffixes need an index entry: each
window of ``length`` bytes elects the place in it whose next ``gram`` bytes have the least hash, so windows with equal bytes elect equal places
(winnowing; about one place in seventy with the defaults). Only suffixes at elected places are indexed. An entry has the first 16 bytes of the suffix
as two words, a hash of its first ``gram`` bytes, which windows elected it (an unbroken run), and a hash of all bytes those windows cover.

A suffix array has one row for all suffixes that begin with the same ``gram`` bytes, in the order of the first bytes (and of the hash, where those
agree), cut into ranges of first bytes at borders that all arrays of a family share. New documents come in batches. A batch's array is merge-scanned
with each level of the family, range by range: where two rows that become neighbours have equal beginnings, their common prefix is ``gram`` bytes
or longer. Then the batch becomes a level; two levels of one size merge into one of the double size, so there are logarithmically many. Levels,
entries and what was found are stored tables in the family's folder, with a list of them, so a family can be opened again and
goes on with further batches.

Entries without a match cannot be part of a repetition. Of the others, those that agree with another one in all
bytes of their windows are repeated as a whole. Where a class of equal first bytes has different surroundings, the windows of one entry
of each kind are compared one by one, by hashes of all their bytes. Positions are judged on the input, never on what is left.

Defined cases: a null text counts as empty; texts below ``length`` bytes lose nothing; rows with equal doc_id and text are separate documents
(so long ones remove each other); null ids are ids like others; an empty table gives an empty result; texts of any
length are read whole, as UTF-8; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import stored
from quayside.session import shared_dir
from quayside.sources.stores import open_store

LENGTH, GRAM = 400, 250
CHUNK = 2_000_000
#: A kind that has one in so many of all matched entries or more is dealt to several tasks; there are at most so many such kinds.
FREQUENT = 1000
#: Order of suffixes: by the first 16 bytes as two words (shifted to signed numbers), then by the hash of the gram.
ORDER = ("h1", "h2", "g")
ENTRIES = "h1 long, h2 long, g long, nh long, d long, t long, p int, lo int, span int"
#: Rows of the first batch for each range of an array.
RANGE = 50_000
WINDOWS = "g long, d long, t long, first int, offset int, hashes array<long>, many boolean"
MARKS = "d long, t long, first int, last int"
_PLACE_BITS = np.uint64(30)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def of(x: int) -> np.ndarray:
        out = np.full(n + 1, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    values = np.random.default_rng(400).integers(1, 2**64, 256, dtype=np.uint64)
    return of(_BASE), of(pow(_BASE, -1, 2**64)), values


class Hashes:
    """64-bit hashes of any substring of some bytes, from sums over prefixes."""

    def __init__(self, raw: np.ndarray):
        up, self.down, values = _powers(max(2 * CHUNK, 1 << int(len(raw)).bit_length()))
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(values[raw] * up[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def elected(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, first window, last window, hash of the gram, hash of all bytes of the windows) of each elected place."""
    hashes, n = Hashes(raw), len(raw)
    if n < length:
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    # the least hash, and of equal ones the leftmost; the place rides along in the low bits
    least = (grams >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    s = np.arange(len(least))
    text = np.searchsorted(ends, s, side="right")
    inside = s + length <= ends[np.minimum(text, len(ends) - 1)]
    s, text = s[inside], text[inside]
    place = (least[inside] & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)])) if len(s) else s
    last = np.append(first[1:], len(s)) - 1 if len(s) else s
    a, b, p = s[first], s[last], place[first]
    return text[first], p, a, b, grams[p], hashes.of(a, b + length)


def _doc_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("t")]


def _bytes() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows until their bytes fill a chunk."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("raw")).to_numpy(zero_copy_only=False))
        begin = 0
        for k, total in enumerate(lengths.tolist()):
            if size + total >= CHUNK:
                held.append(batch.slice(begin, k + 1 - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], -total, k + 1
        size += int(lengths[-1]) if len(lengths) else 0
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _joined(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and where each row ends."""
    rows = chunk["raw"].to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint8), np.cumsum([len(r) for r in rows])


def entries(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Index entries: first words, hash of the gram, hash of the surroundings, document, place, windows before it and their number - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            raw, ends = _joined(chunk)
            text, p, a, b, g, nh = elected(raw, ends, length, gram)
            begin = np.concatenate([[0], ends[:-1]])[text] if len(text) else text
            take = pa.array(text)
            head = np.zeros((len(p), 16), dtype=np.uint8)
            head[:, : min(16, gram)] = raw[p[:, None] + np.arange(min(16, gram))]
            first = head.view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(first[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(first[:, 1]).view(np.int64)), pa.array(g.view(np.int64)), pa.array(nh.view(np.int64)), chunk["d"].combine_chunks().take(take), chunk["t"].combine_chunks().take(take),
                    pa.array((p - begin).astype(np.int32)), pa.array((p - a).astype(np.int32)), pa.array((b - a).astype(np.int32)),
                ],
                names=["h1", "h2", "g", "nh", "d", "t", "p", "lo", "span"],
            )

    return docs.select(*_doc_key(), _bytes()).mapInArrow(run, ENTRIES)


class SuffixFamily:
    """Stored levels of suffix arrays, of sizes 1, 2, 4 ... batches, all entries, and the beginnings that were met twice.

    ``levels`` maps a size (its logarithm) to the name of an array; ``borders`` are first words at which ranges begin."""

    def __init__(self, spark: SparkSession, path: str, known: dict):
        self.spark, self.path, self.known = spark, path, known

    @classmethod
    def create(cls, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM) -> SuffixFamily:
        return cls(spark, path, {"length": length, "gram": gram, "borders": None, "levels": {}, "arrays": [], "found": [], "entries": []})

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuffixFamily:
        place, base = open_store(path)
        with place.open_input_stream(f"{base}/family.json") as source:
            return cls(spark, path, json.loads(source.read()))

    def _save(self) -> None:
        place, base = open_store(self.path)
        place.create_dir(base, recursive=True)
        with place.open_output_stream(f"{base}/family.json") as out:
            out.write(json.dumps(self.known).encode())

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def add(self, docs: DataFrame, batches: int = 1) -> None:
        """Indexes documents and scans them against all that is in the family."""
        if self.known.get("ended"):
            raise ValueError("the arrays of this family are gone; it takes no further batch")
        name = f"entries-{len(self.known['entries'])}"
        entries(docs, self.known["length"], self.known["gram"]).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.known["entries"].append(name)
        index = self._table(name, ENTRIES)
        for k in range(batches):
            self._add(index.where(F.pmod(F.xxhash64("d", "t"), F.lit(batches)) == k))
        self._save()

    def _add(self, batch: DataFrame) -> None:
        classes = batch.groupBy(*ORDER).agg(F.count("*").alias("n"))
        if self.known["borders"] is None:
            classes = stored(classes)
            ranges = max(8, classes.count() // RANGE)
            cuts = classes.approxQuantile("h1", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
            self.known["borders"] = sorted({max(-(2**63), min(int(x), 2**63 - 1)) for x in cuts})
        array = self._write(classes)
        self.known["found"].append(self._scan([array], 1))  # beginnings that the batch itself has twice
        for level in self.known["levels"].values():
            self.known["found"].append(self._scan([array, level], 2))
        size, merged = 0, array
        while str(size) in self.known["levels"]:
            other = self.known["levels"].pop(str(size))
            both, size = [merged, other], size + 1
            merged = self._merge(both)
            for name in both:  # all that they had is in the merged one
                place, base = open_store(self.path)
                place.delete_dir(f"{base}/{name}")
        self.known["levels"][str(size)] = merged

    def _name(self, kind: str) -> str:
        name = f"{kind}-{len(self.known['arrays'])}"
        self.known["arrays"].append(name)
        return name

    def _write(self, classes: DataFrame) -> str:
        """The rows as an array: a folder per range, sorted."""
        borders = F.array(*[F.lit(x) for x in self.known["borders"]]).cast("array<long>")
        ranged = classes.withColumn("range", F.size(F.filter(borders, lambda x: x <= F.col("h1"))))
        name = self._name("array")
        spread = ranged.repartitionById(len(self.known["borders"]) + 1, "range").sortWithinPartitions("range", *ORDER)
        spread.write.option("compression", "zstd").partitionBy("range").parquet(f"{self.path}/{name}")
        return name

    def _ranges(self) -> DataFrame:
        n = len(self.known["borders"]) + 1
        return self.spark.range(n).select(F.col("id").cast("int").alias("range")).repartitionById(n, "range")

    def _scan(self, arrays: list[str], least: int) -> str:
        """Stored beginnings (g) that stand in both arrays, or twice in one."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column("range").to_pylist():
                    order, rows = _merged([_read_range(path, name, number) for name in arrays])
                    if len(arrays) == 1:
                        hit = rows["n"] > 1
                    else:  # neighbours with equal beginnings are from both: an array has each but once
                        hit = np.concatenate([_common(rows, order), [False]])[: len(order)]
                        rows = {c: v[order] for c, v in rows.items()}
                    yield pa.RecordBatch.from_arrays([pa.array(rows["g"][hit])], names=["g"])

        name = self._name("found")
        self._ranges().mapInArrow(run, "g long").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _merge(self, arrays: list[str]) -> str:
        """One array of two, range by range; no row leaves its range."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column("range").to_pylist():
                    order, rows = _merged([_read_range(path, name, number) for name in arrays])
                    first = np.concatenate([[True], ~_common(rows, order)])[: len(order)]
                    at = np.flatnonzero(first)
                    sums = np.add.reduceat(rows["n"][order], at) if len(at) else rows["n"]
                    columns = [pa.array(rows[c][order[at]]) for c in ORDER] + [pa.array(sums), pa.array(np.full(len(at), number, dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*ORDER, "n", "range"])

        name = self._name("array")
        merged = self._ranges().mapInArrow(run, "h1 long, h2 long, g long, n long, range int")
        merged.write.option("compression", "zstd").partitionBy("range").parquet(f"{self.path}/{name}")
        return name

    def end(self) -> None:
        """Deletes the arrays: a family that gets no further batch needs its entries and what was found only."""
        place, base = open_store(self.path)
        for name in self.known["levels"].values():
            place.delete_dir(f"{base}/{name}")
        self.known |= {"levels": {}, "ended": True}
        self._save()

    def entries(self) -> DataFrame:
        """All entries of all batches."""
        out = self._table(self.known["entries"][0], ENTRIES)
        for name in self.known["entries"][1:]:
            out = out.unionByName(self._table(name, ENTRIES))
        return out

    def repeated(self) -> DataFrame:
        """Beginnings that two suffixes of the family have."""
        out = self._table(self.known["found"][0], "g long")
        for name in self.known["found"][1:]:
            out = out.unionByName(self._table(name, "g long"))
        return stored(out.distinct())

    def matched(self) -> DataFrame:
        """Stored entries whose beginning another suffix of the family has, too. Their order is of no more use, so its words are not moved."""
        columns = [c for c in self.entries().columns if c not in ("h1", "h2")]
        return stored(self.entries().select(*columns).join(self.repeated(), "g", "left_semi").select(*columns))

    def delete(self) -> None:
        """Deletes the folder, for a family that nobody will open again."""
        place, base = open_store(self.path)
        place.delete_dir(base)


def _read_range(path: str, name: str, number: int) -> dict[str, np.ndarray]:
    """One range of a stored array, in order."""
    place, base = open_store(path)
    folder = f"{base}/{name}/range={number}"
    files = sorted(f.path for f in place.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet"))
    if not files:
        return {c: np.zeros(0, dtype=np.int64) for c in (*ORDER, "n")}
    table = pa.concat_tables([pq.read_table(f, columns=[*ORDER, "n"], filesystem=place, partitioning=None) for f in files])
    return {c: table[c].to_numpy() for c in (*ORDER, "n")}


def _merged(arrays: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """All rows, and their order as suffixes. Sorted runs are what a stable sort merges."""
    rows = {c: np.concatenate([a[c] for a in arrays]) for c in arrays[0]}
    return np.lexsort([rows[c] for c in reversed(ORDER)]), rows


def _common(rows: dict[str, np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each row and the next have a common prefix of a whole gram."""
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for c in ORDER:
        same &= rows[c][order][1:] == rows[c][order][:-1]
    return same


def _equal_windows(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of the windows of some classes those with an equal one of their class at the same offset from the elected place."""
    hashes = np.concatenate([np.asarray(h) for h in group["hashes"]])
    n = np.array([len(h) for h in group["hashes"]])
    member = np.repeat(np.arange(len(group)), n)
    within = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    offset, g = group["offset"].to_numpy()[member] + within, group["g"].to_numpy()[member]
    order = np.lexsort((hashes, offset, g))
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for values in (hashes, offset, g):
        same &= values[order][1:] == values[order][:-1]
    twice = np.zeros(len(hashes), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return pd.DataFrame({"d": [], "t": [], "first": [], "last": []}).astype({"d": "int64", "t": "int64", "first": "int32", "last": "int32"})
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (member[at][1:] != member[at][:-1])]))
    end = np.append(new[1:], len(at)) - 1
    who = group.iloc[member[at[new]]]
    first = group["first"].to_numpy()[member] + within
    return pd.DataFrame(
        {"d": who["d"].to_numpy(), "t": who["t"].to_numpy(), "first": first[at[new]].astype(np.int32), "last": (first[at[end]] + length).astype(np.int32)}
    )


def _repeated_kinds(groups: DataFrame, kind: list[str]) -> DataFrame:
    """Kinds that occur more than once; ``more`` is the number of salts after the first one, above 0 for ``FREQUENT`` kinds at most."""
    least = max(1, -(-(groups.agg(F.sum("c")).first()[0] or 0) // FREQUENT))
    return groups.where("c > 1").select(*kind, F.floor(F.col("c") / least).cast("int").alias("more"))


def _whole(matched: DataFrame, groups: DataFrame, kind: list[str]) -> DataFrame:
    """Matched entries whose kind occurs more than once. A passage of every document is one kind: the entries of a frequent
    kind are dealt by salts, as many as it needs, and only such a kind stands there once for each of its salts."""
    repeated = _repeated_kinds(groups, kind)
    salted = repeated.select(*kind, F.explode(F.sequence(F.lit(0), "more")).alias("salt"))
    own = matched.join(F.broadcast(repeated.where("more > 0")), kind, "left")
    own = own.withColumn("salt", F.pmod(F.xxhash64("d", "t", "p"), F.coalesce("more", F.lit(0)) + 1).cast("int"))
    return own.join(salted, [*kind, "salt"], "left_semi")


def repeated_runs(docs: DataFrame, matched: DataFrame, length: int = LENGTH, most_in_task: int = 20_000) -> DataFrame:
    """(d, t, first, last): stretches of bytes to remove, some overlapping. ``docs`` are all documents that the family of ``matched`` was given."""
    kind = ["g", "nh", "lo", "span"]
    one = F.min(F.struct("d", "t", "p")).alias("one")
    groups = stored(matched.groupBy(*kind).agg(F.count("*").alias("c"), one))
    begin = F.col("p") - F.col("lo")
    whole = _whole(matched, groups, kind).select("d", "t", begin.alias("first"), (begin + F.col("span") + length).alias("last"))
    # classes with several surroundings: one entry of each kind shows its windows
    open_classes = stored(groups.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"))
    shown = groups.join(open_classes, "g").select("one.d", "one.t", F.struct("g", "one.p", "lo", "span", (F.col("k") > most_in_task).alias("many")).alias("e"))
    by_doc = stored(shown.groupBy("d", "t").agg(F.collect_list("e").alias("es")))

    def show(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for d, t, raw, es in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "raw", "es"))):
                hashes = Hashes(np.frombuffer(raw, dtype=np.uint8))
                rows = []
                for e in es:
                    a = e["p"] - e["lo"]
                    s = np.arange(a, a + e["span"] + 1)
                    rows.append((e["g"], d, t, a, -e["lo"], hashes.of(s, s + length).view(np.int64), e["many"]))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=["g", "d", "t", "first", "offset", "hashes", "many"])

    texts = docs.select(*_doc_key(), _bytes())
    windows = stored(texts.join(by_doc, ["d", "t"]).select("d", "t", "raw", "es").mapInArrow(show, WINDOWS))
    few = windows.where("NOT many").select("g", "d", "t", "first", "offset", "hashes")
    shares = few.count() // most_in_task + 1  # whole classes, so that a task has some ten thousand entries at a time
    few = few.groupBy(F.pmod(F.xxhash64("g"), F.lit(shares)).alias("share")).applyInPandas(lambda group: _equal_windows(group, length), MARKS)
    # classes too large for one task: a row per window
    each = windows.where("many").select("g", "d", "t", "first", "offset", F.posexplode("hashes").alias("i", "h"))
    each = each.select("g", (F.col("offset") + F.col("i")).alias("o"), "h", "d", "t", (F.col("first") + F.col("i")).alias("first"))
    twice = stored(each.groupBy("g", "o", "h").agg(F.count("*").alias("n")).where("n > 1").select("g", "o", "h"))
    many = each.join(twice, ["g", "o", "h"], "left_semi").select("d", "t", "first", (F.col("first") + length).alias("last"))
    return whole.unionByName(few).unionByName(many)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = 4, most_in_task: int = 20_000, family: SuffixFamily | None = None
) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256) of every document; ``kept`` has the remaining bytes.

    With a ``family`` ``docs`` are all documents that it was given so far; without one they make up a family of their own."""
    own = family is None
    if own:
        family = SuffixFamily.create(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/suffixes-{uuid.uuid4().hex}", length, gram)
        family.add(docs, batches)
        family.end()
    matched = family.matched()
    if own:  # its entries would lie beside all that follows
        family.delete()
    runs = repeated_runs(docs, matched, family.known["length"], most_in_task).select("d", "t", F.struct("first", "last").alias("run"))
    by_doc = stored(runs.groupBy("d", "t").agg(F.array_sort(F.collect_set("run")).alias("runs")))  # at most a document's places
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_doc_key(), _bytes())

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for doc_id, raw, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "raw", "runs"))):
                kept, at, removed, spans = [], 0, 0, 0
                end = -1
                for r in own or []:
                    if r["first"] > end:  # a new span
                        kept.append(raw[max(end, 0) : r["first"]])
                        spans, at = spans + 1, r["first"]
                        end = r["last"]
                        removed += end - at
                    elif r["last"] > end:
                        removed += r["last"] - end
                        end = r["last"]
                kept.append(raw[max(end, 0) :])
                rest = b"".join(kept)
                rows.append((doc_id, rest, len(raw), removed, spans, hashlib.sha256(rest).hexdigest()))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both = texts.join(by_doc, ["d", "t"], "left").select("doc_id", "raw", "runs")
    return both.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
