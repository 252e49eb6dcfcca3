"""Benchmark decontamination by a distributed positional inverted index.

:func:`build_index` cuts the corpus into segments (some megabytes of text each) and stores for every
term of a segment its posting list: the places where it stands, in one number line per segment on
which documents follow each other with gaps no match can cross. The index is a Parquet table in the
shared folder; it is built in one pass without a shuffle and can be searched again and again.

:func:`search` takes a query set, the benchmark items, in blocks of bounded size. Only posting lists of terms
that occur in items leave the table; they meet by segment. There every window of an item starts from its
rarest term: that term's list, moved by the term's offset, gives the possible places, and the lists of
the other terms, rarest first, are intersected with it. Windows with a term the segment does not have
are out at once. What remains are exact phrase matches; with ``slop`` also proximity matches, where every
word of a window stands within ``slop`` places of where the phrase has it.

Defined cases: null and empty texts have no words, hit nothing and keep their row; repeated rows are separate
documents (each gets its row); null item ids and items without words match nothing; texts of any length
belong to one segment, which then is larger; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import fresh, stored

#: Fixed value: what separates words (all of ASCII but digits and small letters).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 64  # places between two documents of a segment
INDEX = "segment long, term string, places binary, docs array<struct<doc_id:long,t:long,first:int,n_words:int>>"
HITS = "segment long, doc int, doc_id long, t long, n_words long, runs array<struct<first:int,last:int>>, items array<long>, near array<long>"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each the number of its text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    return flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def build_index(docs: DataFrame, segment_chars: int = 8_000_000) -> DataFrame:
    """The stored index over (doc_id, text). A segment closes once it holds ``segment_chars`` characters."""
    schema = pa.schema(
        [
            ("segment", pa.int64()),
            ("term", pa.string()),
            ("places", pa.binary()),
            ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("t", pa.int64()), ("first", pa.int32()), ("n_words", pa.int32())]))),
        ]
    )

    def one(number: int, whole: pa.Table) -> Iterator[pa.RecordBatch]:
        doc_ids, hashes, texts = (whole[c].combine_chunks() for c in ("doc_id", "t", "text"))
        flat, owner = words(texts)
        n_words = np.bincount(owner, minlength=len(texts)).astype(np.int32)
        before = np.concatenate([[0], np.cumsum(n_words)[:-1]]).astype(np.int32) if len(n_words) else n_words
        gaps = np.arange(len(texts), dtype=np.int32) * GAP
        rows = pa.StructArray.from_arrays(
            [doc_ids, hashes, pa.array(before + gaps, pa.int32()), pa.array(n_words)], ["doc_id", "t", "first", "n_words"]
        )
        listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), listed.cast(schema.field("docs").type)], schema=schema
        )
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable").astype(np.int32)
        places = (order + gaps[owner[order]]).astype("<i4")
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]) * 4
        lists = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(places)])
        for at in range(0, len(lists), 20_000):
            part = lists[at : at + 20_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), coded.dictionary[at : at + n], part, pa.nulls(n, schema.field("docs").type)], schema=schema
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held.append(batch.slice(at, 500))
                size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
                if size >= segment_chars:
                    yield from one(number, pa.Table.from_batches(held))
                    number, held, size = number + 1, [], 0
        if held:
            yield from one(number, pa.Table.from_batches(held))

    text = F.col("text").cast("string").alias("text")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), text)
    return stored(narrow.mapInArrow(run, INDEX))


class Windows:
    """The distinct windows of some items: a matrix of term numbers (-1 beyond a short window)."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int):
        found: dict[tuple[str, ...], set[int]] = {}
        for item_id, terms in items:
            for at in range(max(1, len(terms) - size + 1) if terms else 0):
                found.setdefault(tuple(terms[at : at + size]), set()).add(item_id)
        self.items = [sorted(ids) for ids in found.values()]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for w in found for t in w}))}
        self.terms = np.full((len(found), size), -1, dtype=np.int64)
        for row, window in zip(self.terms, found):
            row[: len(window)] = [self.vocabulary[t] for t in window]
        self.lengths = (self.terms >= 0).sum(axis=1)

    def matches(self, lists: dict[int, np.ndarray], line: np.ndarray, slop: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place) of all matches in one segment. ``line``: the term at each place, behind and before a margin
        of GAP. Candidates are worked on some million at a time."""
        if not len(self.terms):
            return
        many = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        for term, places in lists.items():
            many[term] = len(places)
        frequency = np.where(self.terms >= 0, many[self.terms], np.iinfo(np.int64).max)
        alive = np.flatnonzero(frequency.min(axis=1) > 0)
        order = np.argsort(frequency[alive], axis=1, kind="stable")
        rarest = self.terms[alive, order[:, 0]]
        cuts = np.searchsorted(np.cumsum(many[rarest] * (2 * slop + 1)), np.arange(most, many[rarest].sum() * (2 * slop + 1) + most, most))
        for part in np.split(np.arange(len(alive)), np.unique(cuts + 1)):
            if not len(part):
                continue
            places = np.concatenate([lists[t] - o for t, o in zip(rarest[part], order[part, 0])])
            which = np.repeat(part, many[rarest[part]])
            places = np.concatenate([places + d for d in range(-slop, slop + 1)])
            which = np.tile(which, 2 * slop + 1)
            for r in range(self.terms.shape[1]):
                at = order[which, r]
                term = self.terms[alive[which], at]
                here = places + at + GAP
                held = term < 0
                for d in range(-slop, slop + 1):
                    held |= line[np.clip(here + d, 0, len(line) - 1)] == term
                places, which = places[held], which[held]
            yield alive[which], places


def _search_segment(group: pd.DataFrame, windows: Windows, slop: int) -> pd.DataFrame:
    docs = next((d for d in group["docs"] if d is not None), [])
    ids = [d["doc_id"] for d in docs]
    first = np.array([d["first"] for d in docs], dtype=np.int64)
    n_words = np.array([d["n_words"] for d in docs], dtype=np.int64)
    end = int(first[-1] + n_words[-1]) if len(docs) else 0
    line = np.full(end + 2 * GAP, -2, dtype=np.int64)
    lists: dict[int, np.ndarray] = {}
    for term, raw in zip(group["term"], group["places"]):
        if term is not None and (number := windows.vocabulary.get(term)) is not None:
            lists[number] = np.frombuffer(raw, dtype="<i4").astype(np.int64)
            line[lists[number] + GAP] = number
    cover = np.zeros(end + 1, dtype=np.int32)
    found: list[set[int]] = [set() for _ in docs]
    near: list[set[int]] = [set() for _ in docs]
    for width in {0, slop}:
        for which, places in windows.matches(lists, line, width):
            if width == 0:
                np.add.at(cover, places, 1)
                np.add.at(cover, places + windows.lengths[which], -1)
            # a proximity match may begin just before its document
            owner = np.searchsorted(first, places + width, side="right") - 1
            for doc, window in set(zip(owner.tolist(), which.tolist())):
                (near if width else found)[doc].update(windows.items[window])
    hit = np.concatenate([[0], np.cumsum(cover) > 0, [0]]).astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    owner = np.searchsorted(first, starts, side="right") - 1
    runs: list[list[dict]] = [[] for _ in docs]
    for doc, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist()):
        runs[doc].append({"first": a - int(first[doc]), "last": b - int(first[doc])})
    return pd.DataFrame(
        {
            "segment": int(group["segment"].iloc[0]),
            "doc": np.arange(len(docs), dtype=np.int32),
            "doc_id": pd.array(ids, dtype="Int64"),
            "t": np.array([d["t"] for d in docs], dtype=np.int64),
            "n_words": n_words,
            "runs": runs,
            "items": [sorted(x) for x in found],
            "near": [sorted(x | y) for x, y in zip(found, near)] if slop else [[] for _ in docs],
        }
    )


def _searcher(held: Broadcast, slop: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        return _search_segment(group, held.value, slop)

    return one


def search(index: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, block_words: int = 1_000_000) -> DataFrame:
    """Per document (segment, doc, doc_id, t - a hash of its text -, n_words): the hit word runs and the items with exact and with near matches.

    ``items`` is (item_id, text). They are split by a hash of their id into blocks of about ``block_words`` words,
    and each block is one pass over the index with windows of that size in the tasks; ``2 * slop + size`` must stay below GAP.
    """
    if size + 2 * slop >= GAP:
        raise ValueError("windows must be shorter than the gap between documents")
    cleaned = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]", " ")
    total = items.agg(F.sum(F.length(cleaned)).alias("n")).first()["n"] or 0
    blocks = int(total // (4 * block_words)) + 1
    spark = items.sparkSession
    found: DataFrame | None = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text").collect()
        flat, owner = words(pa.array([r["text"] for r in rows], pa.string()))
        terms: list[list[str]] = [[] for _ in rows]
        for term, k in zip(flat.to_pylist(), owner.tolist()):
            terms[k].append(term)
        windows = Windows([(r["item_id"], t) for r, t in zip(rows, terms) if r["item_id"] is not None], size)
        held = spark.sparkContext.broadcast(windows)
        vocabulary = stored(spark.createDataFrame([(t,) for t in windows.vocabulary], "term string"))
        wanted = index.join(vocabulary, "term", "left_semi").select("segment", "term", "places", "docs")
        wanted = wanted.unionByName(index.where("term IS NULL").select("segment", "term", "places", "docs"))
        hits = wanted.groupBy("segment").applyInPandas(_searcher(held, slop), HITS)
        found = hits if found is None else found.unionByName(hits)
    if blocks == 1:
        return found
    merged = found.groupBy("segment", "doc").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("t").alias("t"),
        F.first("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "items", "near")],  # a list per block
    )
    return merged


def verdicts(hits: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) per document."""
    merged = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(a["last"], r["first"]))).alias("n"),
            F.greatest(a["last"], r["last"]).alias("last"),
        ),
        lambda a: a["n"],
    )
    names = F.array_sort(F.array_distinct(F.transform("items", lambda x: x.cast("string"))))
    return hits.select(
        "doc_id",
        "n_words",
        merged.cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        F.size(F.array_distinct("near")).cast("long").alias("n_near_items"),
    )


def drop_hit(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without those that hold a window of an item; all columns as they are."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    hits = search(build_index(docs), items, size).where(F.size("runs") > 0).select(key.alias("d"), "t").distinct()
    row = fresh(docs, "_row")
    keyed = docs.select(F.struct("*").alias(row), key.alias("d"), F.xxhash64("text").alias("t"))
    return keyed.join(stored(hits), ["d", "t"], "left_anti").select(f"{row}.*")
