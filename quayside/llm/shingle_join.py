"""Jaccard self-join of word shingles by adaptive multi-match prefixes, and the components of its links.

Two sets with similarity of at least 0.8 that are sorted by one global order share a token among the first
n - ceil(0.8 n) + 1 of either; and for any l they share at least l tokens among the first n - ceil(0.8 n) + l. A
longer prefix costs more list entries but admits fewer candidates to verification. Each document takes
the l of least estimated cost, from how often its prefix tokens occur; a pair is verified if it shares
as many tokens as the smaller l of the two asks for, among the tokens that belong to that prefix of both.

The global order is rarest first. :func:`token_lists` counts all shingles of the corpus: tokens travel in sorted blocks, one
per batch of texts and range of the hash space, and only those that occur in several documents travel back. Shingles
of one document alone come first in the order, so a document with more than a fifth of these matches nothing and leaves.
A token that stands in a sixteenth of the documents of some batch is *hot*: batches send it once, not once per
document, and it comes last in the order.

Documents with equal sets are one class and go on as one. Groups of near copies are not paired all with all: in each of the first rounds
every document is verified against one leader of a list it shares, and what is linked is one component; only pairs
of different components are enumerated in the last round, and of those only pairs that can be similar by their sizes and by
how many of their tokens occur elsewhere at all. Links within a component cannot change it, so none is lost.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; fewer than five words are one shingle;
repeated rows are separate documents (with equal sets, so linked); null doc_ids are never the smallest id, and a component with no
other id has none; an empty table gives an empty result; texts of any length are hashed whole; extra columns do not matter.
Tokens have 32 + ``range_bits`` bits of a 64-bit hash; the range bits follow the number of documents, so that a task counts the tokens of some
thousand documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import fresh, range_bits_of, stored
from quayside.llm.components import components

BLOCKS = (
    "part int, batch long, rest binary, doc binary, doc_ids array<long>, texts array<long>, sizes array<int>, hot_doc binary, hot_token binary"
)
COUNTED = BLOCKS + ", times binary"
LISTS = "row long, doc_id long, t long, n long, tokens array<long>, times array<long>"
HOT_DOC = 0xFFFF  # stands for all documents of a batch that have a hot token
HOT_TIMES = 2**40
MOST_DOCS, MOST_CHARS = 4000, 4_000_000


def shingle_hashes(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the distinct shingles of each text, sorted by both."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), r"[\x20\x09-\x0D]+")
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    owner = owner[full]
    of_word = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    h = of_word[coded.indices.to_numpy()] if len(owner) else np.zeros(0, dtype=np.uint64)
    counts = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    size = np.minimum(counts, words)
    n = np.where(counts > 0, counts - size + 1, 0)
    which = np.repeat(np.arange(len(texts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[which]
    s = np.full(len(start), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            there = k < size[which]
            s = np.where(there, (s ^ h[np.minimum(start + k, len(h) - 1)]) * np.uint64(0xD6E8FEB86659FD93), s)
            s ^= np.where(there, s >> np.uint64(32), np.uint64(0))
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(29)
    order = np.lexsort((s, which))
    which, s = which[order], s[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (which[1:] != which[:-1])
    return which[new], s[new]


def _blocks(docs: DataFrame, range_bits: int) -> DataFrame:
    """A row per batch of documents and hash range with the tokens there, and a row per batch with its documents."""
    ranges = 1 << range_bits

    def one(batch: int, part: pa.Table) -> Iterator[pd.DataFrame]:
        which, s = shingle_hashes(part["text"].combine_chunks())
        n_docs = part.num_rows
        sizes = np.bincount(which, minlength=n_docs)
        token = s >> np.uint64(32 - range_bits)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], which[order].astype(np.uint16)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=int)
        times = np.diff(np.append(first, len(token)))
        many = np.repeat(times >= max(8, n_docs // 16), times)
        hot_doc, hot_token = doc[many], token[many]
        once = ~many
        once[first[times >= max(8, n_docs // 16)]] = True
        doc = np.where(many, np.uint16(HOT_DOC), doc)[once]
        token = token[once]
        cuts = np.searchsorted(token, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
        parts = np.flatnonzero(np.diff(cuts))
        rest = (token & np.uint64(0xFFFFFFFF)).astype("<u4")
        frame = pd.DataFrame(
            {
                "part": parts.astype(np.int32),
                "batch": batch,
                "rest": [rest[cuts[p] : cuts[p + 1]].tobytes() for p in parts],
                "doc": [doc[cuts[p] : cuts[p + 1]].tobytes() for p in parts],
            }
        )
        owner = {
            "part": (batch >> 32) * 31 + (batch & 0xFFFF) & (ranges - 1), "batch": batch, "rest": None, "doc": None,
            "doc_ids": part["doc_id"].to_pylist(), "texts": part["t"].to_pylist(), "sizes": sizes.tolist(),
            "hot_doc": hot_doc.tobytes(), "hot_token": hot_token.tobytes(),
        }
        names = ["part", "batch", "rest", "doc", "doc_ids", "texts", "sizes", "hot_doc", "hot_token"]
        yield pd.concat([frame.astype(object), pd.DataFrame([owner])], ignore_index=True).reindex(columns=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        chars = rows = 0
        for b in batches:
            for at in range(0, b.num_rows, 100):
                held.append(b.slice(at, 100))
                chars += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
                rows += held[-1].num_rows
                if chars >= MOST_CHARS or rows + 100 > MOST_DOCS:
                    yield from map(_to_arrow, one(batch, pa.Table.from_batches(held)))
                    held, chars, rows, batch = [], 0, 0, batch + 1
        if held:
            yield from map(_to_arrow, one(batch, pa.Table.from_batches(held)))

    def _to_arrow(frame: pd.DataFrame) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        arrays = [pa.array([None if x is None or x is np.nan else x for x in frame[c]], t) for c, t in zip(frame.columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=list(frame.columns))

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("t"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return narrow.mapInArrow(run, BLOCKS)


def _count_range(group: pd.DataFrame) -> pd.DataFrame:
    """Of the tokens of one hash range those in several documents, back to their batches, with their counts."""
    blocks = group[group["rest"].notna()]
    out = [group[group["rest"].isna()].assign(times=None)]
    if len(blocks):
        rest = np.concatenate([np.frombuffer(x, dtype="<u4") for x in blocks["rest"]])
        doc = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in blocks["doc"]])
        source = np.repeat(np.arange(len(blocks)), [len(x) // 4 for x in blocks["rest"]])
        order = np.argsort(rest, kind="stable")
        rest, doc, source = rest[order], doc[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        times = np.diff(np.append(first, len(rest)))
        hot = np.maximum.reduceat((doc == HOT_DOC).astype(np.int8), first) > 0
        of_token = np.where(hot, 0, np.minimum(times, 2**32 - 1)).astype("<u4")  # 0: hot
        back = np.repeat((times > 1) | hot, times) & (doc != HOT_DOC)
        each = np.repeat(of_token, times)[back]
        rest, doc, source = rest[back], doc[back], source[back]
        order = np.argsort(source, kind="stable")
        rest, doc, source, each = rest[order], doc[order], source[order], each[order]
        cuts = np.searchsorted(source, np.arange(len(blocks) + 1))
        rows = np.flatnonzero(np.diff(cuts))
        out.append(
            blocks.iloc[rows].assign(
                rest=[rest[cuts[k] : cuts[k + 1]].tobytes() for k in rows],
                doc=[doc[cuts[k] : cuts[k + 1]].tobytes() for k in rows],
                times=[each[cuts[k] : cuts[k + 1]].tobytes() for k in rows],
            )
        )
    return pd.concat(out)


def _lists(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Documents of one batch; tokens, in global order, of those that can match at all."""
    owner = group[group["rest"].isna()].iloc[0]
    blocks = group[group["rest"].notna()]
    sizes = np.asarray(owner["sizes"], dtype=np.int64)
    joined = lambda c, t: np.frombuffer(b"".join(blocks[c]), dtype=t)
    part = np.repeat(blocks["part"].to_numpy(dtype=np.int64), [len(x) // 4 for x in blocks["rest"]])
    token = (part << 32) | joined("rest", "<u4").astype(np.int64)
    doc = joined("doc", np.uint16).astype(np.int64)
    times = joined("times", "<u4").astype(np.int64)
    hot_token = np.frombuffer(owner["hot_token"], dtype="<u8").astype(np.int64)
    token = np.concatenate([token, hot_token])
    doc = np.concatenate([doc, np.frombuffer(owner["hot_doc"], dtype=np.uint16).astype(np.int64)])
    times = np.concatenate([np.where(times == 0, HOT_TIMES, times), np.full(len(hot_token), HOT_TIMES)])
    order = np.lexsort((token, times, doc))
    token, doc, times = token[order], doc[order], times[order]
    shared = np.bincount(doc, minlength=len(sizes))
    cuts = np.concatenate([[0], np.cumsum(shared)])
    able = (sizes > 0) & (100 * shared >= percent * sizes)
    return pd.DataFrame(
        {
            "row": (int(owner["batch"]) << 16) + np.arange(len(sizes)),
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in owner["doc_ids"]], dtype="Int64"),
            "t": np.asarray(owner["texts"], dtype=np.int64),
            "n": sizes,
            "tokens": [token[cuts[k] : cuts[k + 1]] if ok else None for k, ok in enumerate(able)],
            "times": [times[cuts[k] : cuts[k + 1]] if ok else None for k, ok in enumerate(able)],
        }
    )


def token_lists(docs: DataFrame, percent: int = 80, range_bits: int | None = None) -> DataFrame:
    """Stored (row, doc_id, t, n, tokens, times): for every document its number of distinct shingles, and, if it
    shares enough of them with others to match, the shared tokens in global order and how often each occurs."""
    counted = _blocks(docs, range_bits_of(docs) if range_bits is None else range_bits).groupBy("part").applyInPandas(_count_range, COUNTED)
    return stored(counted.groupBy("batch").applyInPandas(lambda group: _lists(group, percent), LISTS))


def prefixes(classes: DataFrame, percent: int, longest: int = 4, verify_cost: int = 20) -> DataFrame:
    """(token, row, n, most, level, asked): the prefix tokens of each document. ``asked`` is its l, the prefix length of least estimated
    cost; ``level`` is the shortest l-prefix a token belongs to, for a partner of the least possible size; for larger partners, of which more must be
    shared, prefixes are shorter, and tokens of a level below one may still be in.

    The cost of l is the number of entries in the lists of its prefix plus, for each candidate these may give (entries / l, since a
    candidate needs l of them), ``verify_cost``."""
    least = F.ceil(F.col("n") * percent / 100)  # tokens that a partner must share
    alone = F.col("n") - F.size("tokens")
    one = F.greatest(F.lit(0), F.col("n") - least + 1 - alone).cast("int")  # shared tokens in the 1-prefix
    work = classes.select("row", "n", "most", "tokens", "times", one.alias("one"), F.least(F.lit(longest), least).cast("int").alias("longest"))

    def cost(k: int):
        entries = F.aggregate(F.slice("times", 1, F.col("one") + k - 1), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.lit(k) <= F.col("longest"), entries * (1 + verify_cost / k))

    costs = work.select("row", "n", "most", "tokens", "one", F.array(*[cost(k) for k in range(1, longest + 1)]).alias("costs"))
    asked = F.array_position("costs", F.array_min("costs")).cast("int").alias("asked")
    taken = costs.select("row", "n", "most", "tokens", "one", asked)
    each = taken.select("row", "n", "most", "one", "asked", F.posexplode(F.slice("tokens", 1, F.col("one") + F.col("asked") - 1)).alias("p", "token"))
    return each.select("token", "row", "n", "most", (F.col("p") + 2 - F.col("one")).alias("level"), "asked")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, from their whole token lists."""
    sets = classes.select("row", "n", "tokens")
    left = pairs.select("a", "b").join(sets.select(F.col("row").alias("a"), F.col("n").alias("n1"), F.col("tokens").alias("t1")), "a")
    both = left.join(sets.select(F.col("row").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("t2")), "b")
    common = both.select("a", "b", "n1", "n2", F.size(F.array_intersect("t1", "t2")).cast("long").alias("c"))
    return stored(common.where(100 * F.col("c") >= percent * (F.col("n1") + F.col("n2") - F.col("c"))).select("a", "b"))


def linked_rows(lists: DataFrame, percent: int = 80, rounds: int = 2) -> DataFrame:
    """(v, l): rows that are linked with others, and the least row of their component."""
    able = lists.where("tokens IS NOT NULL")
    full = able.where(F.size("tokens") == F.col("n"))
    exact = full.select("row", "n", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(7), F.col("tokens")).alias("h2"))
    firsts = stored(exact.groupBy("n", "h1", "h2").agg(F.min("row").alias("least"), F.count("*").alias("k")).where("k > 1"))
    copies = stored(exact.join(firsts, ["n", "h1", "h2"]).select(F.col("row").alias("a"), F.col("least").alias("b"), "k"))
    known = able.join(copies.withColumnRenamed("a", "row"), "row", "left").where("b IS NULL OR b = row")
    # what a class can share with others at most: tokens that occur in more documents than its own
    shared = F.size(F.filter("times", lambda x: x > F.coalesce("k", F.lit(1)))).cast("long")
    classes = stored(known.select("row", "n", "tokens", "times", shared.alias("most")))
    entries = stored(prefixes(classes, percent))
    links = copies.where("a > b").select("a", "b")
    labels = None

    def possible(n: str, most: str, m: str, most2: str) -> Column:
        """No more can be common than either shares with anyone."""
        common = F.least(F.col(most), F.col(most2))
        return 100 * common >= percent * (F.col(n) + F.col(m) - common)

    def band(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) * 20).cast("int")

    for turn in range(rounds + 1):
        mine = entries.withColumn("own", F.col("row"))
        if labels is not None:
            of = labels.select(F.col("v").alias("row"), F.col("l"))
            mine = entries.join(of, "row", "left").withColumn("own", F.coalesce("l", "row")).drop("l")
        mine = stored(mine)
        if turn < rounds:
            # a leader per list: first the one with the least of its own, then another; each document meets the leader
            # it shares most lists with
            choice = F.struct((1 - F.col("most") / F.col("n")) if turn == 0 else F.lit(0.0), F.xxhash64("row", F.lit(turn)))
            leader = F.min_by(F.struct("row", "own", "n", "most"), choice).alias("leader")
            leaders = stored(mine.groupBy("token").agg(leader, F.count("*").alias("k")).where("k > 1").drop("k"))
            met = mine.join(leaders, "token").where(F.col("own") != F.col("leader.own"))
            met = met.where(possible("n", "most", "leader.n", "leader.most")).select("row", F.col("leader.row").alias("b"))
            votes = met.groupBy("row", "b").agg(F.count("*").alias("k"))
            pairs = votes.groupBy(F.col("row").alias("a")).agg(F.max_by("b", F.struct("k", "b")).alias("b"))
        else:
            several = mine.groupBy("token").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("token")
            left = stored(mine.join(stored(several), "token", "left_semi"))
            # partners are met in bands of size, only in those whose sizes are possible for a document
            least_size = F.ceil(F.col("n") * percent / 100)
            most_size = F.floor(((100 + percent) * F.col("most") - percent * F.col("n")) / percent)
            bands = F.explode(F.sequence(band(least_size), band(most_size))).alias("band")
            probes = stored(left.where(least_size <= most_size).select("*", bands))
            names = ("row", "n", "most", "level", "asked", "own")
            right = left.select("token", band(F.col("n")).alias("band"), *[F.col(c).alias(f"{c}2") for c in names])
            asked = F.least("asked", "asked2")
            together = probes.join(right, ["token", "band"]).where((F.col("row") < F.col("row2")) & (F.col("own") != F.col("own2")))
            # how many tokens these two must share, and so how much shorter their prefixes are than for the smallest partner
            must = F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent))
            inside = [F.col(v) + must - F.ceil(F.col(m) * percent / 100) <= asked for v, m in (("level", "n"), ("level2", "n2"))]
            together = together.where(possible("n", "most", "n2", "most2") & inside[0] & inside[1])
            counted = together.groupBy(F.col("row").alias("a"), F.col("row2").alias("b")).agg(F.count("*").alias("k"), F.first(asked).alias("asked"))
            pairs = counted.where("k >= asked")
        links = stored(links.unionByName(_verified(pairs, classes, percent)))
        labels = components(links)
    return labels


def join_components(docs: DataFrame, percent: int = 80, range_bits: int | None = None) -> DataFrame:
    """(row, doc_id, t, n_shingles, component, component_id): every document, the least row of its component and
    the smallest doc_id there."""
    lists = token_lists(docs, percent, range_bits)
    labels = linked_rows(lists, percent)
    rows = lists.select("row", "doc_id", "t", F.col("n").alias("n_shingles"))
    linked = stored(rows.join(labels.select(F.col("v").alias("row"), F.col("l").alias("component")), "row"))
    least = stored(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = linked.join(least, "component").select("row", "doc_id", "t", "n_shingles", "component", "component_id")
    alone = rows.join(linked.select("row"), "row", "left_anti")
    return named.unionByName(alone.withColumns({"component": F.col("row"), "component_id": F.col("doc_id")}))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each component of ``docs`` (the one with the smallest doc_id); all columns as they are.

    Rows are told apart by doc_id and a hash of the text; of rows equal in both one stays, unless they have no words."""
    found = join_components(docs, percent)
    linked = found.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "t")
    kept = linked.groupBy("component").agg(F.min(order).alias("kept"))
    d = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    judged = stored(linked.join(stored(kept), "component").select(d("doc_id").alias("d"), "t", (order != F.col("kept")).alias("out")))
    verdict = stored(judged.groupBy("d", "t").agg(F.min("out").alias("out"), F.count("*").alias("times")).where("out OR times > 1"))
    row, mark = fresh(docs, "_row"), fresh(docs, "_mark")
    keyed = docs.select(F.struct("*").alias(row), d("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    both = keyed.join(verdict, ["d", "t"], "left").where(~F.coalesce("out", F.lit(False)))
    number = F.row_number().over(Window.partitionBy("d", "t").orderBy("times"))
    return both.select(row, "times", number.alias(mark)).where(F.col("times").isNull() | (F.col(mark) == 1)).select(f"{row}.*")
