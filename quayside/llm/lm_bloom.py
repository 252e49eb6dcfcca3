"""Language-model scores from a log-frequency Bloom filter.

The filter stores word-pair counts without storing the pairs: a pair seen c times goes in once for every level up to
1 + floor(log2 c), and its count is read back by asking for level after level until one is missing. Word counts are exact, as sorted
arrays of hashes. A word w behind h has probability (c(h w) + s p(w)) / (c(h) + s) with the add-0.1 word probability p(w), so pairs not
seen fall back to words. Texts begin and end with the same mark, which is counted as a word.

Texts are first stored as chunks of codes: the hashes of a chunk's distinct words, and for each token which of them it is. A chunk has
training texts or held out ones. It sends the hashes of its distinct words and pairs, with their counts if it is learnt from, to the tasks of
their hash ranges. The task of a range sums them up, builds the range's part of the model (word counts and a segment of the filter), asks
it for all that was sent and returns the answers to the chunks, which then have all they need for their texts. So every token is moved a fixed
number of times whatever the size of the model, no task holds more of the model than one range, and nothing of it passes
through the driver, which sees two sums. There are as many ranges as keep one within about ``part_bytes`` of working memory.

Defined cases: a null or empty text consists of the end mark; null ids count as held out; repeated rows are scored each and
learnt from each; an empty table gives an empty result; texts of any length are scored whole; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import stored, stored_at
from quayside.sources.stores import open_store

END = np.uint64(0x1F83D9ABFB41BD6B)
#: Bits of the hash ranges of small corpora.
RANGE_BITS = 10
HASHES, BITS_PER_ENTRY = 6, 10
#: Bytes of text in a chunk, and of working memory for a token in the task of its range.
CHARS, TOKEN_BYTES = 8_000_000, 64
CHUNKS = "chunk long, held_out boolean, n_tokens long, doc_ids array<long>, sizes binary, words binary, codes binary"
BLOCKS = "chunk long, part int, words binary, word_times binary, pairs binary, pair_times binary"
ANSWERS = "chunk long, part int, words binary, pairs binary, entries long"
#: ``CHUNKS`` as Arrow has it.
STORED = pa.schema({
    "chunk": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()),
    "sizes": pa.binary(), "words": pa.binary(), "codes": pa.binary(),
})
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(w))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, END last; all words as places there, an END behind each text; and the number of tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)  # a blank at the begin or end of a text leaves an empty piece
    owner = owner[full.to_numpy(zero_copy_only=False)]
    found = flat.filter(full).dictionary_encode()
    of_word = pd.util.hash_array(found.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    codes = np.full(len(owner) + len(texts), len(of_word), dtype="<u4")
    codes[np.arange(len(owner)) + owner] = found.indices.to_numpy()
    return np.append(of_word, END).astype("<u8"), codes, np.bincount(owner, minlength=len(texts)) + 1


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about CHARS bytes of text, each of texts held out or of others."""
    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    chars = {False: 0, True: 0}
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            some = batch.slice(at, 100)
            for out in held:
                own = some.filter(pc.equal(some.column("held_out"), out))
                if own.num_rows:
                    held[out].append(own)
                    chars[out] += pc.sum(pc.binary_length(own.column("text"))).as_py()
                if chars[out] >= CHARS:
                    yield pa.Table.from_batches(held[out])
                    held[out], chars[out] = [], 0
    for rest in held.values():
        if rest:
            yield pa.Table.from_batches(rest)


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of their times, and the place of each given key among them."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[first], np.add.reduceat(times, first) if len(first) else times, place


def _pieces(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each stretch of ``values``: the first begins at 0, each ends where ``ends`` says."""
    cuts = np.concatenate([[0], ends]).astype("<i4") * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(values.tobytes())])


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def held_out(doc_id: str, folds: int = 10) -> Column:
    """crc32 of the id as text leaves no remainder."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def chunks(docs: DataFrame) -> str:
    """Path of the stored chunks of ``docs``, a row each, in row groups of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _in_chunks(batches):
            words, codes, sizes = coded(chunk["text"].combine_chunks())
            row = {"chunk": chunk["row"][0].as_py(), "held_out": chunk["held_out"][0].as_py(), "n_tokens": len(codes), "doc_ids": chunk["doc_id"].to_pylist()}
            row |= {"sizes": sizes.astype("<i8").tobytes(), "words": words.tobytes(), "codes": _planes(codes)}
            yield pa.RecordBatch.from_pylist([row], schema=STORED)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), doc_id, held_out("doc_id").alias("held_out"), text)
    return stored_at(narrow.mapInArrow(run, CHUNKS), **{"parquet.block.row.count.limit": "1"})


def _planes(codes: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on, which packs better."""
    return codes.view("u1").reshape(-1, codes.itemsize).T.tobytes()


@dataclass
class Chunk:
    """A chunk of texts as it is stored, and what it asks: distinct words and pairs in the order of their hashes."""

    doc_ids: pa.Array
    sizes: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    @staticmethod
    def read(path: str, name: str, at: int) -> Chunk:
        place, base = open_store(path)
        with place.open_input_file(f"{base}/{name}") as source:
            file = pq.ParquetFile(source)
            group = 0
            while at >= file.metadata.row_group(group).num_rows:
                at -= file.metadata.row_group(group).num_rows
                group += 1
            row = file.read_row_group(group, columns=["doc_ids", "sizes", "words", "codes"]).slice(at, 1)
        sizes, words = (_joined(row[c], kind) for c, kind in (("sizes", "<i8"), ("words", "<u8")))
        codes = np.ascontiguousarray(_joined(row["codes"], "u1").reshape(4, -1).T).view("<u4").ravel()
        return Chunk(row["doc_ids"].combine_chunks().flatten(), sizes, words, codes)

    @property
    def before(self) -> np.ndarray:
        """The word before each token; END before a text."""
        return np.concatenate([[len(self.words) - 1], self.codes[:-1]])

    def word_keys(self) -> np.ndarray:
        return mix(self.words)

    def token_pairs(self) -> np.ndarray:
        return pair_keys(self.words[self.before], self.words[self.codes])


def _blocks(path: str, range_bits: int):
    """Rows that tell where chunks are stored to blocks of words and pairs by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place in (place for batch in batches for place in batch.to_pylist()):
            chunk = Chunk.read(path, place["file"], place["at"])
            words, pairs = chunk.word_keys(), np.sort(chunk.token_pairs())
            order = np.argsort(words, kind="stable")
            words, word_times = words[order], np.bincount(chunk.codes, minlength=len(words))[order]
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            pairs, pair_times = pairs[first], np.diff(np.append(first, len(pairs)))
            cuts = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits)
            word_ends, pair_ends = (np.append(np.searchsorted(x, cuts), len(x)) for x in (words, pairs))
            parts = np.flatnonzero((np.diff(word_ends, prepend=0) > 0) | (np.diff(pair_ends, prepend=0) > 0))
            word_ends, pair_ends = word_ends[parts], pair_ends[parts]
            rest = (pairs >> np.uint64(32 - range_bits) & np.uint64(0xFFFFFFFF)).astype("<u4")  # the range and 32 bits more tell pairs apart
            if place["held_out"]:
                none = pa.array([b""] * len(parts), pa.binary())
                times = (none, none)
            else:
                times = (_pieces(word_times.astype("<u4"), word_ends), _pieces(pair_times.astype("<u4"), pair_ends))
            id_ = np.full(len(parts), place["chunk"])
            columns = [pa.array(id_), pa.array(parts.astype(np.int32)), _pieces(words, word_ends), times[0], _pieces(rest, pair_ends), times[1]]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "words", "word_times", "pairs", "pair_times"])

    return run


def _sent(group: pa.Table, name: str, kind: str) -> tuple[np.ndarray, ...]:
    """Keys and times of all blocks of a range, nothing for those not learnt from, and where blocks end."""
    sizes = pc.binary_length(group[f"{name}s"]).to_numpy() // np.dtype(kind).itemsize
    learnt = np.repeat(pc.binary_length(group[f"{name}_times"]).to_numpy() > 0, sizes)
    times = np.zeros(len(learnt), dtype=np.int64)
    times[learnt] = _joined(group[f"{name}_times"], "<u4")
    return _joined(group[f"{name}s"], kind), times, np.cumsum(sizes)


def _answer(range_bits: int):
    """All blocks of a range to the answers of its part of the model, and a row without chunk that has the number of its words."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        number = key[0].as_py()
        words, word_times, word_ends = _sent(group, "word", "<u8")
        words, word_times, word_place = _counted(words, word_times)
        pairs, pair_times, pair_ends = _sent(group, "pair", "<u4")
        pairs, pair_times, pair_place = _counted(pairs, pair_times)
        part = Part.of(number, range_bits, words, word_times, pairs.astype(np.uint64), pair_times)
        whole = np.uint64(number) << np.uint64(64 - range_bits) | pairs.astype(np.uint64) << np.uint64(32 - range_bits)
        counts = part.look_up(part.w_keys, part.w_times, words).astype("<u8")
        levels = part.pair_levels(whole).astype("u1")
        return pa.table(
            [
                pa.chunked_array([group["chunk"].combine_chunks(), pa.nulls(1, pa.int64())]),
                pa.array(np.full(len(group) + 1, number, dtype=np.int32)),
                _pieces(counts[word_place], np.append(word_ends, word_ends[-1])),
                _pieces(levels[pair_place], np.append(pair_ends, pair_ends[-1])),
                pa.array([None] * len(group) + [part.n_words], pa.int64()),
            ],
            names=["chunk", "part", "words", "pairs", "entries"],
        )

    return run


def _bit(keys: np.ndarray, level: int, k: int, size: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = mix(keys + np.uint64(level) * np.uint64(0xA0761D6478BD642F))
        b = (a >> np.uint64(32)) | np.uint64(1)
        return ((a & np.uint64(0xFFFFFFFF)) + np.uint64(k) * b) % np.asarray(size, dtype=np.uint64)


def segment(keys: np.ndarray, times: np.ndarray) -> bytes:
    """The filter of one hash range: whole bytes, about BITS_PER_ENTRY bits for each key and level."""
    levels = np.floor(np.log2(np.maximum(times, 1))).astype(np.int64) + 1
    size = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 8) * 8)
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        there = keys[levels >= level]
        for k in range(HASHES):
            bits[_bit(there, level, k, size).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class Part:
    """The model of some hash ranges: words that may be h of a pair (h, w), words that may be w, filter segments."""

    histories: tuple[int, int]  # word ranges, first and last + 1
    words: tuple[int, int]
    pairs: tuple[int, int]
    h_keys: np.ndarray
    h_times: np.ndarray
    w_keys: np.ndarray
    w_times: np.ndarray
    bits: np.ndarray
    begins: np.ndarray  # of each segment in bits, and the end
    n_tokens: int
    n_words: int
    smoothing: float = field(default=200.0)
    range_bits: int = field(default=RANGE_BITS)

    @staticmethod
    def of(number: int, range_bits: int, words: np.ndarray, word_times: np.ndarray, pairs: np.ndarray, pair_times: np.ndarray) -> Part:
        """The part of one range, of the words and pairs that were learnt."""
        own, known, seen = (number, number + 1), word_times > 0, pair_times > 0
        bits = np.frombuffer(segment(pairs[seen], pair_times[seen]), dtype=np.uint8)
        words, word_times = words[known], word_times[known]
        return Part(own, own, own, words, word_times, words, word_times, bits, np.array([0, len(bits)]), int(word_times.sum()), len(words), range_bits=range_bits)

    @staticmethod
    def look_up(keys: np.ndarray, times: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, times[at], 0).astype(np.int64)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts as the filter tells them: the middle of the highest level it has."""
        return count_of(self.pair_levels(keys))

    def pair_levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level that the filter has of each pair, 0 for none."""
        part = (keys >> np.uint64(64 - self.range_bits)).astype(np.int64) - self.pairs[0]
        rest = keys >> np.uint64(32 - self.range_bits) & np.uint64(0xFFFFFFFF)
        begin, size = self.begins[part], (self.begins[part + 1] - self.begins[part]) * 8
        levels = np.zeros(len(keys), dtype=np.int64)
        alive = np.flatnonzero(size > 0)
        level = 0
        while len(alive):
            level += 1
            for k in range(HASHES):
                at = _bit(rest[alive], level, k, size[alive]).astype(np.int64)
                alive = alive[(self.bits[begin[alive] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
            levels[alive] = level
        return levels


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level."""
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, 1.5 * 2.0 ** (levels - 1.0) - 0.5))


def _score(path: str, n_tokens: int, n_words: int, smoothing: float):
    """The answers to a chunk, and the row that tells where it is stored, to the scores of its texts."""

    def run(group: pa.Table) -> pa.Table:
        place = group.filter(pc.is_valid(group["file"])).to_pylist()[0]
        answers = group.filter(pc.is_valid(group["part"])).sort_by("part")
        chunk = Chunk.read(path, place["file"], place["at"])
        counts = np.empty(len(chunk.words), dtype=np.int64)
        counts[np.argsort(chunk.word_keys(), kind="stable")] = _joined(answers["words"], "<u8")
        c_w, c_h = counts[chunk.codes], counts[chunk.before]
        keys = chunk.token_pairs()
        distinct, _, at = _counted(keys, np.zeros(len(keys), dtype=np.int64))
        levels = _joined(answers["pairs"], "u1")
        if len(levels) != len(distinct):
            raise ValueError(f"chunk {place['chunk']} asked for {len(distinct)} pairs and was told {len(levels)}")
        p_word = (c_w + 0.1) / (n_tokens + 0.1 * (n_words + 1))
        pairs = np.minimum(count_of(levels)[at], np.minimum(c_w, c_h))
        p = (pairs + smoothing * p_word) / (c_h + smoothing)
        begin = np.cumsum(chunk.sizes) - chunk.sizes
        found = [np.add.reduceat(x, begin) for x in ((c_w > 0).astype(np.int64), np.log10(p_word), np.log10(p))]
        columns = [chunk.doc_ids, pa.array([place["held_out"]] * len(begin)), pa.array(chunk.sizes), *map(pa.array, found)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, part_bytes: int = 400_000_000, smoothing: float = 200.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, learnt from those not held out."""
    spark = docs.sparkSession
    path = chunks(docs)
    places = spark.read.schema(CHUNKS).parquet(path).select(
        "chunk", "held_out", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    all_tokens, train_tokens = places.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n_tokens"), F.expr("if(held_out, 0, n_tokens)")))).first()
    range_bits = max(RANGE_BITS, min(24, (all_tokens * TOKEN_BYTES // part_bytes).bit_length()))
    answers = stored(places.mapInArrow(_blocks(path, range_bits), BLOCKS).groupBy("part").applyInArrow(_answer(range_bits), ANSWERS))
    n_words = answers.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    asked = answers.where("chunk is not null").drop("entries").unionByName(places, allowMissingColumns=True)
    scored = asked.groupBy("chunk").applyInArrow(_score(path, train_tokens, n_words, smoothing), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
