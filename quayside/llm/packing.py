"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids, and pieces of at most ``size`` ids. How full a sequence is depends on
lengths alone, so packing works on a histogram of lengths - at most ``size`` numbers, however many
documents there are. :func:`plan` takes the longest length with pieces left and looks its
complement up in three hash indexes: lengths that are there, sums of two of them, sums of three. A
combination that fills the gap exactly is used as often as the counts allow, in one step. What is left
after that is packed best-fit, the largest piece that fits first. Each step names a pattern of
lengths and a number of sequences, and uses up at least one length, so there are few steps.

Spark then hands the patterns out: pieces of one length are numbered in salted buckets (a length may hold most pieces),
and piece number r of a length goes to the r-th place for that length in the plan.

Defined cases: a null text counts as empty and is one piece holding the end id alone; repeated rows are packed each;
texts of any length are cut, never dropped; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import stored
from quayside.llm.known_words import Encoded, KnownWords, of_texts

#: Code points whose Unicode classes have long been settled, as a class of RE2.
_SETTLED = r"\t\n\r -\x{24f}\x{2010}-\x{2027}\x{20ac}"
#: Texts that the tokenizer gets whole: other code points, contractions, and marks of special tokens.
_WHOLE = rf"[^{_SETTLED}]|'(?:[stmd]|re|ve|ll)|<\|"
_BLANK, _SPACE = 3, 4
CHARS = 3_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts.

    The tokenizer's rule splits a text into words where the class of the characters changes (letters, digits, blanks,
    others), and ids of a word depend on the word alone. So a batch of texts is split at once, by comparing arrays of
    classes; each distinct word is looked up among the words known from earlier batches, and the tokenizer encodes the others.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = KnownWords(most_words)
        characters = "".join(map(chr, range(0x2100)))
        self.classes = np.zeros(0x2100, dtype=np.uint8)
        for number, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (_BLANK, r"\s")):
            self.classes[[m.start() for m in regex.finditer(pattern, characters)]] = number
        self.classes[ord(" ")] = _SPACE

    def _raw(self, texts: list[str], at_once: int = 4000) -> Encoded:
        """Straight from the tokenizer, some thousand at a time: what it returns per text is large."""
        flat, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(texts), at_once):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + at_once], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def _words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts, and how many each text has."""
        lengths = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        first = np.zeros(len(points) + 1, dtype=bool)
        first[np.cumsum(lengths)] = True
        first[0] = True
        kind = self.classes[np.minimum(points, 0x20FF)]
        blank = kind >= _BLANK
        last = first[1:]
        before = np.concatenate([[0], kind[:-1]])
        after_blank = np.concatenate([[False], blank[:-1]])
        before_word = np.concatenate([~blank[1:], [False]]) & ~last
        starts = first[:-1] | np.where(
            blank,
            ~after_blank | before_word,  # of several blanks all but the last are one word
            np.where(after_blank, before != _SPACE, kind != before),  # a space belongs to the word behind it
        )
        at = np.flatnonzero(starts)
        size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800)
        offsets = np.concatenate([[0], np.cumsum(size)])
        ends = np.concatenate([offsets[at], offsets[-1:]]).astype(np.int32)
        found = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer("".join(texts).encode())])
        owner = np.searchsorted(np.cumsum(lengths), at, side="right")
        return found, np.bincount(owner, minlength=len(texts))

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        if not any(texts):
            return [np.zeros(0, dtype=np.uint32)] * len(texts)
        everything, per_text = of_texts(self.known, *self._words(texts), lambda words: self._raw(words.to_pylist()))
        return np.split(everything, np.cumsum(per_text)[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = pc.match_substring_regex(pa.array(texts, pa.string()), _WHOLE).to_pylist()
        fast = iter(self._fast([t for t, w in zip(texts, whole) if not w]))
        raw, sizes = self._raw([t for t, w in zip(texts, whole) if w], 16)
        slow = iter(np.split(raw, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        return [next(slow) if w else next(fast) for w in whole]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that the tasks a worker runs one after the other share the known words."""
    return Encoder(path)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first takes the remainder."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document. A task holds about CHARS characters at a time, or one text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer_path).encode, np.array([end_id], dtype="<u4")
        for batch in batches:
            held = np.cumsum(batch["text"].str.len()) // CHARS
            for _, part in batch.groupby(held, sort=False):
                out = []
                for doc_id, ids in zip(part["doc_id"], encode(list(part["text"]))):
                    raw = np.concatenate([ids, end]).tobytes()
                    for k, (start, length) in enumerate(cut(len(ids) + 1, size)):
                        out.append((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, PIECES)


def _exact(longest: int, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
    """Up to three lengths that are there and fill the gap exactly, the fewest and most even first."""
    there = np.flatnonzero(left[: gap + 1])
    if gap <= 0 or not len(there):
        return None

    def enough(combination: tuple[int, ...]) -> bool:
        used = (longest, *combination)
        return all(left[x] >= used.count(x) for x in combination)

    if left[gap] and enough((gap,)):
        return (gap,)
    for b in there[::-1]:  # pairs: the complement of each length, looked up in the index
        rest = gap - int(b)
        if rest > b:
            break
        if rest > 0 and left[rest] and enough((int(b), rest)):
            return (int(b), rest)
    for b in there[::-1]:
        if 3 * b < gap:
            break
        rest = gap - int(b)
        if rest <= 1:
            continue
        seconds = there[(there <= min(b, rest - 1)) & (2 * there >= rest)]
        for c in seconds[left[rest - seconds] > 0][::-1]:
            if enough((int(b), int(c), rest - int(c))):
                return (int(b), int(c), rest - int(c))
    return None


def plan(counts: dict[int, int], size: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, longest first) and how many sequences have each."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    steps: list[tuple[tuple[int, ...], int]] = []
    waiting: list[tuple[int, int]] = []

    def use(pattern: tuple[int, ...], most: int) -> None:
        times = min([most, *(int(left[x]) // pattern.count(x) for x in set(pattern))])
        for x in pattern:
            left[x] -= times
        steps.append((pattern, times))

    for longest in range(size, 0, -1):
        while left[longest]:
            found = () if longest == size else _exact(longest, size - longest, left)
            if found is None:  # no exact complement now, so none later: lengths only get fewer
                waiting.append((longest, int(left[longest])))
                left[longest] = 0
            else:
                use((longest, *found), int(left[longest]))
    for length, n in waiting:
        left[length] = n
    while (there := np.flatnonzero(left)).size:  # best fit of the rest, longest first
        pattern, gap = [int(there[-1])], size - int(there[-1])
        room = left.copy()
        room[pattern[0]] -= 1
        while gap > 0:
            fitting = np.flatnonzero(room[: gap + 1])
            if not fitting.size:
                break
            pattern.append(int(fitting[-1]))
            room[pattern[-1]] -= 1
            gap -= pattern[-1]
        use(tuple(pattern), int(left[pattern[0]]))
    return steps


def places(steps: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) of every run of places in the plan."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in steps:
        offset = 0
        for length in pattern:
            first = rank.get(length, 0)
            out.append((length, first, first + times - 1, sequence, offset))
            rank[length] = first + times
            offset += length
        sequence += times
    return out


def pack(cut_pieces: DataFrame, size: int = 2048, buckets: int | None = None) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset. Pieces must be stored: they are read for the counts and for the places.

    Ranks within a length come from salted buckets: position within (length, bucket) plus the pieces of earlier
    buckets. Both the bucket counts (buckets x ``size`` rows) and the plan (a few thousand rows) are bounded.
    """
    spark = cut_pieces.sparkSession
    salts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut_pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = np.array(sorted(places(plan(histogram, size))), dtype=np.int64).reshape(-1, 5)
    lengths, firsts, _, sequences, offsets = runs.T
    most = int(firsts.max(initial=0)) + max([1, *histogram.values()])
    keys = lengths * most + firsts

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["_rank"].to_numpy()
            at = np.searchsorted(keys, batch["length"].to_numpy() * most + rank, side="right") - 1
            yield batch.drop(columns="_rank").assign(sequence_id=sequences[at] + rank - firsts[at], offset=offsets[at])

    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    rank = (F.col("_base") + F.row_number().over(order) - 1).alias("_rank")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = salted.join(bases.select("length", "_salt", "_base"), ["length", "_salt"]).select(*columns, rank)
    return ranked.mapInPandas(assign, PIECES + ", sequence_id long, offset long")
