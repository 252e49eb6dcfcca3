"""Byte-pair pieces of a SentencePiece model by vectorised merge rounds.

A batch of texts is split into words where no piece can reach across (before a blank that follows something else), and ids of a word depend
on the word alone. The distinct words not yet known become flat arrays: a symbol per character, and the segment it belongs to (words, cut
again between characters that stand side by side in no piece). A round finds the best rank of a pair in every segment, merges all
pairs of that rank at once, the leftmost first where they overlap, closes the gaps, looks up the pairs beside the new symbols, and
takes finished segments out; rounds go on until no pair is left. That is what merging one pair at a time gives, as long as no
new pair ranks as high as the pairs merged together; a segment where one does, and one of more than ``LONG`` characters, is
merged pair by pair with a queue instead, which is exact for any text.

Normalising, which the model's file describes, and decoding are the library's own.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded each; characters without a piece become
the ids of their bytes; texts of any length are encoded whole; an empty table gives an empty result; null ids are kept;
extra columns are ignored, whatever their names. Models that are no byte-pair models with byte fallback are refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.known_words import Encoded, KnownWords, by_characters, of_texts

BLANK = "▁"
BYTES = 3_000_000
LONG = 300
_NO_PAIR = np.iinfo(np.int32).max
_CHARACTERS = 0x110000


class Codec:
    """Symbols are piece ids; further numbers stand for characters that are in pieces, but none themselves, and -1 for all others."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.uint32)
        if any(lib.is_unused(i) for i in plain) or not all(lib.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("only byte-pair models with byte fallback and without unused pieces")
        pieces = {lib.id_to_piece(i): i for i in plain}
        symbols = dict(pieces)
        for piece in pieces:
            for c in piece:
                symbols.setdefault(c, n + len(symbols))
        self.n_pieces, self.base = n, n + len(symbols) + 1
        self.of_character = np.full(_CHARACTERS, -1, dtype=np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.of_character[ord(c)] = s
        scores = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        pairs = {}
        beside = set()
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                beside.add(symbols[piece[k - 1]] * self.base + symbols[piece[k]])
                if piece[:k] in symbols and piece[k:] in symbols:
                    pairs[symbols[piece[:k]] * self.base + symbols[piece[k:]]] = (scores[lib.get_score(i)], i)
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in self.pair_keys.tolist()] + [_NO_PAIR], dtype=np.int32)
        self.pair_merged = np.array([pairs[k][1] for k in self.pair_keys.tolist()] + [-1], dtype=np.int32)
        self.beside = np.array(sorted(beside), dtype=np.int64)
        self.split_words = not any(b == BLANK and a != BLANK for piece in pieces for a, b in zip(piece, piece[1:]))
        self.known = KnownWords()

    @cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_merged.tolist())))

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair."""
        wanted = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_keys, wanted)
        at[(left < 0) | (right < 0) | (self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] != wanted)] = len(self.pair_keys)
        return self.pair_ranks[at], self.pair_merged[at]

    def one_by_one(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(symbol, place) after merging the best pair, the leftmost of equals, again and again."""
        symbols, n = list(symbols), len(symbols)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and symbols[i] >= 0 and symbols[j] >= 0:
                found = self._pairs.get(symbols[i] * self.base + symbols[j])
                if found:
                    heapq.heappush(queue, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = bytearray(n)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = behind[i]
            if gone[i] or j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], gone[j] = merged, 1
            behind[i] = behind[j]
            if behind[j] < n:
                before[behind[j]] = i
            offer(before[i], i)
            offer(i, behind[i])
        return [(symbols[i], i) for i in range(n) if not gone[i]]

    def _merged(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, place of its first character) after all merges, in order. ``segment`` rises along the symbols."""
        place = np.arange(len(symbols))
        begins = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else place
        sizes = np.diff(np.append(begins, len(segment)))
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def alone(numbers: np.ndarray) -> None:
            for k in numbers.tolist():
                found = self.one_by_one(all_symbols[begins[k] : begins[k] + sizes[k]].tolist())
                done.append((np.array([s for s, _ in found], dtype=np.int32), np.array([p for _, p in found]) + begins[k]))

        all_symbols = symbols
        segment = np.repeat(np.arange(len(begins)), sizes)
        alone(np.flatnonzero(sizes > LONG))
        short = (sizes <= LONG)[segment]
        s, seg, place = symbols[short], segment[short], place[short]
        rank, merged = np.full(len(s), _NO_PAIR, dtype=np.int32), np.full(len(s), -1, dtype=np.int32)
        inside = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inside], merged[inside] = self._looked_up(s[inside], s[inside + 1])
        while len(s):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            length = np.diff(np.append(first, len(s)))
            best = np.repeat(np.minimum.reduceat(rank, first), length)
            over = best == _NO_PAIR
            if over.any():  # segments without pairs are finished
                done.append((s[over], place[over]))
                s, seg, place, rank, merged, best = (x[~over] for x in (s, seg, place, rank, merged, best))
                if not len(s):
                    break
            hit = np.flatnonzero(rank == best)
            new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            position = np.arange(len(hit))
            hit = hit[(position - np.maximum.accumulate(np.where(new_run, position, 0))) % 2 == 0]
            s[hit] = merged[hit]
            keep = np.ones(len(s), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the new symbols stand once the gaps are closed
            now = best[hit]
            s, seg, place, rank, merged = (x[keep] for x in (s, seg, place, rank, merged))
            rank[at], merged[at] = _NO_PAIR, -1
            right = at[(at + 1 < len(s))]
            right = right[seg[right] == seg[right + 1]]
            left = at[at > 0] - 1
            left = left[seg[left] == seg[left + 1]]
            rank[left], merged[left] = _NO_PAIR, -1
            beside = np.zeros(len(s), dtype=bool)
            beside[left] = beside[right] = True
            pairs = np.flatnonzero(beside)
            rank[pairs], merged[pairs] = self._looked_up(s[pairs], s[pairs + 1])
            # merged together, but a new pair would have come between
            owner = seg[at]
            several = np.concatenate([[False], owner[1:] == owner[:-1]]) | np.concatenate([owner[1:] == owner[:-1], [False]])
            if several.any():
                limit = np.full(len(begins), -1, dtype=np.int64)
                limit[owner[several]] = now[several]
                contested = np.unique(seg[pairs][rank[pairs] <= limit[seg[pairs]]])
                if len(contested):
                    alone(contested)
                    drop = np.isin(seg, contested)
                    s, seg, place, rank, merged = (x[~drop] for x in (s, seg, place, rank, merged))
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        s, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        return s[order], place[order]

    def encode_words(self, words: pa.StringArray) -> Encoded:
        """Ids of all words, one after the other, and how many each word has."""
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        text = "".join(words.to_pylist())
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        symbols = self.of_character[points]
        owner = np.repeat(np.arange(len(words)), lengths)
        pair = symbols[:-1].astype(np.int64) * self.base + symbols[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        joined = (owner[1:] == owner[:-1]) & (self.beside[at] == pair) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        segment = np.concatenate([[0], np.cumsum(~joined)]) if len(points) else owner
        found, place = self._merged(symbols, segment)
        # characters without a piece become their bytes
        as_bytes = (found < 0) | (found >= self.n_pieces)
        bare = points[place[as_bytes]]
        raw = np.frombuffer(bare.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        n = np.ones(len(found), dtype=np.int64)
        n[as_bytes] = 1 + (bare >= 0x80).astype(np.int64) + (bare >= 0x800) + (bare >= 0x10000)
        ids = np.repeat(found, n).astype(np.uint32)
        ids[np.repeat(as_bytes, n)] = self.byte_ids[raw]
        return ids, np.bincount(owner[place], weights=n, minlength=len(words)).astype(np.int64)

    def encode(self, texts: list[str]) -> Encoded:
        """Ids of all texts, one after the other, and how many each text has."""
        raw = [t.replace(BLANK, " ").encode() for t in self.library.normalize(texts)] if texts else []
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        joined = b"".join(raw)
        flat = np.frombuffer(joined, dtype=np.uint8)
        if not len(flat):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        blank = flat == 32
        starts = blank & np.concatenate([[True], ~blank[:-1]]) if self.split_words else np.zeros(len(flat), dtype=bool)
        ends = np.cumsum(sizes)
        starts[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(starts)
        offsets = np.append(at, len(flat)).astype(np.int32)
        # a blank stays a blank in the words: only their symbols have the mark
        words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        before = np.concatenate([[0], np.cumsum(starts)])
        return of_texts(self.known, words, before[ends] - before[ends - sizes], self._encode_blank_words)

    def _encode_blank_words(self, words: pa.StringArray) -> Encoded:
        return self.encode_words(pc.replace_substring(words, " ", BLANK))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        return [self.library.decode(x.tolist()) if len(x) else "" for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One per Python worker, so that its tasks share the known words."""
    return Codec(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded): ids of every whole text, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for begin, end in by_characters(batch.column("text"), BYTES):
                part = batch.slice(begin, end - begin)
                ids, sizes = own.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids.astype(np.int32)))
                decoded = pa.array(own.decode(ids, sizes), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, decoded], names=["doc_id", "ids", "decoded"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
