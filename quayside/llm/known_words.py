"""Ids of words that a Python worker has met before, and texts put together from their words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Encoded = tuple[np.ndarray, np.ndarray]


def gathered(flat: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> Encoded:
    """The runs of ``flat`` numbered ``wanted``, one after the other, and their sizes."""
    ends = np.cumsum(sizes)
    n = sizes[wanted]
    out = np.cumsum(n)
    total = int(out[-1]) if len(out) else 0
    return flat[np.repeat((ends - sizes)[wanted] - (out - n), n) + np.arange(total)], n


class KnownWords:
    """Words and their ids as arrays; at most ``most`` are kept from one batch to the next, those used last first."""

    def __init__(self, most: int = 400_000):
        self.most, self.batch = most, 0
        self.words = pa.array([], pa.string())
        self.flat, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)

    def ids(self, distinct: pa.StringArray, encode: Callable[[pa.StringArray], Encoded]) -> Encoded:
        """Ids of the words, run after run; those not known are given to ``encode``."""
        self.batch += 1
        at = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] = self.batch
        if len(new):
            fresh = distinct.take(pa.array(new))
            flat, sizes = encode(fresh)
            at[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, fresh])
            self.flat, self.sizes = np.concatenate([self.flat, flat.astype(np.uint32)]), np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.full(len(new), self.batch)])
        out = gathered(self.flat, self.sizes, at)
        if len(self.words) > self.most:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
            self.flat, self.sizes = gathered(self.flat, self.sizes, keep)
            self.words, self.used = self.words.take(pa.array(keep)), self.used[keep]
        return out


def of_texts(known: KnownWords, words: pa.StringArray, counts: np.ndarray, encode: Callable[[pa.StringArray], Encoded]) -> Encoded:
    """Ids of all texts, given the words of all texts and how many each has; and how many ids each text has."""
    coded = words.dictionary_encode()
    flat, sizes = known.ids(coded.dictionary, encode)
    everything, n = gathered(flat, sizes, coded.indices.to_numpy())
    before = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(counts)
    return everything, before[ends] - before[ends - counts]


def by_characters(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, one row at least."""
    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
    begin = 0
    while begin < len(total):
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right"))
        end = max(end, begin + 1)
        yield begin, end
        begin = end
