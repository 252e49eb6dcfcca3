"""Merge rounds against the library, id by id."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.llm import piece_codec, queries
from quayside.llm.known_words import KnownWords, by_characters
from quayside.llm.queries import PIECE_MODEL, tokenizer_path

codec = piece_codec.Codec(tokenizer_path(PIECE_MODEL))
PIECES = [codec.library.id_to_piece(i) for i in range(259, 32000, 7)]


def split(texts: list[str]) -> list[list[int]]:
    ids, sizes = codec.encode(texts)
    ends = sizes.cumsum().tolist()
    return [ids[e - n : e].tolist() for e, n in zip(ends, sizes.tolist())]


@pytest.mark.parametrize("alphabet", [st.sampled_from("ab "), st.sampled_from("abcdefghij  ▁\ttionés\n日本語ا🙂0123=-_."), st.sampled_from(PIECES), st.characters(codec="utf-8")])
def test_any_text(alphabet):
    @given(st.lists(st.lists(alphabet, max_size=60).map("".join), max_size=5))
    @settings(max_examples=120, deadline=None)
    def run(texts):
        assert split(texts) == [codec.library.encode(t) for t in texts]

    run()


def test_runs_and_long_words():
    """Pairs of one rank that overlap or come into each other's way, and words for the queue."""
    texts = ["", " ", "▁" * 77, "    " * 30, "a" * 99, "=" * 700, "\n" * 333, "abcabcab" * 90, "日本" * 400, "x\x00y", "<s></s><0x0A>", " a" * 500]
    assert split(texts) == [codec.library.encode(t) for t in texts]
    for t in texts:
        word = [int(codec.of_character[ord(c)]) for c in codec.library.normalize(t)]
        assert len(codec.one_by_one(word)) <= len(word)


def test_known_words_are_bounded():
    calls = []

    def lengths(words: pa.StringArray):
        import numpy as np

        calls.append(words.to_pylist())
        n = np.array([len(w) for w in words.to_pylist()], dtype=np.int64)
        return np.repeat(n, n).astype(np.uint32), n

    known = KnownWords(most=4)
    for words in (["a", "bb", ""], ["bb", "ccc"], ["dddd", "a"], ["bb", "ee"], ["dddd"]):
        flat, sizes = known.ids(pa.array(words), lengths)
        assert sizes.tolist() == [len(w) for w in words] and flat.tolist() == [len(w) for w in words for _ in w]
        assert len(known.words) <= 4
    assert calls[:3] == [["a", "bb", ""], ["ccc"], ["dddd"]]


def test_rows_by_size():
    assert list(by_characters(pa.array(["aa", "b", "", "cccccc", None, "d"]), 3)) == [(0, 3), (3, 4), (4, 6)]
    assert list(by_characters(pa.array([], pa.string()), 3)) == []


def test_query(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet")
    want = []
    for doc_id, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
        ids = codec.library.encode(text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(codec.library.decode(ids) if ids else "")))
    assert sorted(map(tuple, queries.op12_merge_rounds(spark, SF).collect())) == sorted(want)


def test_defined_cases(spark):
    long = "lorem ipsum " * 40_000
    rows = [(1, None), (2, ""), (3, long), (None, "twice"), (5, "twice"), (5, "twice"), (6, "  \n\t ")]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, ids string, Decoded double")
    found = piece_codec.encode(df, tokenizer_path(PIECE_MODEL)).collect()
    want = sorted(((i, codec.library.encode(t or ""), t or "") for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in found), key=repr) == want
    assert piece_codec.encode(df.limit(0), tokenizer_path(PIECE_MODEL)).collect() == []
