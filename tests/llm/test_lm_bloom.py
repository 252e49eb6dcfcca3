from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF

from quayside.llm import lm_bloom, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = object()


def words(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def verify(rows, docs, smoothing=200.0):
    train = [words(t) for d, t in docs if not held(d)]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([END, *t], t))
    n, v = sum(c.values()), len(c)
    expected = Counter()
    exact = {}
    for d, t in docs:
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10((pairs[h, x] + smoothing * (c[x] + 0.1) / (n + 0.1 * (v + 1))) / (c[h] + smoothing)) for h, x in zip([END, *w], w))
        expected[d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
        exact[d] = score
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == expected
    return exact


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op7_bloom_lm(spark, SF).collect()
    exact = verify(rows, docs)
    off = [abs(r.score - exact[r.doc_id]) / r.n_tokens for r in rows]
    assert np.mean(off) < 0.03 and max(off) < 0.5
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # pairs help on texts not learnt from


def test_filter():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**32, 20_000, dtype=np.uint64))
    times = rng.geometric(0.4, len(keys)) ** 3
    bits = np.frombuffer(lm_bloom.segment(keys[:10_000], times[:10_000]), dtype=np.uint8)
    part = lm_bloom.Part((0, 1), (0, 1), (0, 1), *[np.zeros(0)] * 4, bits, np.array([0, len(bits)]), 1, 1)
    told = part.pair_counts(keys << np.uint64(32 - lm_bloom.RANGE_BITS) & np.uint64(2**54 - 1))
    levels = np.floor(np.log2(times[:10_000])) + 1
    assert (told[:10_000] >= np.where(levels == 1, 1, 1.5 * 2 ** (levels - 1) - 0.5)).all()  # no count is lost
    assert (told[:10_000] > 2 ** levels).mean() < 0.03 and (told[10_000:] > 0).mean() < 0.03


@pytest.mark.parametrize("part_bytes", [400_000_000, 3000])
def test_parts_and_odd_rows(spark, part_bytes):
    docs = [(k, f"A b{k % 7} the c{k % 3} \x1c é the the") for k in range(60)] + [(70, None), (71, ""), (71, ""), (None, "the the"), (72, "q " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as held_out", "3 as score").repartition(3)
    rows = lm_bloom.score(df, part_bytes).collect()
    exact = verify(rows, docs)
    assert all(abs(r.score - exact[r.doc_id]) <= 0.35 * r.n_tokens for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_bloom.score(none).collect() == []


@pytest.mark.parametrize("part_bytes", [400_000_000, 3000])
def test_texts_are_read_once_whatever_the_parts(spark, part_bytes):
    """A model of many parts costs no pass over the texts for each."""
    read = spark.sparkContext.accumulator(0)

    def same(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = [(k, " ".join(f"w{k * 31 % 97}x{j}" for j in range(50))) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    rows = lm_bloom.score(df.mapInArrow(same, df.schema), part_bytes).collect()
    assert read.value == len(docs)
    verify(rows, docs)


def test_ranges(spark):
    """More ranges than the least."""
    docs = [(k, f"a w{k % 50} b w{k} w{k % 7} the the \t") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    rows = lm_bloom.score(df, part_bytes=1000).collect()
    exact = verify(rows, docs)
    assert np.mean([abs(r.score - exact[r.doc_id]) / r.n_tokens for r in rows]) < 0.03


def test_stored_chunks(tmp_path):
    texts = ["A b  a\x0b", "", " é\x1cé ", "a"]
    words, codes, sizes = lm_bloom.coded(pa.array(texts))
    assert sizes.tolist() == [4, 1, 2, 2] and words[-1] == lm_bloom.END and len(words) == 4
    row = {"chunk": 5, "held_out": False, "n_tokens": 9, "doc_ids": [1, None, 3, 4], "sizes": sizes.astype("<i8").tobytes()}
    row |= {"words": words.tobytes(), "codes": lm_bloom._planes(codes)}
    table = pa.Table.from_pylist([row | {"codes": b""}, row], schema=lm_bloom.STORED)
    for size in (1, 2):
        pq.write_table(table, tmp_path / "part", row_group_size=size)
        chunk = lm_bloom.Chunk.read(f"file:{tmp_path}", "part", 1)
        assert chunk.doc_ids.to_pylist() == [1, None, 3, 4] and chunk.codes.tolist() == codes.tolist() == [0, 1, 0, 3, 3, 2, 3, 0, 3]
        assert chunk.before.tolist() == [3, 0, 1, 0, 3, 3, 2, 3, 0]
