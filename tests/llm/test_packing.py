from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from conftest import SF

from quayside.llm import packing, queries
from quayside.llm.common import stored


def test_plan_uses_every_piece_and_fills(spark):
    rng = random.Random(5)
    for size, n in ((16, 300), (2048, 5000), (2048, 3)):
        counts = Counter(min(size, int(size * rng.random() ** 3) + 1) for _ in range(n))
        steps = packing.plan(dict(counts), size)
        used = Counter()
        for pattern, times in steps:
            assert times > 0 and sum(pattern) <= size
            for x in pattern:
                used[x] += times
        assert used == counts
        total = sum(k * v for k, v in counts.items())
        assert n < 10 or sum(t for _, t in steps) <= -(-total // size) * 1.02 + 1
    assert packing.plan({}, 16) == []
    assert sorted(packing.plan({10: 2, 6: 1, 3: 2}, 16)) == [((10, 3, 3), 1), ((10, 6), 1)]


def verify(rows, texts, size=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        start, first = 0, len(ids) if len(ids) <= size else len(ids) % size or size
        for k, at in enumerate([0, *range(first, len(ids), size)]):
            part = ids[at : first if k == 0 else at + size]
            expected[doc_id, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), sum(r.length for r in rows)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, total = verify(queries.op3_best_fit_packing(spark, SF).collect(), docs)
    assert n <= -(-total // 2048) * 1.02 + 1


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "it's  a \n\n test' <|endoftext|> ＡＢ 漢字 \x1c x "), (4, "ab " * 9000), (4, "ab " * 9000), (None, "x  y z"), (5, "'" * 2100), (6, "tail  ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    odd = df.selectExpr("*", "1 as piece", "'x' as _salt", "2 as length")
    path = queries.tokenizer_path()
    verify(packing.pack(stored(packing.pieces(odd, path))).collect(), texts)
    assert packing.pack(stored(packing.pieces(df.where("false"), path))).collect() == []
