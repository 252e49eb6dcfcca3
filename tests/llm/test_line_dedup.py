from __future__ import annotations

import random
import re

import pytest

from quayside.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, min_lines, min_words):
    """Every run of every length, compared with all earlier places."""
    texts = sorted({(d is not None, d or 0, t) for d, t in docs if t is not None})
    lines = [t.split("\n") for _, _, t in texts]
    seen, gone = {}, set()
    for k, own in enumerate(lines):
        for i in range(len(own)):
            for n in range(1, len(own) - i + 1):
                seen.setdefault(tuple(own[i : i + n]), (k, i))
    for k, own in enumerate(lines):
        for i in range(len(own)):
            for n in range(1, len(own) - i + 1):
                run = tuple(own[i : i + n])
                if seen[run] < (k, i) and (n >= min_lines or sum(len(WORD.findall(x)) for x in run) >= min_words):
                    gone |= {(k, i + j) for j in range(n)}
    kept = {key: "\n".join(x for i, x in enumerate(own) if (k, i) not in gone) for k, (key, own) in enumerate(zip(texts, lines))}
    return sorted(((d, None if t is None else kept[d is not None, d or 0, t]) for d, t in docs), key=repr)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 5, 8])
def test_against_all_runs(spark, min_lines):
    rng = random.Random(min_lines)
    pool = ["", "a b c", "d e f g h", "x", " ", "one two three four", "é è"]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for k in range(25)]
    docs += [(30, None), (31, ""), (None, "a b c\nx\nx"), (33, "a b c\nx\nx"), (34, docs[0][1]), (34, docs[0][1]), (35, "x\n" * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id as i", "1 as d", "text as a", "2 as _row", "3 as gone", "4 as lines", "5 as m")
    out = line_dedup.delete_copies(df, "i", "a", min_lines, 8)
    assert out.columns == df.columns
    assert sorted(((r["i"], r["a"]) for r in out.collect()), key=repr) == brute(docs, min_lines, 8)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.delete_copies(none, facts="facts").collect() == []
