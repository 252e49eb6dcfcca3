from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from conftest import SF

from quayside.llm import quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def check(rows, texts):
    for r in rows:
        facts = plain(texts[r.doc_id])
        assert facts == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (facts[0] < 50 or 100 * facts[4] > 50 * facts[0])
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_facts_and_labels(spark):
    rows = queries.op10_quality_rules(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    check(rows, docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(bool(q) == k for q, k in judged) >= 0.95 * len(judged)


@pytest.mark.parametrize("share", [0.005, 0.02, 0.1, 0.45])
def test_contradicted_rule(share):
    """Good documents on which one rule alone votes bad, with and without documents that it rightly calls bad."""
    for k in range(8):
        lone = tuple(int(j != k) for j in range(8))
        bad = tuple(int((j - k) % 8 > 2) for j in range(8))  # rule k and the next two
        patterns = [((1,) * 8, round(1e6 * (1 - share))), (lone, round(1e6 * share))]
        assert quality_rules.em(patterns).posterior(lone)[0] > 0.8
        if share >= 0.1:
            model = quality_rules.em([*patterns, (bad, 40_000)])
            assert model.posterior(lone)[0] > 0.9 and model.posterior(bad)[0] < 0.1 and model.posterior((1,) * 8)[0] > 0.9


def test_noisy_rule(spark):
    """Line ends fire on three in ten of the clean documents."""
    rng = random.Random(1)

    def lines(end):
        return "\n".join(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(10)) + end for _ in range(8))

    texts = {k: lines("" if k % 10 < 3 else ".") for k in range(400)}
    texts |= {k: lines("!").upper().replace(" ", "! ") for k in range(400, 440)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in quality_rules.judge(df).collect() if r.kept) == list(range(400))
    assert sorted(r.doc_id for r in quality_rules.keep_good(df).collect()) == list(range(400))


def test_odd_rows(spark):
    long = "word " * 3 + " ".join(f"w{i}" for i in range(60_000))
    texts = {1: None, 2: "", 3: " \t\n", 4: "a b a b a b", 5: long, 6: "x\ny\nx\n\n \n", 7: "é|ü <b>", 8: None}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    check(quality_rules.judge(df.union(df)).collect(), texts)
    none = df.where("false")
    assert quality_rules.judge(none).collect() == []
    clash = df.selectExpr("doc_id", "text", "1 as _facts", "2 as n_words", "3 as _row", "4 as _t", "5 as facts", "6 as `n.x`")
    kept = quality_rules.keep_good(clash)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [5]
    assert quality_rules.keep_good(none).collect() == []
