"""The stages in a row over the smallest tables, each against a plain version on its own input."""

from __future__ import annotations

import re
from collections import Counter

from conftest import SF
from test_decontamination import words
from test_line_dedup import brute as without_runs
from test_packing import verify
from test_shingle_join import brute as near_groups

import corpus_pipeline
from quayside.llm import quality_rules


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [(docs, sorted(map(tuple, docs.collect())))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1][0], SF)
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((df, sorted(map(tuple, df.collect()))))
        if k < 4:
            assert df.columns == docs.columns
    first, good, lines, single, clean, packed = (rows for _, rows in kept)

    judged = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert good == [r for r in first if r[0] in judged]

    expected = without_runs([(r[0], r[1]) for r in good], 4, 50)
    texts = {r[0]: r[1] for r in good}
    expected = [(d, t) for d, t in expected if t or not texts[d]]
    assert sorted((r[0], r[1]) for r in lines) == sorted(expected)
    assert all(r[4] == len(r[1]) for r in lines)

    _, group = near_groups([(r[0], r[1]) for r in lines])
    least = {}
    for r, g in zip(lines, group):
        least[g] = min(least.get(g, r[0]), r[0])
    assert [r[0] for r in single] == sorted(least.values())

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        b = words(r.text)
        windows |= {tuple(b[i : i + 10]) for i in range(max(1, len(b) - 9))} if b else set()
    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert clean == [r for r in single if not hit(r[1])]
    assert 0 < len(clean) < len(single) < len(lines) <= len(good) < len(first)

    rows = kept[-1][0].collect()
    n, total = verify(rows, [(r[0], r[1]) for r in clean])
    assert n <= -(-total // 2048) * 1.03 + 1 and Counter(r.piece for r in rows)[0] == len(clean)
    assert re.match("doc_id", kept[-1][0].columns[0])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


CLASHING = ["d", "t", "i", "a", "b", "row", "_row", "component", "lines", "gone", "words", "kept_", "facts", "_facts", "n", "tokens", "piece"]


def _odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ties, and columns with names that the stages use."""
    prose = " ".join(f"word{k} stands in this sentence" for k in range(40))
    long = "\n".join(f"line {k} of a very long text has its own words {k * 7} and {k * 11}" for k in range(20_000))
    rows = [(1, None), (None, None), (2, ""), (2, ""), (None, prose), (3, long), (3, long), (4, prose + " end"), (5, prose + " end"), (6, "  \n\n "), (7, "short")]
    full = [(d, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "web", None if t is None else len(t), *[None if k % 2 else "x"] * len(CLASHING)) for k, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(full, schema).repartition(3)


def test_odd_documents(spark):
    docs = _odd(spark)
    before = Counter(map(tuple, docs.collect()))
    stages = dict(corpus_pipeline.STAGES)
    results = {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns
        results[name] = Counter(map(tuple, out.collect()))
    by_id = lambda rows: Counter((r[0], None if r[1] is None else r[1][:20]) for r in rows.elements())
    # rejected are texts of under 50 words; the others are judged, and rows stay as they are
    good = results["quality rules"]
    assert not good - before and all(r[1] and len(r[1]) > 100 for r in good)
    # a second row of equal id and text counts as the same document; documents 4, 5 and the null one are of one line each
    lines = results["line dedup"]
    assert by_id(lines)[(1, None)] == by_id(lines)[(None, None)] == 1 and by_id(lines)[(2, "")] == 2 and by_id(lines)[(3, "line 0 of a very lon")] == 2
    assert sum(r[1] is not None and r[1].endswith(" end") for r in lines) == 1
    # one of each group of near copies; empty texts are linked with nothing
    near = results["near copies"]
    assert not near - before and by_id(near)[(2, "")] == 2 and sum(r[0] == 3 for r in near.elements()) == 1
    assert sum(r[1] is not None and r[1].startswith("word0") for r in near.elements()) == 1
    assert results["decontamination"] == before
    packed = stages["packing"](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in before.elements())
    assert sum(r["length"] for r in packed if r.doc_id == 3 and r.piece >= 0) > 2 * 100_000
    assert len({(r.sequence_id, r["offset"]) for r in packed}) == len(packed)
