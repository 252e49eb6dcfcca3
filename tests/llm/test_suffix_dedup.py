from __future__ import annotations

import hashlib
import random
import uuid
from collections import Counter
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quayside.llm import queries, suffix_dedup
from quayside.session import shared_dir


def brute(docs, length):
    starts = Counter()
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, raw in raws:
        starts.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if starts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("length,gram,batches,most", [(30, 12, 4, 20_000), (30, 30, 3, 1), (20, 5, 1, 2)])
def test_against_all_strings(spark, length, gram, batches, most):
    rng = random.Random(length + gram)
    text = lambda n: "".join(rng.choice("ab é漢") for _ in range(n))
    shared = [text(rng.randint(length // 3, 3 * length)) for _ in range(12)]
    docs = [(k, "".join(rng.choice([text(rng.randint(0, 40)), rng.choice(shared)]) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    docs += [(70, None), (71, ""), (72, "x" * 300), (73, "ab" * 100), (74, docs[5][1]), (74, docs[5][1]), (None, docs[6][1] + text(50)), (75, "q" * (length - 1)), (76, text(9000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "1 as d", "2 as g", "3 as raw")
    assert rows(suffix_dedup.remove_repeats(df, length, gram, batches, most)) == brute(docs, length)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = brute(docs, 400)
    assert rows(queries.op5_suffix_family(spark, SF)) == expected and sum(r[2] for r in expected) > 0


def _texts(k):
    rng = random.Random(k)
    text = lambda n, seed: "".join(random.Random(seed).choice("abcdef é") for _ in range(n))
    return [(10 * k + j, text(60, rng.random()) + (text(45, 7 + j % 2) if k % 2 == 0 else "") + text(50, rng.random())) for j in range(3)]


def test_levels_and_order(spark, tmp_path):
    schema = "doc_id long, text string"
    family = suffix_dedup.SuffixFamily.create(spark, str(tmp_path / "family"), 30, 12)
    for k in range(5):
        family.add(spark.createDataFrame(_texts(k), schema))
        assert sorted(map(int, family.known["levels"])) == [i for i in range(3) if (k + 1) >> i & 1]
    # a level has the beginnings of its batches in the order of the suffixes themselves
    array = family.known["levels"]["2"]
    rows_of = [suffix_dedup._read_range(family.path, array, n) for n in range(len(family.known["borders"]) + 1)]
    keys = [x for r in rows_of for x in zip(*(r[c].tolist() for c in suffix_dedup.ORDER))]
    assert keys == sorted(set(keys)) and len(keys) > 10
    suffixes = {}
    for k in range(4):
        for d, t in _texts(k):
            raw = t.encode()
            suffixes |= {(int.from_bytes((raw[p : p + 12] + bytes(4))[:8], "big") - 2**63, int.from_bytes((raw[p : p + 12] + bytes(4))[8:], "big") - 2**63): raw[p : p + 12] for p in range(len(raw) - 11)}
    heads = [suffixes[k[:2]] for k in keys]
    assert heads == sorted(heads)


def test_second_table_added_to_a_stored_family(spark, tmp_path):
    schema = "doc_id long, text string"
    first, second = ([r for k in ks for r in _texts(k)] for ks in ((0, 1, 2), (3, 4)))
    family = suffix_dedup.SuffixFamily.create(spark, str(tmp_path / "family"), 30, 12)
    family.add(spark.createDataFrame(first, schema), 2)
    assert rows(suffix_dedup.remove_repeats(spark.createDataFrame(first, schema), family=family)) == brute(first, 30)
    opened = suffix_dedup.SuffixFamily.open(spark, str(tmp_path / "family"))
    opened.add(spark.createDataFrame(second, schema))
    both = spark.createDataFrame(first + second, schema)
    assert rows(suffix_dedup.remove_repeats(both, family=opened)) == brute(first + second, 30) == rows(suffix_dedup.remove_repeats(both, 30, 12))


def test_own_family_keeps_no_arrays(spark, tmp_path):
    """Without a further batch the arrays only take disk; what was found and the entries stay."""
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([r for k in range(4) for r in _texts(k)], schema)
    family = suffix_dedup.SuffixFamily.create(spark, str(tmp_path / "family"), 30, 12)
    family.add(docs, 4)
    want = rows(suffix_dedup.remove_repeats(docs, family=family))
    family.end()
    assert not list((tmp_path / "family").glob("array-*")) and list((tmp_path / "family").glob("entries-*"))
    assert rows(suffix_dedup.remove_repeats(docs, family=family)) == want
    with pytest.raises(ValueError):
        suffix_dedup.SuffixFamily.open(spark, str(tmp_path / "family")).add(docs)


def test_own_family_is_deleted(spark):
    """Its entries are of no use once the matched ones are stored; before, they stayed on the disk beside all that follows."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("suffixes-*"))
    docs = [r for k in range(4) for r in _texts(k)]
    assert rows(suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 30, 12)) == brute(docs, 30)
    assert set(folder.glob("suffixes-*")) == before


def test_only_frequent_kinds_get_salts(spark, monkeypatch):
    """Before, each kind that occurs twice was written once for each of 32 salts."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdef é漢") for _ in range(n))
    everywhere, twice = text(45), [text(45) for _ in range(40)]
    docs = [(k, text(20) + everywhere + text(20) + twice[k % 40] + text(20)) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 10)
    family = suffix_dedup.SuffixFamily.create(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", 30, 12)
    family.add(df)
    matched, kind = family.matched(), ["g", "nh", "lo", "span"]
    groups = matched.groupBy(*kind).agg(F.count("*").alias("c"))
    more = [r.more for r in suffix_dedup._repeated_kinds(groups, kind).collect()]
    assert more.count(0) >= 40 and 1 <= sum(more) <= 10
    whole = suffix_dedup._whole(matched, groups, kind)
    assert whole.count() == groups.where("c > 1").agg(F.sum("c")).first()[0]
    assert rows(suffix_dedup.remove_repeats(df, family=family)) == brute(docs, 30)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).collect() == []
