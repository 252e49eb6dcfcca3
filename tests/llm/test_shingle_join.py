from __future__ import annotations

import random
import re

from quayside.llm import shingle_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets, group = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    ids = {g: min((d for (d, _), h in zip(docs, group) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, len(s), ids[g]) for (d, _), s, g in zip(docs, sets, group)), key=repr), group


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 20, 80, 300]))] for _ in range(12)]
    line = [rng.choice(vocabulary) for _ in range(12)]
    docs = []
    for k in range(260):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = line + words
        docs.append((k, " ".join(words).upper() if k % 5 == 0 else "\t".join(words)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (505, docs[3][1]), (505, docs[3][1]), (None, docs[3][1])]
    docs += [(None, "two"), (None, "two"), (600, "x y " * 4000), (601, "x y " * 4000 + "z")]
    return docs


def test_against_all_pairs(spark):
    for seed in (1,):
        docs = case(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "1 as row", "2 as token", "3 as t")
        got = shingle_join.join_components(df, range_bits=3).select("doc_id", "n_shingles", "component_id").collect()
        expected, group = brute(docs)
        assert sorted(map(tuple, got), key=repr) == expected
        assert sum(1 for g in set(group) if group.count(g) > 5) > 2
    odd = df.selectExpr("*", "1 as _row", "2 as d", "3 as times", "4 as out")
    kept = shingle_join.keep_one(odd)
    assert kept.columns == odd.columns
    groups = {}
    for k, g in enumerate(group):
        groups.setdefault(g, []).append(docs[k])
    first = [min(v, key=lambda r: (r[0] is None, r[0] or 0)) for v in groups.values()]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(first, key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shingle_join.join_components(none).collect() == []
    assert shingle_join.keep_one(none).collect() == []
