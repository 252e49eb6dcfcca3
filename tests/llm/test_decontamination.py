from __future__ import annotations

import hashlib
import random
import re

from quayside.llm import decontamination
from quayside.llm.decontamination import build_index, search, verdicts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, slop=0):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            b = words(item)
            for at in range(max(1, len(b) - 9) if b else 0):
                window = b[at : at + 10]
                for s in range(-slop, len(w) + slop):
                    if all(any(0 <= s + k + d < len(w) and w[s + k + d] == x for d in range(-slop, slop + 1)) for k, x in enumerate(window)):
                        ids.add(str(item_id))
                        hit |= set(range(s, s + len(window)))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "Zug", "é", "x1", "tree", "stone"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([12, 15, 30]))) for k in range(6)] + [(20, "Stone tree"), (21, ""), (22, None), (100, "the the the the the the the the the the the")]
    docs = []
    for k in range(40):
        item = rng.choice(items)[1] or ""
        docs.append((k, f"{text(rng.randint(0, 40))}. {item.upper() if k % 4 == 0 else item if k % 2 else ''} {text(5)}"))
    docs += [(50, None), (51, ""), (52, "the " * 3000), (52, "the " * 3000), (53, "stone"), (54, "tree")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as segment", "2 as term", "3 as runs")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    index = build_index(d.repartition(3), segment_chars=500)
    assert index.where("places is not null").count() > 0
    for block_words in (1_000_000, 20):  # one block, and several
        got = verdicts(search(index, b, block_words=block_words)).drop("n_near_items").collect()
        assert sorted(map(tuple, got), key=repr) == expected
    near = verdicts(search(index, b, slop=1)).collect()
    expected_near = {r[0]: r[3] for r in brute([x for x in docs if x[0] != 52], items, slop=1)}
    assert {r.doc_id: r.n_near_items for r in near if r.doc_id != 52} == expected_near


def test_swapped_and_left_out_words(spark):
    """A place off is near; two places off, or a word that is missing, is not."""
    item = "one two three four five six seven eight nine ten"
    w = item.split()
    texts = [item, " ".join([*w[:4], w[5], w[4], *w[6:]]), " ".join([*w[:4], w[6], w[5], w[4], *w[7:]]), " ".join([*w[:5], "x", *w[6:]]),
             " ".join([*w[:5], "x", *w[5:]]), " ".join([*w[:5], "x", "y", "z", *w[5:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (7, item), (7, item)], "item_id long, text string").selectExpr("*", "1 as segment", "2 as term")
    rows = {r.doc_id: (r.contaminated, r.n_near_items) for r in verdicts(search(build_index(docs), items, slop=1)).collect()}
    assert rows == {0: (True, 1), 1: (False, 1), 2: (False, 0), 3: (False, 0), 4: (False, 1), 5: (False, 0)}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = verdicts(search(build_index(docs.where("false")), items)).collect()
    assert none == []
    rows = verdicts(search(build_index(docs), items.where("false"))).collect()
    assert sorted(((r.doc_id, r.n_hit) for r in rows), key=repr) == [(1, 0), (None, 0)]
    assert decontamination.GAP > 20
