"""Deltas of files by ranges, and rolling matches in slices of files of any length."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import content, delta
from quayside.sources import copying, scan

BLOCK = 64


def versions(tmp_path):
    rnd = random.Random(11)
    base = rnd.randbytes(40 * BLOCK + 17)
    old = {"same": base, "moved": base, "edited": base, "gone": b"x", "zeros": bytes(50 * BLOCK), "short": b"abc", "emptied": b"1"}
    new = {
        "same": base,
        "moved": base[20 * BLOCK :] + base[: 20 * BLOCK],
        "edited": base[: 5 * BLOCK + 3] + b"!!" + base[5 * BLOCK + 5 :] + b"tail",
        "zeros": bytes(70 * BLOCK + 1),
        "short": b"abcd",
        "emptied": b"",
        "d/fresh": rnd.randbytes(300),
    }
    for name, files in (("old", old), ("new", new)):
        for path, data in files.items():
            target = tmp_path / name / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)
    return old, new


def frame(spark, files):
    return spark.createDataFrame([(p, len(d)) for p, d in files.items()], "path string, size long")


def signatures(spark, files, root):
    return content.signatures(scan.read_blocks(frame(spark, files), BLOCK, str(root)))


@pytest.mark.parametrize("most", [100, 1 << 20])
def test_ranges_rebuild_files(spark, tmp_path, most):
    old, new = versions(tmp_path)
    matches = delta.match_chunks(signatures(spark, new, tmp_path / "new"), signatures(spark, old, tmp_path / "old"))
    ranges = delta.delta_ranges(delta.delta_ops(matches, BLOCK), BLOCK, most)
    rows = ranges.collect()
    assert max(r["size"] for r in rows) <= most
    if most > 10_000:  # copies that follow each other are one range
        assert [(r.source_offset, r.dest_offset, r["size"]) for r in rows if r.path == "same"] == [(0, 0, len(old["same"]))]
        assert sum(r["size"] for r in rows if r.path == "edited" and r.op == "insert") < 3 * BLOCK
    written = copying.write_ranges(ranges, frame(spark, new), str(tmp_path / "old"), str(tmp_path / "new"), str(tmp_path / "out"), tasks=3)
    physical = written._jdf.queryExecution().executedPlan().toString()
    assert "data#" not in physical  # no bytes in any row
    for _ in range(2):  # a repeated task ends in the same state
        assert all(r.error is None and r.bytes == r["size"] for r in written.collect())
        assert {p: (tmp_path / "out" / p).read_bytes() for p in new} == new
    assert not os.path.exists(tmp_path / "out/gone")


def test_missing_base_is_reported(spark, tmp_path):
    old, new = versions(tmp_path)
    ranges = spark.createDataFrame([("gone", "copy", 0, 0, 9), ("none", "copy", 0, 0, 1)], "path string, op string, source_offset long, dest_offset long, size long")
    files = spark.createDataFrame([("gone", 9), ("none", 1)], "path string, size long")
    found = {r.path: (r.bytes, r.error) for r in copying.write_ranges(ranges, files, str(tmp_path / "old"), str(tmp_path / "new"), str(tmp_path / "out")).collect()}
    assert found == {"gone": (1, "8 bytes missing"), "none": (0, "FileNotFoundError: No such file or directory")}


def brute(old, new):
    found = set()
    for path, data in new.items():
        blocks = {}
        for i in range(len(old.get(path, b"")) // BLOCK):
            blocks.setdefault(old[path][i * BLOCK : (i + 1) * BLOCK], i)
        found |= {(path, o, blocks[data[o : o + BLOCK]]) for o in range(len(data) - BLOCK + 1) if data[o : o + BLOCK] in blocks}
    return found


@pytest.mark.parametrize("span", [1, 100, 1 << 20])
def test_rolling_matches(spark, tmp_path, span):
    old, new = versions(tmp_path)
    if span == 1:
        new = {p: d[: 4 * BLOCK] for p, d in new.items()}
        for path, data in new.items():
            (tmp_path / "new" / path).write_bytes(data)
    base = signatures(spark, old, tmp_path / "old")
    files = content.shifted_matches_in_files(frame(spark, new), str(tmp_path / "new"), base, BLOCK, span=span)
    assert {(r.path, r.offset, r.source_index) for r in files.collect()} == brute(old, new)
    assert files.count() == len(brute(old, new))
    held = spark.createDataFrame([(p, d) for p, d in new.items()], "path string, content binary")
    assert {(r.path, r.offset, r.source_index) for r in content.shifted_matches(held, base, BLOCK, span=span).collect()} == brute(old, new)


def test_zeros_make_one_row_per_slice(spark, tmp_path):
    old, new = versions(tmp_path)
    base = signatures(spark, old, tmp_path / "old").where(F.col("size") == BLOCK)
    assert base.where("path = 'zeros'").select("weak").distinct().count() == 1
    rows = content._rolled(new["zeros"], 1000, BLOCK, *_filter_of(base, "zeros"))
    assert [(first, last) for first, last, _, _ in rows] == [(1000, 1000 + len(new["zeros"]) - BLOCK)]


def _filter_of(base, path):
    import numpy as np

    row = content.weak_filters(base).where(F.col("path") == path).first()
    wanted = np.zeros(row.bits // 64 + 1, dtype=np.uint64)
    wanted[row.words] = np.array(row["values"], dtype=np.int64).view(np.uint64)
    return wanted, row.bits


def test_filter_lets_few_others_through(spark, tmp_path):
    import numpy as np

    old, _ = versions(tmp_path)
    base = signatures(spark, old, tmp_path / "old").where(F.col("size") == BLOCK)
    wanted, bits = _filter_of(base, "same")
    ask = lambda weak: ((wanted[(p := content.filter_places(weak, bits)) >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1).all(axis=1)
    inside = np.array([r.weak for r in base.where("path = 'same'").collect()])
    assert ask(inside).all()
    assert ask(np.random.default_rng(1).integers(0, 2**32, 20_000)).mean() < 0.03
