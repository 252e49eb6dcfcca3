"""Queries on contents, blocks and deltas. Block size is 256 bytes of UTF-8 text."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.catalog.tables import Tables, oracle
from quayside.catalog.trees import sizes, tree
from quayside.functions import paths
from quayside.functions.hashing import hash_content, quick_hash, register_hash, xor_digests
from quayside.operators import content, delta
from quayside.session import persist_shared
from quayside.sources import copying, scan

BLOCK = 256


def _blocks(df):
    return content.split_blocks(df, "text", BLOCK, keep=["file_id", "path"])


def _signatures(df):
    return content.signatures(_blocks(df))


def _matches(t: Tables):
    return delta.match_chunks(_signatures(t.content_new()), _signatures(t.content()))


BYTE = "CAST(concat('0x', substr(h, (2 * i + 1)::INT, 2)) AS BIGINT)"
WEAK = f"""(list_sum(list_transform(range(size), lambda i: (size - i) * {BYTE}))::BIGINT * 65536) % 4294967296
  + list_sum(list_transform(range(size), lambda i: {BYTE}))::BIGINT % 65536"""

MATCHES = {
    "base": "SELECT path, data, min(block_index) AS source_index FROM blocks GROUP BY path, data",
    "matches": """SELECT n.path, n.block_index, n."offset", n.size, n.data, b.source_index
FROM blocks_new n LEFT JOIN base b ON n.path = b.path AND n.data = b.data""",
}

OPS = """SELECT path, 'copy' AS op, source_index, "offset" AS dest_offset, size, block_index AS first_block, CAST(1 AS BIGINT) AS n_blocks
FROM matches WHERE source_index IS NOT NULL
UNION ALL SELECT path, 'insert', NULL, min("offset"), CAST(sum(size) AS BIGINT), min(block_index), count(*)
FROM (SELECT *, block_index - row_number() OVER (PARTITION BY path ORDER BY block_index) AS island
  FROM matches WHERE source_index IS NULL) GROUP BY path, island"""

HOLES = """SELECT path, min("offset") AS "offset", CAST(sum(size) AS BIGINT) AS length FROM (
  SELECT *, block_index - row_number() OVER (PARTITION BY path ORDER BY block_index) AS island
  FROM zero_blocks WHERE h = repeat('00', size::INT)) GROUP BY path, island HAVING sum(size) >= 512"""


def _file_signatures(t: Tables, contents, root: str):
    """Signatures of files that are read by range."""
    return content.signatures(scan.read_blocks(sizes(contents), BLOCK, root))


def _write(t: Tables) -> tuple[str, DataFrame]:
    """The new version rebuilt as files from ranges of the old one and of itself: (folder, result rows)."""
    old_root, new_root = tree(t), tree(t, t.content_new())
    matches = delta.match_chunks(_file_signatures(t, t.content_new(), new_root), _file_signatures(t, t.content(), old_root))
    ranges = delta.delta_ranges(delta.delta_ops(matches, BLOCK), BLOCK, most=4096)
    target = new_root + "-rebuilt"
    return target, persist_shared(copying.write_ranges(ranges, sizes(t.content_new()), old_root, new_root, target))


def _rebuilt(t: Tables):
    target, _ = _write(t)
    return copying.hash_files(sizes(t.content_new()), target, "sha256").select("path", "size", F.col("hash").alias("sha256"))


def _shifted(t: Tables):
    old_root, new_root = tree(t), tree(t, t.content_new())
    base = _file_signatures(t, t.content(), old_root)
    return content.shifted_matches_in_files(sizes(t.content_new()), new_root, base, BLOCK, span=8192)


def _registered(t: Tables):
    """A hash that the caller brings along, under its own name."""
    register_hash("md5", lambda data: hashlib.md5(data).hexdigest())
    return hash_content(t.content(), "text", "md5").select("path", "algorithm", "hash")


def _same_hash(t: Tables, hashed):
    """Files with the first path that has the same hash: equal contents are found by their hashes alone."""
    narrow = persist_shared(hashed.select("path", "hash"))  # hashed once, for both sides
    return narrow.join(narrow.groupBy("hash").agg(F.min("path").alias("first_path")), "hash").select("path", "first_path")


SAME_TEXT = """SELECT path, first_path FROM content JOIN (SELECT text AS t, min(path) AS first_path FROM content GROUP BY text) ON text = t"""


def _resume(t: Tables):
    """Interrupted copies of every file: two thirds were written, some copies got damaged, and
    some sources have changed since (``content_new``)."""
    old, size, raw = t.content(), F.octet_length("text").cast("bigint"), F.col("text").cast("binary")
    written = F.when(F.col("file_id") % 4 == 0, 0).otherwise(F.floor(size * 2 / 3)).cast("bigint")
    states = old.select(
        "path", size.alias("size"), written.alias("bytes_written"), content.partial_checksum(raw, written).alias("partial_checksum")
    )
    damaged = F.when(F.col("file_id") % 9 == 0, F.concat(F.lit("?"), "text")).otherwise(F.col("text")).cast("binary")
    partial = old.select("path", content.partial_checksum(damaged, written).alias("checksum"))
    source = t.content_new().select("path", size.alias("size"))
    return content.resume_actions(states, source, partial)


RESUME = """SELECT path, action, CASE WHEN action IN ('start', 'restart') THEN 0 WHEN action = 'resume' THEN written END AS "offset",
  CASE WHEN action IN ('start', 'restart') THEN size WHEN action = 'resume' THEN size - written END AS remaining FROM (
  SELECT o.path, o.size, written, CASE WHEN n.path IS NULL THEN 'source_missing' WHEN strlen(n.text) <> o.size THEN 'source_changed'
    WHEN written = 0 THEN 'start'
    WHEN o.file_id % 9 = 0 AND substr(hex(encode(o.text)), 1, (2 * written)::INT) <> substr(hex(encode(concat('?', o.text))), 1, (2 * written)::INT) THEN 'restart' ELSE 'resume' END AS action
  FROM (SELECT file_id, path, text, strlen(text) AS size,
      CASE WHEN file_id % 4 = 0 THEN 0 ELSE CAST(floor(strlen(text) * 2 / 3.0) AS BIGINT) END AS written FROM content) o
  LEFT JOIN content_new n ON n.path = o.path)"""


def _key():
    return F.lit(bytes(range(32)))


def _sealed(t: Tables):
    """Every third file sealed, the others left in clear."""
    raw = t.content().select("file_id", "path", F.encode("text", "UTF-8").alias("content"))
    sealed = content.encrypt_content(raw.withColumn("clear", F.col("content")), _key())
    return sealed.withColumn("content", F.when(F.col("file_id") % 3 == 0, F.col("content")).otherwise(F.col("clear"))).drop("clear")


def _round_trip(t: Tables):
    plain = t.content().select("path", F.encode("text", "UTF-8").alias("content"))
    sealed = content.encrypt_content(plain, _key())
    opened = content.decrypt_content(sealed, _key())
    return opened.select("path", F.sha2("content", 256).alias("sha256"))


def _overhead(t: Tables):
    plain = t.content().select("path", F.encode("text", "UTF-8").alias("content"), F.octet_length("text").alias("size"))
    sealed = content.encrypt_content(plain, _key())
    grown = F.length("content")
    return sealed.select(
        "path", grown.cast("bigint").alias("sealed_size"), F.round(content.encryption_overhead(F.col("size"), grown), 6).alias("overhead")
    )


def _compression(t: Tables):
    blocks = content.split_blocks(t.content(), "text", 4 * 1024 * 1024, keep=["path"])
    measured = content.measure_compression(blocks)
    return content.compression_stats(measured, [paths.parent(paths.parent("path")).alias("directory")])


QUERIES = {
    "hash_sha256": (
        lambda t: hash_content(t.content(), "text", "sha256").select("path", "algorithm", "hash"),
        oracle("SELECT path, 'sha256' AS algorithm, sha256(text) AS hash FROM content", "content"),
    ),
    "hash_xxh3_128": (lambda t: _same_hash(t, hash_content(t.content(), "text", "xxh3_128")), oracle(SAME_TEXT, "content")),
    "hash_xxhash64": (lambda t: _same_hash(t, hash_content(t.content(), "text", "xxhash64")), oracle(SAME_TEXT, "content")),
    "hash_registered": (_registered, oracle("SELECT path, 'md5' AS algorithm, md5(text) AS hash FROM content", "content")),
    "quick_hash": (lambda t: _same_hash(t, t.content().withColumn("hash", quick_hash("text"))), oracle(SAME_TEXT, "content")),
    "quick_hash_changes": (
        lambda t: t.content().select("path", quick_hash("text").alias("a")).join(
            t.content_new().select("path", quick_hash("text").alias("b")), "path"
        ).select("path", (F.col("a") != F.col("b")).alias("changed")),
        oracle("SELECT a.path, a.text <> b.text AS changed FROM content a JOIN content_new b ON a.path = b.path", "content_new"),
    ),
    "split_blocks": (
        lambda t: _blocks(t.content_new()).withColumn("data", F.hex("data")),
        oracle('SELECT file_id, path, block_index, "offset", size, h AS data FROM blocks_new', "blocks_new"),
    ),
    "block_signatures": (
        lambda t: _signatures(t.content()),
        oracle(f'SELECT file_id, path, block_index, "offset", size, {WEAK} AS weak, sha256(data) AS strong FROM blocks', "blocks"),
    ),
    "signature_summary": (
        lambda t: content.signature_summary(_signatures(t.content_new()), files=t.content_new()),
        oracle("SELECT path, strlen(text) AS file_size, (strlen(text) + 255) // 256 AS num_chunks FROM content_new", "content_new"),
    ),
    "shifted_blocks": (
        _shifted,
        oracle(
            """SELECT n.path, n.o AS "offset", b.source_index FROM (
  SELECT path, o, md5_number(substr(x, (2 * o + 1)::INT, 512)) AS h
  FROM (SELECT path, x, unnest(range(length(x) // 2 - 255)) AS o FROM (SELECT path, hex(encode(text)) AS x FROM content_new) WHERE length(x) >= 512)) n
JOIN (SELECT path, md5_number(x) AS h, source_index FROM (SELECT path, h AS x, min(block_index) AS source_index FROM blocks WHERE size = 256 GROUP BY path, h)) b
  ON n.path = b.path AND n.h = b.h""",
            "blocks", "content_new",
        ),
    ),
    "match_chunks": (
        lambda t: _matches(t).select("path", "block_index", "size", "source_index"),
        oracle("SELECT path, block_index, size, source_index FROM matches", "blocks", "blocks_new", extra=MATCHES),
    ),
    "delta_ops": (
        lambda t: delta.delta_ops(_matches(t), BLOCK),
        oracle(OPS, "blocks", "blocks_new", extra=MATCHES),
    ),
    "delta_summary": (
        lambda t: delta.delta_summary(_matches(t), t.content_new()).withColumn("savings_percent", F.round("savings_percent", 6)),
        oracle(
            """SELECT c.path, CAST(strlen(c.text) AS BIGINT) AS target_size,
  CAST(coalesce(sum(size) FILTER (source_index IS NULL), 0) AS BIGINT) AS transfer_size,
  count(source_index) AS matched_chunks, count(size) AS total_chunks,
  round(CASE WHEN strlen(c.text) = 0 THEN 0.0
    ELSE (sum(size) - coalesce(sum(size) FILTER (source_index IS NULL), 0))::DOUBLE / sum(size)::DOUBLE * 100.0 END, 6) AS savings_percent
FROM content_new c LEFT JOIN matches m ON c.path = m.path GROUP BY c.path, c.text""",
            "blocks", "blocks_new", extra=MATCHES,
        ),
    ),
    "apply_delta": (
        _rebuilt,
        oracle("SELECT path, strlen(text) AS size, sha256(text) AS sha256 FROM content_new", "content_new"),
    ),
    "apply_delta_summary": (
        lambda t: delta.apply_summary(_write(t)[1].where("op IS NOT NULL"), t.content_new()),
        oracle(
            """SELECT c.path, CAST(coalesce(sum(size) FILTER (source_index IS NOT NULL), 0) AS BIGINT) AS bytes_copied,
  CAST(coalesce(sum(size) FILTER (source_index IS NULL), 0) AS BIGINT) AS bytes_written
FROM content_new c LEFT JOIN matches m ON c.path = m.path GROUP BY c.path""",
            "blocks", "blocks_new", extra=MATCHES,
        ),
    ),
    "composite_hash": (
        lambda t: delta.composite_hash(_blocks(t.content_new()).withColumn("strong", F.sha2("data", 256)), files=t.content_new()),
        oracle(
            """SELECT path, CAST(CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END AS BIGINT) AS composite
FROM (SELECT c.path, coalesce(bit_xor(CASE WHEN r = 0 THEN h ELSE
    (((h::UHUGEINT * (CAST(1 AS UHUGEINT) << CAST(r AS UHUGEINT))) % 18446744073709551616::UHUGEINT)::UBIGINT | (h >> (64 - r))) END), 0::UBIGINT) AS u
  FROM content_new c LEFT JOIN (SELECT path, (block_index % 64)::INT AS r, CAST(concat('0x', substr(sha256(data), 1, 16)) AS UBIGINT) AS h FROM blocks_new) b
    ON c.path = b.path GROUP BY c.path)""",
            "blocks_new",
        ),
    ),
    "composite_digest": (
        lambda t: _blocks(t.content()).groupBy("path").agg(
            xor_digests(F.sha2("data", 256)).alias("digest")
        ),
        oracle(
            "SELECT path, concat("
            + ", ".join(f"lpad(lower(hex(bit_xor(CAST(concat('0x', substr(h, {i}, 16)) AS UBIGINT)))), 16, '0')" for i in (1, 17, 33, 49))
            + ") AS digest FROM (SELECT path, sha256(data) AS h FROM blocks) GROUP BY path",
            "blocks",
        ),
    ),
    "zero_blocks": (
        lambda t: content.flag_zero(t.zero_blocks()).select("path", "block_index", "is_zero"),
        oracle("SELECT path, block_index, h = repeat('00', size::INT) AS is_zero FROM zero_blocks", "zero_blocks"),
    ),
    "find_holes": (
        lambda t: content.find_holes(t.zero_blocks(), ["path"], BLOCK, 512),
        oracle(HOLES, "zero_blocks"),
    ),
    "sparse_summary": (
        lambda t: content.sparse_summary(t.zero_blocks(), ["path"], BLOCK, 512, t.content()).withColumn("sparse_ratio", F.round("sparse_ratio", 9)),
        oracle(
            """SELECT b.path, logical_size, coalesce(saved, 0) AS space_saved, logical_size - coalesce(saved, 0) AS bytes_written,
  coalesce(n, 0) AS holes, round(coalesce(saved, 0) / logical_size::DOUBLE, 9) AS sparse_ratio
FROM (SELECT path, CAST(sum(size) AS BIGINT) AS logical_size FROM zero_blocks GROUP BY path) b
LEFT JOIN (SELECT path, CAST(sum(length) AS BIGINT) AS saved, count(*) AS n FROM holes GROUP BY path) h ON b.path = h.path""",
            "zero_blocks", extra={"holes": HOLES},
        ),
    ),
    "compression_stats": (_compression, None),
    "resume_actions": (_resume, oracle(RESUME, "content_new")),
    "encrypt_round_trip": (
        _round_trip,
        oracle("SELECT path, sha256(text) AS sha256 FROM content", "content"),
    ),
    "encryption_overhead": (
        _overhead,
        oracle(
            """SELECT path, strlen(text) + 34 AS sealed_size,
  round(CASE WHEN strlen(text) > 0 THEN ((strlen(text) + 34) / strlen(text)::DOUBLE - 1.0) * 100.0 ELSE 0.0 END, 6) AS overhead FROM content""",
            "content",
        ),
    ),
    "find_encrypted": (
        lambda t: content.find_encrypted(_sealed(t)).select("path"),
        oracle("SELECT path FROM content WHERE file_id % 3 = 0", "content"),
    ),
}
