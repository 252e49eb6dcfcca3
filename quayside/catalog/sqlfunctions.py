"""Queries written in SQL with the registered functions."""

from __future__ import annotations

from quayside.catalog import texts
from quayside.catalog.content import WEAK
from quayside.catalog.inventory import URIS_SQL, _uris
from quayside.catalog.tables import Tables, oracle
from quayside.catalog.texts import SIZE_TEXTS, _parsed, _size_texts
from quayside.functions.sql import register


def _sizes(t: Tables):
    register(t.spark)
    _size_texts(t).createOrReplaceTempView("size_texts")
    return t.spark.sql("SELECT id, text, parse_size(text) AS bytes FROM size_texts")


def _uris_sql(t: Tables):
    register(t.spark)
    _uris(t).select("page_id", "uri").createOrReplaceTempView("uris")
    return t.spark.sql(
        """SELECT page_id, uri, o.bucket, o.key, r.user AS user_name, r.host, r.path AS remote_path
FROM (SELECT *, split_object_url(uri) AS o, split_remote_path(uri) AS r FROM uris)"""
    )


def _blocks(t: Tables):
    register(t.spark)
    t.content().createOrReplaceTempView("content")
    return t.spark.sql(
        """SELECT path, b.block_index, b.size, weak_checksum(b.data) AS weak
FROM content, LATERAL explode_blocks(encode(text, 'UTF-8'), 256) b"""
    )


def _accounting(t: Tables):
    register(t.spark)
    t.accounting().createOrReplaceTempView("accounting")
    return t.spark.sql(
        """SELECT job_id, memory_bytes, time_limit_seconds, format_time_limit(time_limit_seconds, true) AS time_limit_text,
  format_time_limit(time_limit_seconds, false) AS hours_text, nodes
FROM (SELECT job_id, memory_bytes(memory) AS memory_bytes, time_limit_seconds(time_limit) AS time_limit_seconds,
  array_join(expand_nodes(node_list), ' ') AS nodes FROM accounting)"""
    )


def _states(t: Tables):
    register(t.spark)
    texts._raw_states(t).createOrReplaceTempView("raw_states")
    return t.spark.sql("SELECT scheduler, raw, normalize_state(scheduler, raw) AS state, count(*) AS n FROM raw_states GROUP BY ALL")


QUERIES = {
    "sql_accounting": (_accounting, texts.QUERIES["normalize_jobs"][1]),
    "sql_job_states": (_states, texts.STATES),
    "sql_parse_size": (
        _sizes,
        oracle(_parsed("bytes", [("T", 4), ("G", 3), ("M", 2), ("K", 1)], "[UB]+$", "B+$"), extra={"texts": SIZE_TEXTS}),
    ),
    "sql_split_uris": (_uris_sql, URIS_SQL),
    "sql_explode_blocks": (
        _blocks,
        oracle(f"SELECT path, block_index, size, {WEAK} AS weak FROM blocks", "blocks"),
    ),
}
