"""The library's column functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quayside.functions import sizes
from quayside.functions.accounting import STATES
from quayside.functions.hashing import weak_checksum
from quayside.functions.paths import OBJECT_URL, REMOTE_PATH


#: Blocks of a binary content, cut in one array per row; none of an empty or null one.
_BLOCKS = """RETURNS TABLE (block_index BIGINT, offset BIGINT, size BIGINT, data BINARY) RETURN
SELECT CAST(i AS BIGINT), CAST(i AS BIGINT) * block, CAST(length(d) AS BIGINT), d
FROM (SELECT posexplode(transform(
  filter(sequence(0, length(content) div block), k -> k * block < length(content)),
  k -> substring(content, k * block + 1, block))) AS (i, d))"""


def _split(text: str, pattern: str, fields: list[str]) -> str:
    quoted = pattern.replace("\\", "\\\\")
    parts = ", ".join(f"'{f}', regexp_extract({text}, '{quoted}', {i + 1})" for i, f in enumerate(fields))
    return f"CASE WHEN {text} RLIKE '{quoted}' THEN named_struct({parts}) END"


#: Texts of cluster accounting, as in functions.accounting. A number is digits with a plus sign at most.
_NUMBER = "CASE WHEN {0} RLIKE '^[+]?[0-9]+\\\\z' THEN try_cast({0} AS BIGINT) END"


def _accounting() -> dict[str, tuple[str, str, str]]:
    """(arguments, result, body) of each function."""
    t = "upper(trim(text))"
    unit = f"CASE right({t}, 1) WHEN 'G' THEN {1 << 30}L WHEN 'M' THEN {1 << 20}L WHEN 'K' THEN 1024L END"
    bare = f"CASE WHEN {unit} IS NULL THEN {t} ELSE left({t}, length({t}) - 1) END"
    days = f"CASE WHEN size(split(text, '-')) = 2 THEN coalesce({_NUMBER.format('split_part(text, \'-\', 1)')}, 0) ELSE 0 END"
    clock = "split(CASE WHEN size(split(text, '-')) = 2 THEN split_part(text, '-', 2) ELSE split_part(text, '-', 1) END, ':')"
    field = [f"coalesce({_NUMBER.format(f'get({clock}, {i})')}, 0)" for i in range(3)]
    seconds = f"""CASE size({clock}) WHEN 3 THEN {days} * 86400 + {field[0]} * 3600 + {field[1]} * 60 + {field[2]}
WHEN 2 THEN {days} * 86400 + {field[0]} * 3600 + {field[1]} * 60 END"""
    two = "CASE WHEN {0} < 10 THEN concat('0', {0}) ELSE CAST({0} AS STRING) END"
    tail = f"concat(':', {two.format('(seconds % 3600 div 60)')}, ':', {two.format('(seconds % 60)')})"
    limit = f"""CASE WHEN with_days AND seconds div 86400 > 0 THEN concat(seconds div 86400, '-', {two.format('(seconds % 86400 div 3600)')}, {tail})
WHEN seconds IS NOT NULL THEN concat({two.format('(seconds div 3600)')}, {tail}) END"""
    part = lambda i: f"regexp_extract(text, '(?s)^([^\\\\[]*)\\\\[([^\\\\]-]*)-([^\\\\]]*)\\\\]', {i})"
    low, high = (_NUMBER.format(part(i)) for i in (2, 3))
    nodes = f"""CASE WHEN NOT contains(text, '[') THEN transform(split(text, ','), n -> trim(n))
WHEN {low} <= {high} THEN transform(sequence({low}, {high}), n -> concat({part(1)},
  CASE WHEN length(CAST(n AS STRING)) >= length({part(2)}) THEN CAST(n AS STRING) ELSE lpad(CAST(n AS STRING), length({part(2)}), '0') END))
WHEN text IS NOT NULL THEN CAST(array() AS ARRAY<STRING>) END"""
    pairs = ", ".join(f"'{kind}/{state}', '{common}'" for kind, states in STATES.items() for state, common in states.items())
    kind = "CASE WHEN lower(scheduler) = 'pbspro' THEN 'pbs' ELSE lower(scheduler) END"
    listed = "contains(raw, 'job_state')"
    state = f"""CASE WHEN lower(scheduler) = 'sge' THEN CASE WHEN {listed} AND contains(raw, 'r') THEN 'Running' WHEN {listed} AND contains(raw, 'qw') THEN 'Pending'
ELSE 'Completed' END ELSE coalesce(try_element_at(map({pairs}), concat({kind}, '/', CASE WHEN {kind} = 'pbs' THEN raw ELSE upper(trim(raw)) END)), 'Unknown') END"""
    return {
        "memory_bytes": ("text STRING", "BIGINT", f"({_NUMBER.format(f'({bare})')}) * coalesce({unit}, 1L)"),
        "time_limit_seconds": ("text STRING", "BIGINT", seconds),
        "format_time_limit": ("seconds BIGINT, with_days BOOLEAN", "STRING", limit),
        "expand_nodes": ("text STRING", "ARRAY<STRING>", nodes),
        "normalize_state": ("scheduler STRING, raw STRING", "STRING", state),
    }


def register(spark: SparkSession) -> list[str]:
    """Registers parse_size, parse_bandwidth, split_object_url, split_remote_path, memory_bytes, time_limit_seconds,
    format_time_limit, expand_nodes, normalize_state, weak_checksum and the table function explode_blocks; returns their names.

    All but weak_checksum are SQL functions, which the optimizer inlines; nothing of them runs in Python.
    """
    bodies = {
        "parse_size": ("BIGINT", sizes.parse_size_sql("text")),
        "parse_bandwidth": ("BIGINT", sizes.parse_bandwidth_sql("text")),
        "split_object_url": ("STRUCT<bucket: STRING, key: STRING>", _split("text", OBJECT_URL, ["bucket", "key"])),
        "split_remote_path": (
            "STRUCT<user: STRING, host: STRING, path: STRING>", _split("text", REMOTE_PATH, ["user", "host", "path"])
        ),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {kind} RETURN {body}")
    accounting = _accounting()
    for name, (arguments, kind, body) in accounting.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udf.register("weak_checksum", weak_checksum)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION explode_blocks(content BINARY, block INT) {_BLOCKS}")
    return [*bodies, *accounting, "weak_checksum", "explode_blocks"]
