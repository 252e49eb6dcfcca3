"""Cluster accounting texts: memory, time limits, node lists, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.paths import _col

_UNSIGNED = r"\A\+?[0-9]+\z"


def _unsigned(text: Column) -> Column:
    """Whole number in ``text``, else null."""
    return F.when(text.rlike(_UNSIGNED), text.try_cast("bigint"))


def memory_bytes(text: Column | str) -> Column:
    """``4G``, ``512m``, ``1024K`` or plain bytes; fractions and inner blanks are malformed."""
    t = F.upper(F.trim(_col(text)))
    unit = F.substring(t, -1, 1)
    factor = (
        F.when(unit == "G", 1024**3).when(unit == "M", 1024**2).when(unit == "K", 1024).otherwise(1)
    )
    number = F.when(unit.isin("G", "M", "K"), F.regexp_replace(t, r".\z", "")).otherwise(t)
    return _unsigned(number) * factor.cast("bigint")


def time_limit_seconds(text: Column | str) -> Column:
    """``D-HH:MM:SS``, ``HH:MM:SS`` or ``HH:MM``; unreadable fields count as 0, any other
    number of fields is null."""
    dash = F.split(_col(text), "-")
    with_days = F.size(dash) == 2
    days = F.when(with_days, F.coalesce(_unsigned(dash[0]), F.lit(0))).otherwise(0)
    clock = F.split(F.when(with_days, F.get(dash, 1)).otherwise(dash[0]), ":")
    field = lambda i: F.coalesce(_unsigned(F.get(clock, i)), F.lit(0))
    n = F.size(clock)
    seconds = F.when(n == 3, field(2)).otherwise(0)
    return F.when(n.isin(2, 3), days * 86400 + field(0) * 3600 + field(1) * 60 + seconds)


def _two(c: Column) -> Column:
    """At least two digits."""
    return F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))


def format_time_limit(seconds: Column | str, with_days: bool = True) -> Column:
    """``HH:MM:SS``, with a ``D-`` prefix from one day on (or plain hours without it)."""
    s = _col(seconds)
    whole = lambda e: F.floor(e).cast("bigint")
    rest = F.concat(F.lit(":"), _two(whole(s % 3600 / 60)), F.lit(":"), _two(s % 60))
    plain = F.concat(_two(whole(s / 3600)), rest)
    if not with_days:
        return plain
    days = whole(s / 86400)
    return F.when(
        days > 0, F.concat(days.cast("string"), F.lit("-"), _two(whole(s % 86400 / 3600)), rest)
    ).otherwise(plain)


def expand_nodes(nodes: Column | str) -> Column:
    """Array of node names from ``node[01-04]`` or ``a, b``; a malformed range gives none."""
    text = _col(nodes)
    pattern = r"(?s)\A([^\[]*)\[([^\]\-]*)-([^\]]*)\]"
    low, high = (_unsigned(F.regexp_extract(text, pattern, i)) for i in (2, 3))
    width = F.length(F.regexp_extract(text, pattern, 2))
    number = lambda n: F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(
        F.lpad(n.cast("string"), width, F.lit("0"))
    )
    ranged = F.when(
        low <= high,
        F.transform(
            F.sequence(low, high), lambda n: F.concat(F.regexp_extract(text, pattern, 1), number(n))
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.contains(text, F.lit("[")), ranged).otherwise(
        F.transform(F.split(text, ","), lambda n: F.trim(n))
    )


def normalize_jobs(df: DataFrame) -> DataFrame:
    """Adds memory_bytes, time_limit_seconds, time_limit_text, hours_text and nodes."""
    out = df.select(
        "*",
        memory_bytes("memory").alias("memory_bytes"),
        time_limit_seconds("time_limit").alias("time_limit_seconds"),
        expand_nodes("node_list").alias("nodes"),
    )
    return out.select(
        "*",
        format_time_limit("time_limit_seconds").alias("time_limit_text"),
        format_time_limit("time_limit_seconds", with_days=False).alias("hours_text"),
    )


def job_nodes(df: DataFrame) -> DataFrame:
    """One row per allocated node."""
    return df.select("job_id", F.explode(expand_nodes("node_list")).alias("node"))


def job_resources(df: DataFrame) -> DataFrame:
    """Adds total_cpus (tasks x cpus per task, or the one that is known) and node_count."""
    tasks, cpus = F.col("num_tasks"), F.col("cpus_per_task")
    return df.select(
        "*",
        F.coalesce(tasks * cpus, tasks, cpus).alias("total_cpus"),
        F.size(expand_nodes("node_list")).alias("node_count"),
    )


# Raw scheduler states and their common name. Case matters for pbs only.
STATES = {
    "slurm": {
        "PENDING": "Pending", "CONFIGURING": "Pending", "RUNNING": "Running", "COMPLETING": "Running",
        "COMPLETED": "Completed", "FAILED": "Failed", "TIMEOUT": "Failed", "NODE_FAIL": "Failed",
        "CANCELLED": "Cancelled",
    },
    "pbs": {
        "Q": "Pending", "W": "Pending", "H": "Pending", "R": "Running", "E": "Running", "C": "Completed",
    },
    "lsf": {"PEND": "Pending", "RUN": "Running", "DONE": "Completed", "EXIT": "Failed"},
}


def normalize_state(scheduler: Column | str, raw: Column | str) -> Column:
    """Pending, Running, Completed, Failed, Cancelled or Unknown from a scheduler's own state.

    For ``sge`` the raw text is the job's whole status output; without a state in it the job
    has left the queue and counts as completed. ``pbspro`` is ``pbs``.
    """
    kind, text = F.lower(_col(scheduler)), _col(raw)
    pairs = [
        F.lit(v)
        for name, states in STATES.items()
        for state, common in states.items()
        for v in (f"{name}/{state}", common)
    ]
    table = F.create_map(*pairs)
    kind = F.when(kind == "pbspro", "pbs").otherwise(kind)
    state = F.when(kind == "pbs", text).otherwise(F.upper(F.trim(text)))
    listed = F.contains(text, F.lit("job_state"))
    sge = (
        F.when(listed & F.contains(text, F.lit("r")), "Running")
        .when(listed & F.contains(text, F.lit("qw")), "Pending")
        .otherwise("Completed")
    )
    known = F.try_element_at(table, F.concat(kind, F.lit("/"), state))
    return F.when(kind == "sge", sge).otherwise(F.coalesce(known, F.lit("Unknown")))
