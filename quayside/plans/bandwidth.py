"""Bandwidth schedules: which rule applies at an instant, when it changes, who broke it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.paths import _col
from quayside.operators.ordered import fold

# Day names of a schedule file, Monday first (Spark's weekday() numbers them 0 to 6).
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@dataclass(frozen=True)
class Rule:
    """``days`` None means every day; ``limit`` 0 means unlimited; times are minutes of day."""

    name: str
    start: int
    end: int
    limit: int
    days: tuple[str, ...] | None = None
    priority: int = 0


@dataclass(frozen=True)
class Schedule:
    """Rules in the order they are tried."""

    rules: tuple[Rule, ...] = field(default=())
    default_limit: int = 0
    enabled: bool = True

    def with_rule(self, rule: Rule) -> Schedule:
        """Adding a rule sorts all of them by falling priority; a constructor keeps its order."""
        rules = sorted([*self.rules, rule], key=lambda r: -r.priority)
        return Schedule(tuple(rules), self.default_limit, self.enabled)


def minutes(hhmm: str) -> int:
    """Minute of the day of ``HH:MM``, each part limited to its largest value."""
    hour, minute = (int(p) for p in hhmm.split(":"))
    return min(hour, 23) * 60 + min(minute, 59)


def business_hours(day_limit: int, night_limit: int) -> Schedule:
    """Limited on workdays 9 to 18 h, another limit every night 22 to 6 h."""
    work = Rule("Business hours", minutes("09:00"), minutes("18:00"), day_limit, tuple(DAYS[:5]), 10)
    night = Rule("Night hours", minutes("22:00"), minutes("06:00"), night_limit, None, 5)
    return Schedule((work, night), default_limit=day_limit)


def weekend_full_speed(weekday_limit: int) -> Schedule:
    """Unlimited at weekends, except for the last minute of the day, which no end time covers."""
    rule = Rule("Weekend", minutes("00:00"), minutes("23:59"), 0, tuple(DAYS[5:]), 10)
    return Schedule((rule,), default_limit=weekday_limit)


def read_schedule(spark: SparkSession, path: str) -> Schedule:
    """A schedule from its JSON document (one small document, read whole)."""
    doc = json.loads(spark.read.text(path, wholetext=True).first().value)
    rules = tuple(
        Rule(
            r["name"],
            r["start_time"]["hour"] * 60 + r["start_time"]["minute"],
            r["end_time"]["hour"] * 60 + r["end_time"]["minute"],
            r["limit"],
            tuple(r["days"]) if r.get("days") is not None else None,
            r.get("priority", 0),
        )
        for r in doc["rules"]
    )
    return Schedule(rules, doc["default_limit"], doc["enabled"])


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(_col(ts)) * 60 + F.minute(_col(ts))


def _applies(rule: Rule, ts: Column) -> Column:
    now = minute_of_day(ts)
    after, before = now >= rule.start, now < rule.end
    # a rule that ends before it starts spans midnight and is judged by the present day
    inside = (after & before) if rule.start <= rule.end else (after | before)
    if rule.days is not None:
        inside = inside & F.weekday(ts).isin([DAYS.index(d) for d in rule.days])
    return inside


def apply_schedule(df: DataFrame, schedule: Schedule, ts: str = "ts") -> DataFrame:
    """Adds ``rule`` (null if none) and ``limit`` in force at each instant; first match wins.

    A schedule is a short list, so it becomes a CASE over the row and no join at all.
    """
    when = _col(ts)
    rule, limit = F.lit(None).cast("string"), F.lit(schedule.default_limit).cast("bigint")
    if not schedule.enabled:
        return df.select("*", rule.alias("rule"), F.lit(0).cast("bigint").alias("limit"))
    for r in reversed(schedule.rules):
        hit = _applies(r, when)
        rule = F.when(hit, r.name).otherwise(rule)
        limit = F.when(hit, F.lit(r.limit).cast("bigint")).otherwise(limit)
    return df.select("*", rule.alias("rule"), limit.alias("limit"))


def next_change(df: DataFrame, schedule: Schedule, ts: str = "ts") -> DataFrame:
    """Adds ``next_change_seconds``: wait until the next start or end of any rule, whatever
    its days; null without rules. A boundary in the present minute counts as tomorrow's."""
    if not schedule.enabled or not schedule.rules:
        return df.withColumn("next_change_seconds", F.lit(None).cast("bigint"))
    now = minute_of_day(ts)
    bounds = sorted({b for r in schedule.rules for b in (r.start, r.end)})
    waits = [F.when(F.lit(b) > now, F.lit(b) - now).otherwise(F.lit(1440 + b) - now) for b in bounds]
    wait = F.least(*waits) if len(waits) > 1 else waits[0]
    return df.withColumn("next_change_seconds", (wait * 60).cast("bigint"))


def compliance(df: DataFrame, schedule: Schedule, ts: str = "ts", size: str = "bytes") -> DataFrame:
    """Bytes per minute against the limit in force at that minute; limit 0 is never exceeded."""
    per_minute = df.groupBy(F.date_trunc("minute", _col(ts)).alias("minute")).agg(
        F.sum(size).alias("bytes")
    )
    ruled = apply_schedule(per_minute, schedule, "minute")
    return ruled.withColumn(
        "exceeded", (F.col("limit") > 0) & (F.col("bytes") > F.col("limit") * 60)
    )


def token_bucket(
    requests: DataFrame,
    keys: list[str],
    limit: int,
    ts: str = "ts",
    size: str = "bytes",
    tie: str | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Adds ``tokens`` (after refill, before the request), ``granted`` and ``wait_seconds``.

    The bucket starts full with one second's worth, refills with elapsed time up to two
    seconds' worth, and a request that does not fit waits without taking anything.
    ``ts`` may be a timestamp or microseconds.
    """
    micros = F.col(ts) if dict(requests.dtypes)[ts] == "bigint" else F.unix_micros(F.col(ts).cast("timestamp"))
    order = ["_us"] + ([tie] if tie else [])
    base = requests.withColumn("_us", micros)
    if limit == 0:
        return requests.select(
            "*", F.lit(None).cast("bigint").alias("tokens"), F.lit(True).alias("granted"), F.lit(0.0).alias("wait_seconds")
        )

    def step(state, rows):
        us, want = rows["_us"], rows[size]
        tokens, last = state or (limit, int(us[0]))
        have = np.empty(len(us), dtype=np.int64)
        granted = np.empty(len(us), dtype=bool)
        for i, (now, need) in enumerate(zip(us.tolist(), want.tolist())):
            tokens = min(tokens + int((now - last) / 1e6 * limit), 2 * limit)
            last = now
            have[i] = tokens
            granted[i] = tokens >= need
            if granted[i]:
                tokens -= need
        wait = np.where(granted, 0.0, (want - have) / float(limit))
        return (tokens, last), {"tokens": have, "granted": granted, "wait_seconds": wait}

    outputs = {"tokens": "bigint", "granted": "boolean", "wait_seconds": "double"}
    return fold(base, keys, order, step, outputs, segments).drop("_us")
