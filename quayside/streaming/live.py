"""Streaming forms of the transfer operators.

Every function takes and returns a streaming DataFrame (or wires a sink) and has a batch twin
in :mod:`quayside.operators.transfers` or :mod:`quayside.plans.bandwidth`. Event time needs a
``timestamp`` column. How much one micro-batch holds is set at the source
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``); stateful operators hold one small state per
key and see a key's rows of one micro-batch at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from quayside.functions.rates import eta_seconds, percent, ratio
from quayside.operators.history import detect_anomalies
from quayside.operators.transfers import INITIAL_FILES, next_size
from quayside.plans.bandwidth import Schedule, apply_schedule
from quayside.session import shared_dir
from quayside.streaming.arrivals import Arrivals

#: Rows of a key that are worked out and sent on at a time.
SLICE = 20_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State store for the stateful processors: state lives off-heap and on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sinks


PARTITIONS = "spark.sql.shuffle.partitions"


def write_batches(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    mode: str = "append",
    trigger: dict | None = None,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Writes every micro-batch to its own folder of a Parquet table.

    A batch that is run again after a failure overwrites its own folder, so the table holds
    each batch once. :func:`latest` reads the newest row per key of update-mode results.
    ``state_partitions`` is kept by the checkpoint for the life of the query; without it the
    session's shuffle partitions count.
    """
    conf = stream.sparkSession.conf
    usual = conf.get(PARTITIONS)

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(save)
    try:
        # a query takes the settings of the moment it is started
        conf.set(PARTITIONS, str(state_partitions or usual))
        return writer.start()
    finally:
        conf.set(PARTITIONS, usual)


def run_now(stream: DataFrame, mode: str = "append", name: str = "stream", state_partitions: int | None = None) -> DataFrame:
    """Runs the stream over what its source holds now and returns all batches (column batch)."""
    spark = stream.sparkSession
    table = new_folder(spark, name)
    checkpoint = new_folder(spark, f"{name}-checkpoint")
    query = write_batches(stream, table, checkpoint, mode, state_partitions=state_partitions)
    query.awaitTermination()
    fields = StructType(stream.schema.fields).add("batch", IntegerType())
    return spark.read.schema(fields).option("basePath", table).parquet(table)


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key of an update-mode table."""
    rest = [c for c in batches.columns if c not in (*keys, "batch")]
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")


def last_batch(batches: DataFrame) -> DataFrame:
    """The result as of the last batch of a complete-mode table."""
    newest = batches.agg(F.max("batch").alias("batch"))
    return batches.join(F.broadcast(newest), "batch").drop("batch")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows dropped as later than the watermark, over the progress reports still kept."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


# ---------------------------------------------------------------- inventories


def stream_inventory(spark: SparkSession, directory: str, levels: int = 2, settle: float = 0.05) -> DataFrame:
    """Arriving and changed files as inventory rows (path below the root, size, mtime), hidden ones included. Their
    content is not read, and no list of them is kept; see :mod:`quayside.streaming.arrivals`."""
    spark.dataSource.register(Arrivals)
    found = spark.readStream.format("arrivals").option("root", directory).option("levels", levels).option("settle", settle).load()
    return found.select("path", "size", "mtime")


def current_manifest(batches: DataFrame) -> DataFrame:
    """Manifest state of an inventory stream: the newest row per path. The table only grows by
    appends, so keeping it up to date never rewrites it."""
    return latest(batches, ["path"])


# ---------------------------------------------------------------- progress


def stream_progress(events: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per job: bytes, files, throughput and, with ``totals`` (job_id, total_bytes), percent and ETA.

    For update mode. Sums are combined before the shuffle.
    """
    us = F.unix_micros("ts")
    sums = events.groupBy("job_id").agg(
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("files"),
        ((F.max(us) - F.min(us)) / 1e6).alias("elapsed"),
    )
    out = sums.withColumn("throughput", ratio("bytes", "elapsed"))
    if totals is None:
        return out
    known = out.join(totals, "job_id", "left")
    return known.select(
        *out.columns,
        "total_bytes",
        percent("bytes", "total_bytes").alias("percent"),
        eta_seconds("bytes", "total_bytes", "throughput").alias("eta_seconds"),
    )


def partial_sums(events: DataFrame, bucket_ms: int) -> DataFrame:
    """(job_id, ts, bytes, files, first_us, last_us): events summed up per job and time bucket before any shuffle, Arrow batch
    by Arrow batch, so that a busy job sends a few rows. ``ts`` is that of a bucket's last event."""
    kind = events.schema["job_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            bucket = pc.floor(pc.divide(table["us"].cast(pa.float64()), 1000.0 * bucket_ms)).cast(pa.int64())
            sums = table.append_column("bucket", bucket).group_by(["job_id", "bucket"]).aggregate(
                [("bytes", "sum"), ("us", "count"), ("us", "min"), ("us", "max")]
            )
            columns = [sums["job_id"], sums["us_max"].cast(pa.timestamp("us", "UTC")), sums["bytes_sum"], sums["us_count"], sums["us_min"], sums["us_max"]]
            names = ["job_id", "ts", "bytes", "files", "first_us", "last_us"]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()

    narrow = events.select("job_id", F.unix_micros("ts").alias("us"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes")).where("us IS NOT NULL")
    return narrow.mapInArrow(run, f"job_id {kind}, ts timestamp, bytes bigint, files bigint, first_us bigint, last_us bigint")


class _Progress(StatefulProcessor):
    """Sums of a job while it goes on; a last row, and no state, once it was idle for long enough."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "bytes bigint, files bigint, first_us bigint, last_us bigint")

    def _row(self, key, sums, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "bytes": [sums[0]], "files": [sums[1]], "first_us": [sums[2]], "last_us": [sums[3]], "ended": [ended]})

    def handleInputRows(self, key, rows, timerValues):
        before = self.sums.get() if self.sums.exists() else None
        now = before
        for pdf in rows:
            new = (int(pdf["bytes"].sum()), int(pdf["files"].sum()), int(pdf["first_us"].min()), int(pdf["last_us"].max()))
            now = new if now is None else (now[0] + new[0], now[1] + new[1], min(now[2], new[2]), max(now[3], new[3]))
        if before is None or now[3] != before[3]:
            if before is not None:
                self.handle.deleteTimer(before[3] // 1000 + self.idle_ms)
            self.handle.registerTimer(now[3] // 1000 + self.idle_ms)
        self.sums.update(now)
        yield self._row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.sums.exists():
            yield self._row(key, self.sums.get(), True)
            self.sums.clear()

    def close(self) -> None:
        pass


def stream_job_progress(events: DataFrame, idle_seconds: int, late: str = "10 minutes", totals: DataFrame | None = None) -> DataFrame:
    """Per job: bytes, files, elapsed, throughput and whether it has ended; a row after each batch with news, and a last one
    with ``ended`` once the watermark is ``idle_seconds`` past the job's last event. Then its state goes.

    Events later than ``late`` are dropped (see :func:`dropped_rows`). News in the very batch that would have ended a job keep it
    going; an event that comes after the end and is not that late begins a new count of the job."""
    use_rocksdb(events.sparkSession)
    kind = events.schema["job_id"].dataType.simpleString()
    sums = partial_sums(events, 60_000).withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Progress(idle_seconds * 1000),
        outputStructType=f"job_id {kind}, bytes bigint, files bigint, first_us bigint, last_us bigint, ended boolean",
        outputMode="append",
        timeMode="eventTime",
    )
    elapsed = ((F.col("last_us") - F.col("first_us")) / 1e6).alias("elapsed")
    out = sums.select("job_id", "bytes", "files", elapsed, "ended").withColumn("throughput", ratio("bytes", "elapsed"))
    if totals is None:
        return out
    return out.join(totals, "job_id", "left").select(
        *out.columns, "total_bytes", percent("bytes", "total_bytes").alias("percent"), eta_seconds("bytes", "total_bytes", "throughput").alias("eta_seconds")
    )


def stream_throughput(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and bytes per window of event time. In append mode a window is emitted once the
    watermark has passed it; rows later than ``late`` are dropped (see :func:`dropped_rows`)."""
    window = F.window("ts", width, slide)
    sums = events.withWatermark("ts", late).groupBy(window.alias("w")).agg(
        F.count("*").alias("events"), F.sum("bytes").alias("bytes")
    )
    return sums.select(F.unix_seconds("w.start").alias("start"), "events", "bytes")


def stream_sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Stretches of activity per job between idle gaps; append or complete mode."""
    window = F.session_window("ts", gap)
    sums = events.withWatermark("ts", late).groupBy("job_id", window.alias("w")).agg(
        F.count("*").alias("events"), F.sum("bytes").alias("bytes")
    )
    return sums.select(
        "job_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events", "bytes"
    )


def stream_closed_sessions(events: DataFrame, gap_seconds: int, late: str = "10 minutes", buckets: int = 4) -> DataFrame:
    """Stretches of activity per job between idle gaps, each once it is over; append mode.

    A session is over when the watermark is a gap and a bucket (a fraction of the gap) past its last event; the watermark stays behind by ``late`` and
    that bucket. Sessions are Spark's own: rows of a job become sessions before the shuffle, so that a busy job sends a few rows, and state is
    a row per session that can still grow. An event is dropped when a session of its own would be over. Spark's windows also join what only touches, so
    they end a microsecond before the gap does: events a gap apart are two sessions, and one is over that microsecond early."""
    spark = events.sparkSession
    use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    width = max(1, gap_seconds * 1_000_000 // buckets)
    window = F.session_window("ts", f"{gap_seconds * 1_000_000 - 1} microseconds")
    sums = events.withWatermark("ts", f"{late} {width} microseconds").groupBy("job_id", window.alias("w")).agg(
        F.count("*").alias("events"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )
    return sums.select("job_id", F.unix_micros("w.start").alias("start_us"), (F.unix_micros("w.end") + 1).alias("end_us"), "events", "bytes")


def stream_compliance(events: DataFrame, schedule: Schedule, late: str = "10 minutes") -> DataFrame:
    """Bytes per minute against the limit in force in that minute."""
    window = F.window("ts", "1 minute")
    sums = events.withWatermark("ts", late).groupBy(window.alias("w")).agg(F.sum("bytes").alias("bytes"))
    ruled = apply_schedule(sums.select(F.col("w.start").alias("minute"), "bytes"), schedule, "minute")
    exceeded = (F.col("limit") > 0) & (F.col("bytes") > F.col("limit") * 60)
    return ruled.select(F.unix_seconds("minute").alias("minute"), "bytes", "rule", "limit", exceeded.alias("exceeded"))


# ---------------------------------------------------------------- stateful processors


class _Ordered(StatefulProcessor):
    """A processor that takes a key's rows of one micro-batch in order of ``order``."""

    order: list[str] = []

    def ordered(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows), ignore_index=True).sort_values(self.order, ignore_index=True)

    def close(self) -> None:
        pass


class _Adaptive(_Ordered):
    order = ["event_id"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sizer", "ema double, size bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = self.ordered(rows)
        ema, size = self.state.get() if self.state.exists() else (0.0, INITIAL_FILES)
        emas, sizes = [], []
        for files, seconds in zip(pdf["files"].tolist(), pdf["seconds"].tolist()):
            ema, size = next_size(ema, size, files, seconds)
            emas.append(ema)
            sizes.append(size)
        self.state.update((ema, size))
        yield pd.DataFrame(
            {"job_id": key[0], "event_id": pdf["event_id"], "ema_throughput": emas, "batch_files": sizes}
        )


def stream_adaptive(reports: DataFrame) -> DataFrame:
    """Batch size and smoothed throughput after each report (job_id, event_id, files, seconds)."""
    use_rocksdb(reports.sparkSession)
    return reports.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Adaptive(),
        outputStructType="job_id bigint, event_id bigint, ema_throughput double, batch_files bigint",
        outputMode="append",
        timeMode="none",
    )


class _Bucket(_Ordered):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues):
        # three numbers a request are all that is held of a key's micro-batch; results leave by slices
        parts = [pdf[["us", "event_id", "bytes"]].to_numpy(dtype="int64") for pdf in rows]
        numbers = np.concatenate(parts)
        del parts
        order = np.lexsort((numbers[:, 1], numbers[:, 0]))
        tokens, last = self.state.get() if self.state.exists() else (self.limit, int(numbers[order[0], 0]))
        for at in range(0, len(order), SLICE):
            us, ids, want = numbers[order[at : at + SLICE]].T
            have, granted = [], []
            for now, need in zip(us.tolist(), want.tolist()):
                tokens, last = min(tokens + int((now - last) / 1e6 * self.limit), 2 * self.limit), now
                have.append(tokens)
                granted.append(tokens >= need)
                tokens -= need if tokens >= need else 0
            wait = [0.0 if ok else (need - h) / self.limit for ok, need, h in zip(granted, want.tolist(), have)]
            yield pd.DataFrame({"key": key[0], "event_id": ids, "tokens": have, "granted": granted, "wait_seconds": wait})
        self.state.update((tokens, last))


def stream_limiter(requests: DataFrame, key: str, limit: int) -> DataFrame:
    """Token bucket per key over (key, us, event_id, bytes)."""
    use_rocksdb(requests.sparkSession)
    key_type = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Bucket(limit),
        outputStructType=f"key {key_type}, event_id bigint, tokens bigint, granted boolean, wait_seconds double",
        outputMode="append",
        timeMode="none",
    )


class _Liveness(StatefulProcessor):
    def __init__(self, stale_after: int):
        self.stale_ms = stale_after * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues):
        newest = max(int(pdf["us"].max()) for pdf in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.stale_ms)
            self.last.update((newest,))
            due = newest // 1000 + self.stale_ms
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
        newest = newest if before is None else max(newest, before)
        stale = newest // 1000 + self.stale_ms <= timerValues.getCurrentWatermarkInMs()
        yield pd.DataFrame({"agent_id": [key[0]], "last_us": [newest], "stale": [stale]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            yield pd.DataFrame({"agent_id": [key[0]], "last_us": [self.last.get()[0]], "stale": [True]})

    def close(self) -> None:
        pass


def stream_liveness(heartbeats: DataFrame, stale_after: int, late: str = "10 minutes") -> DataFrame:
    """Last heartbeat per agent after every batch that has news of it, and a ``stale`` row once
    the watermark is ``stale_after`` seconds past the last one. heartbeats: (agent_id, ts)."""
    use_rocksdb(heartbeats.sparkSession)
    marked = heartbeats.withWatermark("ts", late).select("agent_id", "ts", F.unix_micros("ts").alias("us"))
    return marked.groupBy("agent_id").transformWithStateInPandas(
        statefulProcessor=_Liveness(stale_after),
        outputStructType="agent_id bigint, last_us bigint, stale boolean",
        outputMode="append",
        timeMode="eventTime",
    )


# ---------------------------------------------------------------- history


def stream_history(
    entries: DataFrame,
    store: str,
    checkpoint: str,
    by: list[str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Appends finished transfers to ``store/entries`` and the anomalies among them, judged
    against the entries stored so far, to ``store/anomalies``; both once per batch.

    What was stored before is known by ``store/stats``, a row per group and batch with count, mean and sum of
    squares about it, so a batch reads its own entries and that small table only."""

    groups = by or []

    def save(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{store}/entries/batch={batch}")
        new = spark.read.schema(df.schema).parquet(f"{store}/entries/batch={batch}")
        rate = F.col("avg_throughput")
        own = new.groupBy(*groups).agg(
            F.count(rate).alias("k"), F.count("*").alias("n"), F.avg(rate).alias("mean"), (F.var_pop(rate) * F.count(rate)).alias("m2")
        )
        own.write.mode("overwrite").parquet(f"{store}/stats/batch={batch}")
        # later batches do not exist yet, and a repeated batch has overwritten itself
        every = spark.read.option("basePath", f"{store}/stats").parquet(f"{store}/stats").where(F.col("k") > 0)
        sums = every.groupBy(*groups).agg(
            F.sum("n").alias("_n"), F.sum("k").alias("_k"), (F.sum(F.col("mean") * F.col("k")) / F.sum("k")).alias("_avg"),
            F.sum(F.col("m2") + F.col("k") * F.col("mean") * F.col("mean")).alias("_squares"),
        )
        spread = F.greatest(F.lit(0.0), F.col("_squares") / F.col("_k") - F.col("_avg") * F.col("_avg"))
        stats = sums.select(*groups, "_n", "_avg", F.sqrt(spread).alias("_std"))
        detect_anomalies(new, by, stats).write.mode("overwrite").parquet(f"{store}/anomalies/batch={batch}")

    writer = entries.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
