"""Inventories, histories and contents derived from the given tables.

``Tables`` builds them with the DataFrame API; ``CTES`` states the same views in SQL, so a
query and its oracle share no code. The destination inventory is made to differ from the
source in every way a synchronisation must tell apart (missing, resized, older, newer, extra),
and the new contents from the old ones likewise (gone, edited, extended). Every view covers
its whole table; remainders of ids only decide which of these cases a row becomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



class Tables:
    """Source tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # what a Python worker holds at a time, however long texts are and however many a task has
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def src_inventory(self) -> DataFrame:
        key, price = F.col("o_orderkey"), F.col("o_totalprice")
        suffix = (
            F.when(key % 4 == 0, ".bin").when(key % 4 == 1, ".txt").when(key % 4 == 2, ".log").otherwise("")
        )
        factor = (
            F.when(key % 5 == 0, price / 500)
            .when(key % 5 == 1, price)
            .when(key % 5 == 2, price * 200)
            .when(key % 5 == 3, price * 2000)
            .otherwise(price * 20000)
        )
        return self.read("orders").select(
            key.alias("file_id"),
            F.concat(
                F.lit("p"),
                F.substring("o_orderpriority", 1, 1),
                F.lit("/"),
                "o_orderstatus",
                F.lit("/"),
                F.when(key % 97 == 0, ".").otherwise(""),
                F.lit("f"),
                key.cast("string"),
                suffix,
            ).alias("path"),
            F.floor(factor).cast("bigint").alias("size"),
            F.col("o_orderdate").alias("mtime"),
        )

    def dst_inventory(self) -> DataFrame:
        src = self.src_inventory()
        k, day = F.col("file_id") % 10, F.expr("INTERVAL '1' DAY")
        kept = src.where(k != 0).select(
            "file_id",
            "path",
            F.when(k.isin(1, 4), F.col("size") + 1).otherwise(F.col("size")).alias("size"),
            F.when(k == 2, F.col("mtime") - day)
            .when(k.isin(3, 4), F.col("mtime") + day)
            .otherwise(F.col("mtime"))
            .alias("mtime"),
        )
        extra = src.where(F.col("file_id") % 50 == 0).withColumn("path", F.concat(F.lit("extra/"), "path"))
        return kept.unionByName(extra)

    def history(self) -> DataFrame:
        lines = (
            self.read("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.count("*").alias("n"),
                F.count_if(F.col("l_returnflag") == "R").alias("failed"),
                F.sum(F.floor(F.col("l_extendedprice") * 1000).cast("bigint")).alias("bytes"),
            )
        )
        seconds = F.col("n") * F.lit(60.0)
        return (
            self.read("orders")
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(
                F.col("o_orderkey").alias("id"),
                F.concat(F.lit("/src/"), (F.col("o_custkey") % 20).cast("string")).alias("source"),
                F.concat(F.lit("/dst/"), (F.col("o_custkey") % 7).cast("string")).alias("destination"),
                F.col("o_orderdate").alias("started_at"),
                F.expr("o_orderdate + make_dt_interval(0, 0, 0, cast(n * 60 as decimal(18,6)))").alias("ended_at"),
                seconds.alias("duration_seconds"),
                F.col("n").alias("total_files"),
                (F.col("n") - F.col("failed")).alias("files_transferred"),
                F.col("failed").alias("files_failed"),
                F.col("bytes").alias("bytes_transferred"),
                (F.col("bytes") / seconds).alias("avg_throughput"),
                ((F.col("n") - F.col("failed")) / seconds).alias("files_per_second"),
                F.when(F.col("failed") == 0, "success")
                .when(F.col("failed") < F.col("n"), "partialsuccess")
                .when(F.col("o_orderkey") % 2 == 0, "failed")
                .otherwise("cancelled")
                .alias("status"),
                (F.col("o_orderkey") % 16 + 1).alias("threads"),
                (F.col("o_orderkey") % 2 == 0).alias("verify"),
            )
        )

    def content(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").alias("file_id"),
            F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
            "text",
        )

    def content_new(self) -> DataFrame:
        k, text = F.col("file_id"), F.col("text")
        edited = (
            F.when((k % 5 == 0) & (F.length(text) > 300), F.expr("concat(substr(text,1,260), '#', substr(text,262))"))
            .when(k % 5 == 1, F.concat(text, F.lit(" appended")))
            .when(k % 5 == 2, F.when(k % 3 == 0, "").otherwise(text))
            .otherwise(text)
        )
        return self.content().where(k % 7 != 0).withColumn("text", edited)

    def transfer_events(self) -> DataFrame:
        return self.read("events").select(
            "event_id",
            "ts",
            F.col("user_id").alias("job_id"),
            F.col("event_type").alias("state"),
            F.floor(F.col("value") * 1000000).cast("bigint").alias("bytes"),
        )

    def manifest(self) -> DataFrame:
        """Last-run manifest of the estate: the destination listing in whole seconds."""
        return self.dst_inventory().select("path", "size", F.unix_seconds(F.col("mtime").cast("timestamp")).alias("mtime"))

    def mode_bits(self) -> DataFrame:
        """Unix modes spread over all twelve bits, from part sizes and prices."""
        return self.read("part").select(
            F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string")).alias("path"),
            ((F.col("p_partkey") * 37 + F.col("p_size") * 511) % 4096).alias("permissions"),
        )

    def objects(self) -> DataFrame:
        """Object listing below the prefix ``backup``, in whole seconds."""
        return self.dst_inventory().select(
            F.concat(F.lit("backup/"), "path").alias("key"),
            "size",
            F.unix_seconds(F.col("mtime").cast("timestamp")).alias("last_modified"),
        )

    def resume_states(self) -> DataFrame:
        """One row per (transfer, file): orders as transfers, their lines as files."""
        status = (
            F.when(F.col("l_returnflag") == "R", "failed")
            .when(F.col("l_linestatus") == "F", "complete")
            .when(F.col("l_quantity") > 25, "partial")
            .when(F.col("l_quantity") > 12, "pending")
            .otherwise("skipped")
        )
        lines = self.read("lineitem").select(
            F.col("l_orderkey").alias("transfer_id"),
            F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"),
            F.floor(F.col("l_extendedprice") * 100).cast("bigint").alias("size"),
            status.alias("file_status"),
        )
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("transfer_id"),
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("last_checkpoint"),
            F.expr(
                "CASE o_orderkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'failed' "
                "WHEN 3 THEN 'in_progress' ELSE 'interrupted' END"
            ).alias("status"),
        )
        written = (
            F.when(F.col("file_status").isin("complete", "skipped"), F.col("size"))
            .when(F.col("file_status") == "partial", F.expr("size div 2"))
            .otherwise(F.lit(0))
        )
        return lines.withColumn("bytes_written", written.cast("bigint")).join(orders, "transfer_id")

    def copy_results(self) -> DataFrame:
        """Per-file outcome of a run: returned lines failed, the others went through."""
        failed = F.col("l_returnflag") == "R"
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("job_id"),
            F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"),
            F.when(failed, "failed").when(F.col("l_linestatus") == "F", "copied").otherwise("skipped").alias("status"),
            F.when(failed | (F.col("l_linestatus") != "F"), 0)
            .otherwise(F.floor(F.col("l_extendedprice") * 100))
            .cast("bigint")
            .alias("bytes"),
            F.when(failed, F.concat(F.lit("tax "), F.floor(F.col("l_tax") * 100).cast("int").cast("string"))).alias("error"),
        )

    def jobs(self) -> DataFrame:
        """Transfer jobs with status and totals."""
        h = self.history().select(F.col("id"), "bytes_transferred", "files_transferred", "status")
        status = (
            F.when(F.col("o_orderstatus") == "O", "running")
            .when(F.col("o_orderstatus") == "P", "pending")
            .when(F.col("status") == "success", "completed")
            .otherwise("failed")
        )
        return (
            self.read("orders")
            .select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_orderdate").alias("created_at"))
            .join(h, "id")
            .select("id", status.alias("status"), "created_at", "bytes_transferred", "files_transferred")
        )

    def agents(self) -> DataFrame:
        """Agents and their last heartbeat: the last event of every user."""
        last = self.transfer_events().groupBy("job_id").agg(
            F.max("ts").alias("last_heartbeat"), F.max_by("state", F.struct("ts", "event_id")).alias("state")
        )
        status = (
            F.when(F.col("state") == "view", "connected")
            .when(F.col("state") == "click", "busy")
            .when(F.col("state") == "error", "error")
            .otherwise("disconnected")
        )
        return last.select(F.col("job_id").alias("agent_id"), status.alias("status"), "last_heartbeat")

    def accounting(self) -> DataFrame:
        """Raw cluster accounting text built from orders."""
        k, p = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
        text = F.col("o_orderkey").cast("string")
        return self.read("orders").select(
            k.alias("job_id"),
            F.when(k % 4 == 0, F.concat((p % 64).cast("string"), F.lit("G")))
            .when(k % 4 == 1, F.concat(p.cast("string"), F.lit("m")))
            .when(k % 4 == 2, F.concat(p.cast("string"), F.lit(" K")))
            .otherwise(p.cast("string"))
            .alias("memory"),
            F.when(k % 3 == 0, F.concat((k % 9).cast("string"), F.lit("-"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((p % 60).cast("string"), 2, "0"), F.lit(":07")))
            .when(k % 3 == 1, F.concat((k % 30).cast("string"), F.lit(":"), (p % 60).cast("string")))
            .otherwise(F.col("o_orderpriority"))
            .alias("time_limit"),
            F.when(k % 2 == 0, F.concat(F.lit("node["), F.lpad((k % 8 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 8 + k % 5).cast("string"), 2, "0"), F.lit("]")))
            .otherwise(F.concat(F.lit("n"), text, F.lit(", m"), text))
            .alias("node_list"),
            F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey % 7 as int) END").alias("num_tasks"),
            F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_orderkey % 5 as int) END").alias("cpus_per_task"),
        )

    def zero_blocks(self) -> DataFrame:
        """Blocks of ``content`` with two out of three blanked: sparse files."""
        from quayside.operators.content import split_blocks

        blocks = split_blocks(self.content(), "text", 256, keep=["file_id", "path"])
        return blocks.withColumn(
            "data",
            F.when(F.col("block_index") % 3 > 0, F.repeat(F.lit("\0"), F.col("size").cast("int")).cast("binary")).otherwise(F.col("data")),
        )

    def listing_text(self) -> DataFrame:
        """Lines of a text object listing; every directory has a short line of its own."""
        src = self.src_inventory()
        line = F.concat(
            F.date_format("mtime", "yyyy/MM/dd HH:mm:ss"), F.lit("   "), F.col("size").cast("string"), F.lit(" s3://bucket/"), "path"
        )
        dirs = src.select(F.concat(F.lit("DIR  s3://bucket/"), F.regexp_replace("path", "[^/]*$", "")).alias("value")).distinct()
        return src.select(line.alias("value")).unionByName(dirs)


#: The same views for the oracle engine.
CTES = {
    "src_inventory": """SELECT o_orderkey AS file_id,
  concat('p', substr(o_orderpriority,1,1), '/', o_orderstatus, '/',
    CASE WHEN o_orderkey % 97 = 0 THEN '.' ELSE '' END, 'f', CAST(o_orderkey AS VARCHAR),
    CASE o_orderkey % 4 WHEN 0 THEN '.bin' WHEN 1 THEN '.txt' WHEN 2 THEN '.log' ELSE '' END) AS path,
  CASE o_orderkey % 5
    WHEN 0 THEN CAST(floor(o_totalprice / 500) AS BIGINT)
    WHEN 1 THEN CAST(floor(o_totalprice) AS BIGINT)
    WHEN 2 THEN CAST(floor(o_totalprice * 200) AS BIGINT)
    WHEN 3 THEN CAST(floor(o_totalprice * 2000) AS BIGINT)
    ELSE CAST(floor(o_totalprice * 20000) AS BIGINT) END AS size,
  o_orderdate AS mtime FROM orders""",
    "dst_inventory": """SELECT file_id, path,
  CASE WHEN file_id % 10 IN (1, 4) THEN size + 1 ELSE size END AS size,
  CASE WHEN file_id % 10 = 2 THEN mtime - INTERVAL 1 DAY
       WHEN file_id % 10 IN (3, 4) THEN mtime + INTERVAL 1 DAY ELSE mtime END AS mtime
FROM src_inventory WHERE file_id % 10 <> 0
UNION ALL
SELECT file_id, concat('extra/', path) AS path, size, mtime FROM src_inventory WHERE file_id % 50 = 0""",
    "history": """SELECT o.o_orderkey AS id,
  concat('/src/', CAST(o.o_custkey % 20 AS VARCHAR)) AS source,
  concat('/dst/', CAST(o.o_custkey % 7 AS VARCHAR)) AS destination,
  o.o_orderdate AS started_at,
  o.o_orderdate + l.n * INTERVAL 60 SECOND AS ended_at,
  CAST(l.n * 60 AS DOUBLE) AS duration_seconds,
  l.n AS total_files, l.n - l.failed AS files_transferred, l.failed AS files_failed,
  l.bytes AS bytes_transferred, l.bytes / (l.n * 60)::DOUBLE AS avg_throughput,
  (l.n - l.failed) / (l.n * 60)::DOUBLE AS files_per_second,
  CASE WHEN l.failed = 0 THEN 'success' WHEN l.failed < l.n THEN 'partialsuccess'
       WHEN o.o_orderkey % 2 = 0 THEN 'failed' ELSE 'cancelled' END AS status,
  o.o_orderkey % 16 + 1 AS threads, o.o_orderkey % 2 = 0 AS verify
FROM orders o JOIN (
  SELECT l_orderkey, count(*) AS n,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
    CAST(sum(CAST(floor(l_extendedprice * 1000) AS BIGINT)) AS BIGINT) AS bytes
  FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    "content": """SELECT doc_id AS file_id, concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR), '.txt') AS path,
  text FROM documents""",
    "content_new": """SELECT file_id, path, CASE WHEN file_id % 5 = 0 AND length(text) > 300
    THEN concat(substr(text,1,260), '#', substr(text,262))
  WHEN file_id % 5 = 1 THEN concat(text, ' appended') WHEN file_id % 15 = 12 THEN '' ELSE text END AS text
FROM content WHERE file_id % 7 <> 0""",
    "blocks": """SELECT file_id, path, i AS block_index, i * 256 AS "offset", unhex(substr(h, i * 512 + 1, 512)) AS data,
  substr(h, i * 512 + 1, 512) AS h, length(substr(h, i * 512 + 1, 512)) // 2 AS size
FROM (SELECT file_id, path, h, unnest(range((length(h) + 511) // 512)) AS i
  FROM (SELECT file_id, path, hex(encode(text)) AS h FROM content) u) t""",
    "blocks_new": """SELECT file_id, path, i AS block_index, i * 256 AS "offset", unhex(substr(h, i * 512 + 1, 512)) AS data,
  substr(h, i * 512 + 1, 512) AS h, length(substr(h, i * 512 + 1, 512)) // 2 AS size
FROM (SELECT file_id, path, h, unnest(range((length(h) + 511) // 512)) AS i
  FROM (SELECT file_id, path, hex(encode(text)) AS h FROM content_new) u) t""",
    "transfer_events": """SELECT event_id, ts, user_id AS job_id, event_type AS state,
  CAST(floor(value * 1000000) AS BIGINT) AS bytes FROM events""",
    "manifest": "SELECT path, size, CAST(floor(epoch(mtime)) AS BIGINT) AS mtime FROM dst_inventory",
    "mode_bits": """SELECT concat('/parts/', CAST(p_partkey AS VARCHAR)) AS path,
  (p_partkey * 37 + p_size * 511) % 4096 AS permissions FROM part""",
    "objects": """SELECT concat('backup/', path) AS key, size,
  CAST(floor(epoch(mtime)) AS BIGINT) AS last_modified FROM dst_inventory""",
    "resume_states": """SELECT l.*, CASE WHEN file_status IN ('complete', 'skipped') THEN size
    WHEN file_status = 'partial' THEN size // 2 ELSE 0 END AS bytes_written,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS last_checkpoint,
  CASE o_orderkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'failed'
    WHEN 3 THEN 'in_progress' ELSE 'interrupted' END AS status
FROM (SELECT l_orderkey AS transfer_id, concat_ws('/', l_suppkey, l_partkey, l_linenumber) AS path,
    CAST(floor(l_extendedprice * 100) AS BIGINT) AS size,
    CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'complete'
      WHEN l_quantity > 25 THEN 'partial' WHEN l_quantity > 12 THEN 'pending' ELSE 'skipped' END AS file_status
  FROM lineitem) l JOIN orders ON o_orderkey = transfer_id""",
    "copy_results": """SELECT l_suppkey AS job_id, concat_ws('/', l_orderkey, l_partkey, l_linenumber) AS path,
  CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'copied' ELSE 'skipped' END AS status,
  CASE WHEN l_returnflag = 'R' OR l_linestatus <> 'F' THEN 0
    ELSE CAST(floor(l_extendedprice * 100) AS BIGINT) END AS bytes,
  CASE WHEN l_returnflag = 'R' THEN concat('tax ', CAST(CAST(floor(l_tax * 100) AS INT) AS VARCHAR)) END AS error
FROM lineitem""",
    "jobs": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending'
    ELSE CASE WHEN h.status = 'success' THEN 'completed' ELSE 'failed' END END AS status,
  o_orderdate AS created_at, bytes_transferred, files_transferred
FROM orders JOIN history h ON o_orderkey = h.id""",
    "agents": """SELECT job_id AS agent_id, CASE arg_max(state, (ts, event_id)) WHEN 'view' THEN 'connected'
    WHEN 'click' THEN 'busy' WHEN 'error' THEN 'error' ELSE 'disconnected' END AS status,
  max(ts) AS last_heartbeat FROM transfer_events GROUP BY job_id""",
    "accounting": """SELECT o_orderkey AS job_id,
  CASE o_orderkey % 4 WHEN 0 THEN concat(p % 64, 'G') WHEN 1 THEN concat(p, 'm')
    WHEN 2 THEN concat(p, ' K') ELSE CAST(p AS VARCHAR) END AS memory,
  CASE o_orderkey % 3 WHEN 0 THEN concat(o_orderkey % 9, '-', lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), ':',
      lpad(CAST(p % 60 AS VARCHAR), 2, '0'), ':07')
    WHEN 1 THEN concat(o_orderkey % 30, ':', p % 60) ELSE o_orderpriority END AS time_limit,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('node[', lpad(CAST(o_orderkey % 8 + 1 AS VARCHAR), 2, '0'), '-',
      lpad(CAST(o_orderkey % 8 + o_orderkey % 5 AS VARCHAR), 2, '0'), ']')
    ELSE concat('n', o_orderkey, ', m', o_orderkey) END AS node_list,
  nullif(o_orderkey % 7, 0)::INT AS num_tasks, nullif(o_orderkey % 5, 0)::INT AS cpus_per_task
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) o""",
    "zero_blocks": """SELECT file_id, path, block_index, "offset", size,
  CASE WHEN block_index % 3 > 0 THEN repeat('00', size::INT) ELSE h END AS h FROM blocks""",
    "listing_text": """SELECT concat(strftime(mtime, '%Y/%m/%d %H:%M:%S'), '   ', size, ' s3://bucket/', path) AS value FROM src_inventory
UNION ALL
SELECT DISTINCT concat('DIR  s3://bucket/', regexp_replace(path, '[^/]*$', '')) FROM src_inventory""",
}

#: Which views a view reads, in the order they must be stated.
NEEDS = {
    "dst_inventory": ["src_inventory"],
    "content_new": ["content"],
    "blocks": ["content"],
    "blocks_new": ["content_new"],
    "manifest": ["dst_inventory"],
    "objects": ["dst_inventory"],
    "jobs": ["history"],
    "agents": ["transfer_events"],
    "zero_blocks": ["blocks"],
    "listing_text": ["src_inventory"],
}


def oracle(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` below the WITH clause that defines ``views`` (and what those need)."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        visit(view)
    ctes = [f"{name} AS ({CTES[name]})" for name in ordered]
    ctes += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(ctes)}\n{body}" if ctes else body
