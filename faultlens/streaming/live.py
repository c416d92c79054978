"""Continuous versions of the log and runtime groupings.

Groups without an end (``runtime_groups``, ``log_groups``) are kept in a table of their own:
every micro-batch is grouped by itself and merged into the buckets of that table that it
touches (``maintain``). So the stream has no state that grows, and reading the current groups
costs the same after any number of batches. Windows of event time (``error_rate``) end: a
watermark closes them and drops what comes later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultlens.functions import logtext
from faultlens.operators.loggroups import error_lines
from faultlens.sources import buckets
from faultlens.sources.buckets import kept  # noqa: F401
from faultlens.sources.events import parse_events


def runtime_groups(lines: DataFrame) -> DataFrame:
    """Runtime groups of a stream of JSON lines.

    A stream has no file order, so equal timestamps are decided by the greater message.
    """
    events = parse_events(lines)
    latest = F.max_by(F.struct("message", "severity"), F.struct("timestamp", "message"))
    return (
        events.groupBy("type", "file", "line")
        .agg(F.count("*").alias("count"), F.max("timestamp").alias("last_seen"), latest.alias("_l"))
        .select(
            "type",
            "file",
            "line",
            "count",
            "last_seen",
            F.col("_l.message").alias("last_message"),
            F.col("_l.severity").alias("severity"),
        )
    )


def log_groups(lines: DataFrame) -> DataFrame:
    """Signature counts, worst level rank and first/last time of a stream of log lines."""
    ts = F.nullif(F.col("ts"), F.lit(""))
    return (
        error_lines(lines)
        .groupBy("signature")
        .agg(
            F.count("*").alias("count"),
            F.max(logtext.level_rank(F.col("level"))).alias("level_rank"),
            F.coalesce(F.min(ts), F.lit("")).alias("first_seen"),
            F.coalesce(F.max(ts), F.lit("")).alias("last_seen"),
        )
    )


def merged_runtime_groups(groups: DataFrame) -> DataFrame:
    """Rows of ``runtime_groups`` over parts of the events, added up to those of all."""
    latest = F.max_by(F.struct("last_message", "severity"), F.struct("last_seen", "last_message"))
    return (
        groups.groupBy("type", "file", "line")
        .agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"), latest.alias("_l"))
        .select("type", "file", "line", "count", "last_seen", "_l.last_message", "_l.severity")
    )


def merged_log_groups(groups: DataFrame) -> DataFrame:
    """Rows of ``log_groups`` over parts of the lines, added up to those of all."""
    first, last = (F.nullif(F.col(c), F.lit("")) for c in ("first_seen", "last_seen"))
    return groups.groupBy("signature").agg(
        F.sum("count").alias("count"),
        F.max("level_rank").alias("level_rank"),
        F.coalesce(F.min(first), F.lit("")).alias("first_seen"),
        F.coalesce(F.max(last), F.lit("")).alias("last_seen"),
    )


def error_rate(lines: DataFrame, event_time: Column, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Error lines per signature and tumbling window of event time, late data cut off."""
    timed = lines.withColumn("event_time", event_time).withWatermark("event_time", late)
    return (
        error_lines(timed)
        .groupBy(F.window("event_time", width), "signature")
        .agg(F.count("*").alias("count"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "signature",
            "count",
        )
    )


def maintain(stream: DataFrame, group, merge, keys: list[str], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``group`` of everything that a stream has brought in a table of hash buckets.

    ``group`` makes the groups of one batch, ``merge`` adds rows of the same groups up
    (``buckets.merge_batch``). A batch that is run again after a failure counts once.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        buckets.merge_batch(group(batch), merge, keys, out, batch_id)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(upsert)
        .start()
    )


def dropped_late(query: StreamingQuery) -> int:
    """Rows (of partial sums) behind the watermark that a query's last batches have dropped."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def start(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Start a job that writes each micro-batch's rows with its batch number.

    A batch that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def finished(spark: SparkSession, out: str) -> DataFrame:
    """All rows that a job in append mode has written: the windows that are closed."""
    return spark.read.parquet(out).drop("batch")
