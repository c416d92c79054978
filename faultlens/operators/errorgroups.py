"""Runtime error events grouped by type, file and line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RECENT = 15
MAX_CONSOLE_GROUPS = 10


def runtime_groups(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and the latest event's message and severity per error place.

    Among equal timestamps the later event (``event_order``) wins.
    """
    latest = F.max_by(
        F.struct("timestamp", "message", "severity"), F.struct("timestamp", "event_order")
    )
    grouped = events.groupBy(*by, "type", "file", "line").agg(
        F.count("*").alias("count"), latest.alias("_latest")
    )
    return grouped.select(
        *by,
        "type",
        "file",
        "line",
        "count",
        F.col("_latest.timestamp").alias("last_seen"),
        F.col("_latest.message").alias("last_message"),
        F.col("_latest.severity").alias("severity"),
    )


def group_order() -> list[Column]:
    """Count, then last seen; ties, undefined in a hash map, by place."""
    return [
        F.col("count").desc(),
        F.col("last_seen").desc(),
        F.col("type").asc(),
        F.col("file").asc(),
        F.col("line").asc(),
    ]


def top_groups(groups: DataFrame, n: int = MAX_CONSOLE_GROUPS) -> DataFrame:
    return groups.orderBy(*group_order()).limit(n)


def recent_events(events: DataFrame, n: int = MAX_RECENT) -> DataFrame:
    """Newest events first; among equal timestamps the earlier event first."""
    return events.orderBy(F.col("timestamp").desc(), F.col("event_order").asc()).limit(n)


def place() -> Column:
    """``file:line``, or the file alone without a line."""
    return F.when(
        F.col("line") > 0, F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))
    ).otherwise(F.col("file"))
