"""Error log lines grouped by message signature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import logtext, text

MAX_OTHER_GROUPS = 10


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with ``level, ts, message``; ``level`` is null when none is found.

    ``lines`` holds at least ``source_file, line_order, value``. The parsed fields come
    out of a generator, which keeps later filters on them from parsing the line again.
    """
    trimmed = lines.withColumn("value", text.trim(F.col("value"))).where(F.col("value") != "")
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("level", "ts", "message")])
    parsed = F.coalesce(logtext.parse_line(F.col("value")), none)
    return trimmed.select(*trimmed.columns, F.inline(F.array(parsed)))


def error_lines(lines: DataFrame) -> DataFrame:
    """Lines whose level counts as a problem, with signature and category."""
    message = F.col("message")
    return (
        parsed_lines(lines)
        .where(F.col("level").isin(*logtext.ERROR_LEVELS))
        .withColumn("signature", logtext.signature(message))
        .withColumn("category", logtext.category(message))
    )


def log_groups(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per signature: count, worst level, first/last time, first line's texts.

    The level of a group is the earliest one of its highest rank. Map-side partial
    aggregation shrinks a frequent signature to one row per task before the shuffle.
    """
    order = F.col("line_order")
    ts = F.nullif(F.col("ts"), F.lit(""))
    first = F.struct("message", "category")
    grouped = (
        error_lines(lines)
        .groupBy(*by, "signature")
        .agg(
            F.count("*").alias("count"),
            F.min_by(first, order).alias("_first"),
            F.min_by("level", F.struct(-logtext.level_rank(F.col("level")), order)).alias("level"),
            F.min(ts).alias("_from"),
            F.max(ts).alias("_to"),
        )
    )
    return grouped.select(
        *by,
        "signature",
        logtext.sample(F.col("_first.message")).alias("sample"),
        F.col("_first.category").alias("category"),
        "level",
        "count",
        F.coalesce("_from", F.lit("")).alias("first_seen"),
        F.coalesce("_to", F.lit("")).alias("last_seen"),
        logtext.cause(F.col("_first.message")).alias("cause"),
    )


def log_totals(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, non-blank lines and error lines.

    Lines are counted per file first, so no distinct count over all lines is needed.
    """
    is_error = F.coalesce(F.col("level").isin(*logtext.ERROR_LEVELS), F.lit(False))
    per_file = (
        parsed_lines(lines)
        .groupBy(*by, "source_file")
        .agg(F.count("*").alias("n"), F.count_if(is_error).alias("e"))
    )
    return per_file.groupBy(*by).agg(
        F.count("*").alias("files_parsed"),
        F.sum("n").alias("total_lines"),
        F.sum("e").alias("total_errors"),
    )


def log_levels(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return error_lines(lines).groupBy(*by, "level").agg(F.count("*").alias("n"))


def log_categories(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Error lines per category, each line under its own category."""
    return error_lines(lines).groupBy(*by, "category").agg(F.count("*").alias("n"))


def group_order() -> list[Column]:
    return [F.col("count").desc(), F.col("signature").asc()]


def most_common(groups: DataFrame, others: int = MAX_OTHER_GROUPS) -> DataFrame:
    """The most common issue and the next ``others``."""
    return groups.orderBy(*group_order()).limit(1 + others)
