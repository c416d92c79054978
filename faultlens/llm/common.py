"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.session import scratch_dir

#: Everything but ASCII digits, ASCII lower-case letters and non-ASCII characters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared scratch folder and read back.

    Cuts the lineage: what comes later neither repeats the work nor depends on
    executors that may be lost.
    """
    spark = frame.sparkSession
    path = scratch_dir(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fresh_name(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores added until no column has it in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs started within send at most about so many bytes at a time to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null stays null."""
    plain = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    """Words of ASCII letters, digits and non-ASCII characters, in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NON_WORD), "")


def range_index(key: Column, splits: Sequence[int]) -> Column:
    """How many of the ascending ``splits`` are at most ``key``; 0 for a null key.

    Two levels of about sqrt(n) comparisons each instead of n.
    """
    splits = [int(s) for s in splits]
    if not splits:
        return F.lit(0)
    width = max(1, math.isqrt(len(splits)))
    groups = [splits[i : i + width] for i in range(0, len(splits), width)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    nested = F.array(*[F.array(*[F.lit(s).cast("long") for s in g]) for g in groups])
    group = F.size(F.filter(heads, lambda s: s <= key))
    within = F.size(F.filter(F.get(nested, group - 1), lambda s: s <= key))
    return F.when(key.isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * width + within)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def modest_batches(spark: SparkSession) -> None:
    """Sends at most 1,000 rows at a time to Python in this session, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def numbered(frame: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The frame, written once, with ``rank`` (from 0) and ``n`` (rows) within each ``group``.

    Rows are dealt by ranges of (group, order) and sorted within them; the rows that earlier
    ranges hold of a group are added to the place within the range. So no task sorts a
    group, however large it is. Equal rows share a range: ``order`` should end in a column
    that tells them apart. ``group`` must not be null.
    """
    ranges = frame.repartitionByRange(parallelism(frame.sparkSession), group, *order)
    placed = stored(ranges.sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    # At most one row for each group and one more for each range.
    runs = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {
            "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"),
            "n": F.sum("_rows").over(Window.partitionBy(group)),
        }
    ).drop("_first", "_rows")
    return placed.join(runs, [group, "_range"]).withColumn("rank", F.col("_at") + F.col("_before")).drop("_at", "_range", "_before")
