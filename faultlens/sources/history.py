"""The scan history table and what is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.operators import technology
from faultlens.operators.windows import first_n
from faultlens.schemas import SCAN_RECORD
from faultlens.sources import buckets


def scan_records(summary: DataFrame, languages: DataFrame, tech: DataFrame, scans: DataFrame) -> DataFrame:
    """One record per project from its summary, language and stack.

    ``scans(project, id, path, created_at, duration_ms)`` names the scan itself.
    """
    stack = technology.stack_names(tech, ("framework", "database"))
    none = F.array().cast("array<string>")
    joined = (
        scans.join(summary, "project", "left")
        .join(languages, "project", "left")
        .join(stack, "project", "left")
        .withColumn("stack", F.coalesce("names", none))
        .withColumn("language", F.coalesce("language", F.lit("Unknown")))
        .withColumn("new_since", F.lit(0).cast("long"))
    )
    return joined.select(*[F.col(f.name).cast(f.dataType) for f in SCAN_RECORD.fields])


def with_new_since(records: DataFrame, history: DataFrame) -> DataFrame:
    """Fill ``new_since`` against the newest earlier record of the same path."""
    previous = history.groupBy("path").agg(
        F.max_by("total", F.struct("created_at", "id")).alias("_previous")
    )
    grown = F.greatest(F.col("total") - F.col("_previous"), F.lit(0))
    return (
        records.join(previous, "path", "left")
        .withColumn("new_since", F.coalesce(grown, F.lit(0)).cast("long"))
        .select(*records.columns)
    )


#: Files that one append writes for a month, at most.
FILES_PER_MONTH = 8


def append_records(records: DataFrame, path: str) -> None:
    """Add records to the history, one folder per month; scans of a path lie together."""
    dated = records.withColumn("month", F.coalesce(F.substring("created_at", 1, 7), F.lit("")))
    dealt = dated.repartition("month", F.pmod(F.xxhash64("path"), F.lit(FILES_PER_MONTH)))
    dealt.sortWithinPartitions("month", "path").write.mode("append").partitionBy("month").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN_RECORD).parquet(path).select(*SCAN_RECORD.fieldNames())


#: The kept row of a path: how many scans it has, and its newest two, newest first.
KEPT = (
    "path string, scans long, newest array<struct<created_at: string, id: string, total: long, "
    "security_score: int, security_grade: string>>"
)


def _kept_rows(records: DataFrame) -> DataFrame:
    """Rows of ``KEPT`` over some records; however many scans a path has, two of them travel."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    top = first_n(records, ["path"], order, 2, "_age")
    one = F.struct("created_at", "id", "total", "security_score", "security_grade")
    newest = top.groupBy("path").agg(F.sort_array(F.collect_list(one), asc=False).alias("newest"))
    counts = records.groupBy("path").agg(F.count("*").alias("scans"))
    return counts.join(newest, "path").select("path", "scans", "newest")


def _merged_kept_rows(rows: DataFrame) -> DataFrame:
    """Adds up the one or two rows that a path has: those of a batch and those kept."""
    both = F.slice(F.sort_array(F.flatten(F.collect_list("newest")), asc=False), 1, 2)
    return rows.groupBy("path").agg(F.sum("scans").alias("scans"), both.alias("newest"))


def filled_new_since(records: DataFrame, path: str, batch: int) -> DataFrame:
    """``new_since`` of records that are about to be appended as this batch.

    The scan before is the one of the same batch, or else the newest that the kept table has
    for the path; the history itself is not read.
    """
    held = buckets.held_for(records, ["path"], f"{path}/kept", batch, KEPT)
    last = held.select("path", F.col("newest")[0].alias("n")).select("path", "n.created_at", "n.id", "n.total", F.lit(True).alias("_held"))
    last = last.join(records.select("path").distinct(), "path", "left_semi")
    both = records.withColumn("_held", F.lit(False)).unionByName(last, allowMissingColumns=True)
    return replay_new_since(both).where(~F.col("_held")).select(*SCAN_RECORD.fieldNames())


def append_scans(records: DataFrame, path: str, batch: int) -> None:
    """Append a batch of records with ``new_since`` filled, and keep the newest scans of every path.

    ``batch`` counts the appends upwards from 0; the last one may be run again and counts once.
    An append reads the kept rows of the paths' buckets, never the history. A null path or time
    counts as empty, missing columns are null. A record older than the newest kept one of its
    path meets earlier scans of its own batch only: ``replay_new_since`` over the history says
    what it is after all; counts and newest scans are right in any order.
    """
    have = set(records.columns)
    fields = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCAN_RECORD.fields]
    whole = records.select(*fields).fillna("", ["path", "created_at"])
    staged = f"{path}/staged/batch={batch}"
    whole.write.mode("overwrite").parquet(staged)
    rows = records.sparkSession.read.schema(SCAN_RECORD).parquet(staged)
    dated = filled_new_since(rows, path, batch).withColumn("month", F.substring("created_at", 1, 7))
    dealt = dated.repartition("month", F.pmod(F.xxhash64("path"), F.lit(FILES_PER_MONTH))).sortWithinPartitions("month", "path")
    dealt.write.mode("overwrite").partitionBy("month").parquet(f"{path}/scans/batch={batch}")
    buckets.merge_batch(_kept_rows(rows), _merged_kept_rows, ["path"], f"{path}/kept", batch)


def appended_scans(spark: SparkSession, path: str) -> DataFrame:
    """All records that ``append_scans`` has stored."""
    return spark.read.schema(SCAN_RECORD).parquet(f"{path}/scans").select(*SCAN_RECORD.fieldNames())


def kept_scans(spark: SparkSession, path: str) -> DataFrame:
    """One row per path from the kept table alone: its scans, the newest against the one before, last score."""
    rows = buckets.kept(spark, f"{path}/kept", KEPT)
    total, before = F.get("newest", F.lit(0))["total"], F.get("newest", F.lit(1))["total"]
    return rows.select(
        "path",
        "scans",
        total.alias("total"),
        before.alias("previous_total"),
        F.coalesce(F.greatest(total - before, F.lit(0)), F.lit(0)).cast("long").alias("new_since"),
        F.get("newest", F.lit(0))["security_score"].alias("last_score"),
        F.get("newest", F.lit(0))["security_grade"].alias("last_grade"),
    )


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.col("created_at").desc(), F.col("id").asc())


#: Scans above which the months of a path are windows of their own.
MANY_SCANS = 100_000


def replay_new_since(history: DataFrame) -> DataFrame:
    """``new_since`` of every record of a whole history.

    The previous total comes from within the same month of a path, or, for a month's
    first record, from the last record of the nearest earlier month. All months of a path
    are one window, sorted once; those of a path with very many scans are windows apart,
    and only their last totals are carried on, so that such a path is spread over its months.
    Records without a path or time are left out, but those without a time count as earliest.
    """
    rows = history.where(F.col("path").isNotNull()).withColumn("_month", F.substring("created_at", 1, 7))
    # No more rows than one in MANY_SCANS of the history.
    many = rows.groupBy("path").agg(F.count("*").alias("_n")).where(F.col("_n") > MANY_SCANS)
    cut = rows.join(F.broadcast(many.select("path", F.lit(True).alias("_many"))), "path", "left")
    cut = cut.withColumn("_span", F.when(F.col("_many"), F.col("_month")))
    ends = cut.where("_many").groupBy("path", "_month").agg(F.max_by("total", F.struct("created_at", "id")).alias("_end"))
    # Ahead of each such month stands the total before it, in a row without a month.
    before = F.lag("_end").over(W.partitionBy("path").orderBy("_month"))
    marks = ends.select("path", F.col("_month").alias("_span"), before.alias("total"))
    both = cut.drop("_many").unionByName(marks, allowMissingColumns=True)
    on = W.partitionBy("path", "_span").orderBy("_month", "created_at", "id")
    within = W.partitionBy("path", "_span", "_month").orderBy("created_at", "id")
    first = F.first("_before").over(within.rowsBetween(W.unboundedPreceding, 0))
    return (
        both.withColumn("_before", F.lag("total").over(on))
        .withColumn("previous_total", F.coalesce(F.lag("total").over(within), first))
        .where(F.col("_month").isNotNull())
        .withColumn(
            "new_since",
            F.coalesce(F.greatest(F.col("total") - F.col("previous_total"), F.lit(0)), F.lit(0)).cast("long"),
        )
        .drop("_month", "_span", "_before")
    )


def score_trend(history: DataFrame) -> DataFrame:
    """Score series of paths with at least two scans, with the last score and grade.

    The series stays long, one row per scan: a path may have any number of scans.
    """
    stats = history.groupBy("path").agg(
        F.count("*").alias("scans"),
        F.max_by(F.struct("security_score", "security_grade"), F.struct("created_at", "id")).alias("_last"),
    )
    many = stats.where(F.col("scans") >= 2).select(
        "path",
        "scans",
        F.col("_last.security_score").alias("last_score"),
        F.col("_last.security_grade").alias("last_grade"),
    )
    series = history.select("path", "created_at", "id", "security_score")
    return series.join(many, "path")


def latest_two(history: DataFrame) -> DataFrame:
    """Newest scan per path against the one before it."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    top = first_n(history, ["path"], order, 2, "_age")
    pair = top.groupBy("path").agg(
        F.max(F.when(F.col("_age") == 1, F.col("total"))).alias("total"),
        F.max(F.when(F.col("_age") == 2, F.col("total"))).alias("previous_total"),
    )
    grown = F.greatest(F.col("total") - F.col("previous_total"), F.lit(0))
    return pair.withColumn("new_since", F.coalesce(grown, F.lit(0)).cast("long"))
