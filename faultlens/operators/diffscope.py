"""Changed files and line ranges from unified diff text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.functions import paths
from faultlens.operators.windows import carry_forward

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
#: The same lines, with the new side as one group.
ADDED = r"^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"
LINES_PER_BUCKET = 10_000
#: Lines of a file whose merged ranges form one row of a lookup.
LINES_PER_SPAN_ROW = 4096
#: The row of a changed file itself, beside those of its lines.
WHOLE_FILE = -1
SPANS = "array<struct<start:int,end:int>>"


def _headers_and_hunks(diff_lines: DataFrame) -> DataFrame:
    """Header and hunk lines alone; ``header`` is the file that a header opens, null for hunks."""
    text = F.col("text")
    is_header = text.startswith("+++ ")
    target = F.substring(text, 5, 2**31 - 1)
    name = F.when(target == "/dev/null", F.lit("")).otherwise(
        paths.normalise(F.regexp_replace(target, "^b/", ""))
    )
    return diff_lines.where(is_header | text.startswith("@@")).withColumn("header", F.when(is_header, name))


def _with_file(rows: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    bucket = F.floor(F.col("line_no") / LINES_PER_BUCKET)
    return carry_forward(rows, ["project"], ["line_no"], "header", bucket, "file", marks)


def tagged_headers(diff_lines: DataFrame) -> DataFrame:
    """Header and hunk lines of ``diff_lines(project, line_no, text)`` with their file.

    All other lines are dropped first. A header opens its file for the hunks below it;
    ``/dev/null`` (a deleted file) opens the empty name.
    """
    return _with_file(_headers_and_hunks(diff_lines))


def changed_lines(diff_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``changed_files(project, file, all)`` and ``changed_ranges(project, file, start, end)``.

    The files come from the header lines alone, so that nothing is carried for them.
    """
    files = (
        _headers_and_hunks(diff_lines)
        .where(F.coalesce("header", F.lit("")) != "")
        .select("project", F.col("header").alias("file"))
        .distinct()
        .withColumn("all", F.lit(False))
    )
    return files, hunk_ranges(tagged_headers(diff_lines).where(F.coalesce("file", F.lit("")) != ""))


def hunk_ranges(tagged: DataFrame) -> DataFrame:
    """Inclusive new-side ranges; a missing count is 1, a count of 0 adds nothing."""
    text = F.col("text")
    count = F.regexp_extract(text, HUNK, 2)
    start = F.regexp_extract(text, HUNK, 1).try_cast("int")
    n = F.when(count == "", F.lit(1)).otherwise(count.try_cast("int"))
    return (
        tagged.where(F.col("header").isNull() & text.rlike(HUNK))
        .select("project", "file", start.alias("start"), (start + n - 1).alias("end"), n.alias("n"))
        .where(F.col("n") > 0)
        .select("project", "file", "start", "end")
    )


def span_bucket(line):
    return F.floor(line / LINES_PER_SPAN_ROW).cast("int")


def _pieces(start, end):
    """A range cut at the borders of the lookup rows, as ``(bucket, start, end)``."""
    first, last = span_bucket(start), span_bucket(end)
    buckets = F.when(start <= end, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        buckets,
        lambda b: F.struct(
            b.alias("bucket"),
            F.greatest(start, b * LINES_PER_SPAN_ROW).alias("start"),
            F.least(end, (b + 1) * LINES_PER_SPAN_ROW - 1).alias("end"),
        ),
    )


def merged_spans(pieces: DataFrame) -> DataFrame:
    """``(project, file, bucket, spans)``: overlapping and touching ranges of ``pieces(project,
    file, bucket, start, end)`` merged, in order.

    One exchange: the islands are found and collected where the rows of a bucket lie, and a
    bucket has at most half as many islands as lines. A piece without a start stands for its file.
    """
    key = ["project", "file", "bucket"]
    placed = pieces.repartition(*key)
    # At most one row for each start.
    longest = placed.groupBy(*key, "start").agg(F.max("end").alias("end"))
    so_far = W.partitionBy(*key).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") > F.max("end").over(so_far) + 1, F.lit(True))
    numbered = longest.withColumn("_opens", opens.cast("int"))
    up_to = W.partitionBy(*key).orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    islands = (
        numbered.withColumn("_island", F.sum("_opens").over(up_to))
        .groupBy(*key, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    held = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    return islands.groupBy(*key).agg(F.array_sort(F.collect_list(held)).alias("spans"))


def changed_spans(diff_lines: DataFrame) -> DataFrame:
    """The changed files and their merged ranges in one frame, from one reading of the diff.

    A file has a row with the bucket ``WHOLE_FILE``, and one for each ``LINES_PER_SPAN_ROW``
    lines in which something changed. Hunks are parsed before their files are carried to them:
    only headers and hunks that add lines travel, as numbers.
    """
    kept = _headers_and_hunks(diff_lines)
    text, header = F.col("text"), F.col("header")
    # By a generator, so that filters and columns above read one match.
    added = F.when(text.startswith("@@ -"), F.regexp_extract(text, ADDED, 1))
    start, count = F.substring_index("_added", ",", 1), F.substring_index("_added", ",", -1)
    n = F.when(F.col("_added").contains(","), count.try_cast("int")).otherwise(F.lit(1))
    rows = (
        kept.select("project", "line_no", "header", F.explode(F.array(added)).alias("_added"))
        .select("project", "line_no", "header", start.try_cast("int").alias("start"), n.alias("n"))
        .where(header.isNotNull() | (F.col("start").isNotNull() & (F.col("n") > 0)))
    )
    whole = F.array(F.struct(F.lit(WHOLE_FILE).alias("bucket"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    nothing = F.array().cast("array<struct<bucket:int,start:int,end:int>>")
    parts = F.when(header.isNotNull(), whole).otherwise(F.coalesce(_pieces(F.col("start"), F.col("start") + F.col("n") - 1), nothing))
    tagged = _with_file(rows, kept).where(F.coalesce("file", F.lit("")) != "")
    return merged_spans(tagged.select("project", "file", F.inline(parts)))


def spans_of(changed_files: DataFrame, changed_ranges: DataFrame) -> DataFrame:
    """The same frame from files and ranges that are there already."""
    files = changed_files.select(
        "project", "file", F.lit(WHOLE_FILE).alias("bucket"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")
    )
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    return merged_spans(files.unionByName(changed_ranges.select("project", "file", F.inline(_pieces(start, end)))))


def with_new_files(changed_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """Add untracked files ``(project, file)``: every line of theirs counts as changed."""
    added = new_files.select(
        "project", paths.normalise(F.col("file")).alias("file"), F.lit(True).alias("all")
    )
    return (
        changed_files.unionByName(added)
        .groupBy("project", "file")
        .agg(F.bool_or("all").alias("all"))
    )
