"""One problem list from findings, runtime groups and log groups, and its explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import severity
from faultlens.operators import errorgroups, grouping, loggroups, remediation
from faultlens.operators.windows import first_n

# Lengths of the lists.
MAX_INSIGHTS, MAX_PRIORITIES = 12, 5

_FIELDS = (
    "project", "source", "severity", "category", "title", "location", "detail",
    "recommendation", "cause", "cwe", "count",
)


def problem_list(findings: DataFrame, runtime: DataFrame, logs: DataFrame) -> DataFrame:
    """All findings, runtime groups and log groups as problems.

    ``findings`` are enriched; runtime and log groups carry ``project``. ``place`` holds what
    orders problems of equal rank: the source, then the order within it. Nothing is cut here,
    so counts and rankings see every problem.
    """
    empty = F.lit("")

    def place(source: int, *parts: Column) -> Column:
        """Comparable across sources: numbers and texts, ascending, newest first."""
        kinds = ("long", "long", "string", "string", "long", "long", "long")
        return F.struct(
            F.lit(source).alias("source"), *[p.cast(k).alias(f"k{i}") for i, (p, k) in enumerate(zip(parts, kinds, strict=True))]
        )

    zero = F.lit(0)
    static = findings.select(
        "project",
        F.lit("static").alias("source"),
        "severity",
        "category",
        "title",
        grouping.location().alias("location"),
        F.col("explanation").alias("detail"),
        "recommendation",
        empty.alias("cause"),
        "cwe",
        F.lit(0).cast("long").alias("count"),
        empty.alias("newest"),
        place(0, -severity.rank(F.col("severity")), zero, F.col("file"), empty, F.col("line"), F.col("phase"), F.col("ord")).alias("place"),
    )
    errors = runtime.select(
        "project",
        F.lit("runtime").alias("source"),
        severity.from_runtime(F.col("severity")).alias("severity"),
        F.lit("Runtime").alias("category"),
        F.col("type").alias("title"),
        errorgroups.place().alias("location"),
        F.col("last_message").alias("detail"),
        empty.alias("recommendation"),
        empty.alias("cause"),
        empty.alias("cwe"),
        "count",
        F.col("last_seen").alias("newest"),
        place(1, zero, zero, F.col("type"), F.col("file"), F.col("line"), zero, zero).alias("place"),
    )
    lines = logs.select(
        "project",
        F.lit("log").alias("source"),
        severity.from_log_level(F.col("level")).alias("severity"),
        "category",
        F.col("sample").alias("title"),
        empty.alias("location"),
        F.col("sample").alias("detail"),
        empty.alias("recommendation"),
        "cause",
        empty.alias("cwe"),
        "count",
        empty.alias("newest"),
        place(2, zero, zero, F.col("signature"), empty, zero, zero, zero).alias("place"),
    )
    return static.unionByName(errors).unionByName(lines).select(*_FIELDS, "newest", "place")


def problem_text() -> Column:
    place = F.when(
        F.col("location") != "", F.concat(F.lit(" ("), F.col("location"), F.lit(")"))
    ).otherwise("")
    times = F.when(
        F.col("count") > 1,
        F.concat(F.lit(" — observed "), F.col("count").cast("string"), F.lit(" times")),
    ).otherwise("")
    return F.concat(F.col("title"), place, times)


def root_cause_text() -> Column:
    return (
        F.when(F.col("cause") != "", F.col("cause"))
        .when(F.col("detail") != "", F.col("detail"))
        .otherwise("Not determined from the available findings.")
    )


def impact_text() -> Column:
    # One sentence per severity.
    return severity.lookup(
        F.lower("severity"),
        {
            "critical": "Critical — can cause outages, data loss, or a security breach if unaddressed.",
            "high": "High — significant risk to stability, security, or correctness.",
            "medium": "Medium — degrades performance or quality, or creates latent risk.",
            "low": "Low — minor issue or best-practice deviation.",
        },
        "Unclassified.",
    )


def suggestion_text() -> Column:
    return F.when(F.col("recommendation") != "", F.col("recommendation")).otherwise(
        "Investigate the finding at its location and address the underlying condition."
    )


def insights(problems: DataFrame, n: int = MAX_INSIGHTS) -> DataFrame:
    """The most pressing problems per project, explained from their own fields."""
    order = [
        severity.rank(F.initcap("severity")).desc(),
        F.col("count").desc(),
        F.col("place.source").asc(),
        F.col("newest").desc(),
        F.col("place").asc(),
    ]
    top = first_n(problems, ["project"], order, n, "insight")
    return remediation.with_remediation(top).select(
        "project",
        "insight",
        "title",
        "severity",
        problem_text().alias("problem"),
        root_cause_text().alias("root_cause"),
        impact_text().alias("impact"),
        suggestion_text().alias("suggestion"),
        "exploit",
        "fix_example",
        "complexity",
        "effort",
    )


def priority_lines(problem_insights: DataFrame, n: int = MAX_PRIORITIES) -> DataFrame:
    text = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("title"))
    return problem_insights.where(F.col("insight") <= n).select(
        "project", "insight", text.alias("priority")
    )


def local_summary(problems: DataFrame, stack: DataFrame) -> DataFrame:
    """One sentence per project; ``stack(project, names ARRAY<STRING>)``."""
    rank = severity.rank(F.initcap("severity"))
    counts = problems.groupBy("project").agg(
        F.count("*").alias("n"),
        *[F.count_if(rank == r).alias(s.lower()) for s, r in severity.RANKS.items()],
    )
    names = F.array_join("names", ", ")
    known = F.when(F.coalesce(F.size("names"), F.lit(0)) > 0, names).otherwise("unknown stack")
    # Fixed value: the sentence.
    sentence = F.format_string(
        "Analyzed %s (%s). Collected %d finding(s): %d critical, %d high, %d medium, %d low, "
        "spanning static analysis, runtime errors, and logs. The most pressing items are listed below; "
        "explanations restate the detected findings without adding unverified conclusions.",
        F.when(F.trim("project") == "", F.lit("the project")).otherwise(F.col("project")),
        known,
        F.col("n"),
        *[F.col(s.lower()) for s in severity.RANKS],
    )
    return counts.join(stack, "project", "left").select("project", sentence.alias("summary"))
