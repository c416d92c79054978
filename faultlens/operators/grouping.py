"""Findings rolled up by rule, report counters and capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.functions import paths, severity
from faultlens.operators import remediation
from faultlens.operators.findings import finding_order, order_key
from faultlens.operators.windows import first_n

# Caps of the report lists.
MAX_OCCURRENCES = 100
MAX_REPORT_FINDINGS = 2000
MAX_CONSOLE_FINDINGS = 25
MAX_PRIORITIES = 6
MAX_TOP_FINDINGS = 5


def _key() -> Column:
    return F.when(F.col("rule_id") != "", F.col("rule_id")).otherwise(F.col("title"))


def location() -> Column:
    return F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))


def finding_groups(findings: DataFrame) -> DataFrame:
    """One row per project and rule: texts of the first finding, worst severity, count.

    ``findings`` are enriched. Only partial aggregates travel, whatever the size of a
    group; its first occurrences come from ``occurrences``.
    """
    texts = F.struct(
        "category", "title", "rule_id", "cwe", "owasp", "explanation", "recommendation"
    )
    rows = findings.select(
        "project",
        _key().alias("group_key"),
        severity.rank(F.col("severity")).alias("_rank"),
        order_key().alias("_order"),
        texts.alias("_texts"),
    )
    grouped = rows.groupBy("project", "group_key").agg(
        F.min_by("_texts", "_order").alias("_texts"),
        F.max("_rank").alias("_rank"),
        F.min("_order").alias("first_order"),
        F.count("*").alias("count"),
    )
    sev = severity.lookup(F.col("_rank"), {v: k for k, v in severity.RANKS.items()}, "")
    flat = grouped.select(
        "project",
        "group_key",
        sev.alias("severity"),
        "_texts.*",
        "count",
        F.greatest(F.col("count") - MAX_OCCURRENCES, F.lit(0)).alias("extra_count"),
        "first_order",
    )
    return remediation.with_remediation(flat).select(
        "project",
        "group_key",
        "severity",
        severity.cvss(F.col("severity")).alias("cvss"),
        "category",
        "title",
        "rule_id",
        "cwe",
        "owasp",
        paths.cwe_link(F.col("cwe")).alias("cwe_link"),
        paths.owasp_link(F.col("owasp")).alias("owasp_link"),
        "explanation",
        "recommendation",
        "fix_example",
        "count",
        "extra_count",
        "first_order",
    )


def occurrences(findings: DataFrame, n: int = MAX_OCCURRENCES) -> DataFrame:
    """First ``n`` places of every finding group, numbered from 1."""
    rows = findings.withColumn("group_key", _key())
    top = first_n(rows, ["project", "group_key"], finding_order(), n, "position")
    return top.select("project", "group_key", "position", location().alias("location"), "snippet")


def group_order() -> list[Column]:
    return [
        severity.rank(F.col("severity")).desc(),
        F.col("count").desc(),
        F.col("first_order").asc(),
    ]


def priorities(groups: DataFrame, n: int = MAX_PRIORITIES) -> DataFrame:
    """The first ``n`` Critical or High groups per project ("fix first")."""
    urgent = groups.where(F.col("severity").isin("Critical", "High"))
    return first_n(urgent, ["project"], group_order(), n, "position")


def capped(findings: DataFrame, n: int) -> DataFrame:
    """First ``n`` findings per project with their position."""
    return first_n(findings, ["project"], finding_order(), n, "position")


def report_findings(findings: DataFrame, n: int = MAX_REPORT_FINDINGS) -> DataFrame:
    """The capped findings table plus a flag on projects that have more than ``n``."""
    totals = findings.groupBy("project").agg(F.count("*").alias("total"))
    return (
        capped(findings, n)
        .join(totals, "project")
        .withColumn("capped", F.col("total") > n)
    )


def top_finding_lines(findings: DataFrame, n: int = MAX_TOP_FINDINGS) -> DataFrame:
    """``[severity] title — file:line`` of the first ``n`` findings per project."""
    text = F.concat(
        F.lit("["), F.col("severity"), F.lit("] "), F.col("title"), F.lit(" — "), location()
    )
    return capped(findings, n).select("project", "position", text.alias("text"))


def report_counters(findings: DataFrame) -> DataFrame:
    """Counters of the report head; the category names form a short sorted list."""
    return findings.groupBy("project").agg(
        F.count_if(F.col("severity").isin("Critical", "High")).alias("critical_and_high"),
        F.count_if(F.col("category") == "Security").alias("security_findings"),
        F.count_if(F.col("category") == "Performance").alias("performance_findings"),
        F.sort_array(F.collect_set("category")).alias("categories"),
    )


def severity_summary(findings: DataFrame) -> DataFrame:
    """Severity counts above zero with their display position."""
    position = severity.lookup(F.col("severity"), {"Critical": 1, "High": 2, "Medium": 3, "Low": 4}, 0)
    counts = findings.groupBy("project", "severity").agg(F.count("*").alias("n"))
    return counts.withColumn("position", position).where(F.col("position") > 0)


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Position of each row within its key; for small frames such as finding groups."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
