"""Exports of findings: JSON, CSV, SARIF, attestations and notification rows."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens import __version__
from faultlens.functions import severity
from faultlens.operators import grouping
from faultlens.operators.findings import finding_order, order_key

CSV_COLUMNS = ("Severity", "Category", "CWE", "OWASP", "File", "Line", "Title", "Recommendation")
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def _omit_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _in_order(*parts: DataFrame) -> DataFrame:
    """Rows of ``(project, part, place, text)`` sorted over ranges, of any number for a project."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.orderBy("project", "part", "place").select("project", "part", "text")


def json_rows(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """``(project, part, text)``: part 0 is a project's head, part 1 its findings in order.

    The texts are JSON objects. A project's document is its head with the list ``findings``
    of the other texts; ``json_document`` puts it together.
    """
    finding = F.struct(
        F.col("rule_id").alias("rule"),
        "severity",
        severity.cvss(F.col("severity")).alias("cvss"),
        "category",
        "title",
        "file",
        "line",
        *[
            _omit_empty(F.col(c)).alias(c)
            for c in ("snippet", "explanation", "recommendation", "cwe", "owasp")
        ],
    )
    items = findings.select("project", F.lit(1).alias("part"), order_key().alias("place"), F.to_json(finding).alias("text"))
    doc = F.struct(
        "project",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        F.struct(F.col("security_score").alias("value"), F.col("security_grade").alias("grade")).alias("security_score"),
        F.struct(F.col("health_score").alias("value"), F.col("health_grade").alias("grade")).alias("code_health_score"),
        F.struct(
            "total", "critical", "high", "medium", "low",
            F.col("effort_minutes").alias("remediation_effort_minutes"),
        ).alias("summary"),
    )
    place = items.schema["place"].dataType
    heads = summary.select("project", F.lit(0).alias("part"), F.lit(None).cast(place).alias("place"), F.to_json(doc).alias("text"))
    return _in_order(heads, items)


def json_document(rows: Iterable) -> str:
    """The JSON document of one project from its ``json_rows`` in order."""
    texts = [(r.part, r.text) for r in rows]
    head = next(t for part, t in texts if part == 0)
    return f'{head[:-1]},"findings":[{",".join(t for part, t in texts if part == 1)}]}}'


def csv_rows(findings: DataFrame) -> DataFrame:
    """The eight CSV columns; the frame is sorted as the findings are."""
    return findings.orderBy("project", *finding_order()).select(
        F.col("severity").alias("Severity"),
        F.col("category").alias("Category"),
        F.col("cwe").alias("CWE"),
        F.col("owasp").alias("OWASP"),
        F.col("file").alias("File"),
        F.col("line").alias("Line"),
        F.col("title").alias("Title"),
        F.col("recommendation").alias("Recommendation"),
    )


def write_csv(findings: DataFrame, path: str) -> None:
    """A range-partitioned sort writes ordered parts; every part has the header."""
    csv_rows(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def sarif_rows(findings: DataFrame) -> DataFrame:
    """``(project, part, text)``: part 0 are a project's rules, part 1 its results, both in finding order.

    ``findings`` are enriched; the texts are JSON objects of SARIF 2.1.0. A rule comes with the
    texts of its first finding. ``sarif_document`` puts a project's document together.
    """
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        severity.sarif_level(F.col("severity")).alias("level"),
        F.struct(F.concat("title", F.lit(" — "), "recommendation").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.translate("file", "\\", "/").alias("uri")).alias("artifactLocation"),
                    region.alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
    )
    results = findings.select("project", F.lit(1).alias("part"), order_key().alias("place"), F.to_json(result).alias("text"))
    texts = F.struct("severity", "category", "title", "explanation", "recommendation", "cwe", "owasp")
    by_rule = findings.groupBy("project", "rule_id").agg(
        F.min_by(texts, order_key()).alias("f"), F.min(order_key()).alias("place")
    )
    tags = F.array_compact(
        F.array(
            F.col("f.category"),
            _omit_empty(F.col("f.cwe")),
            F.when(F.col("f.owasp") != "", F.concat(F.lit("OWASP "), F.col("f.owasp"))),
        )
    )
    rule = F.struct(
        F.col("rule_id").alias("id"),
        F.col("f.title").alias("name"),
        F.struct(F.col("f.title").alias("text")).alias("shortDescription"),
        F.struct(F.col("f.explanation").alias("text")).alias("fullDescription"),
        F.struct(F.col("f.recommendation").alias("text")).alias("help"),
        F.struct(
            tags.alias("tags"),
            severity.sarif_security_severity(F.col("f.severity")).alias("security-severity"),
        ).alias("properties"),
    )
    rules = by_rule.select("project", F.lit(0).alias("part"), "place", F.to_json(rule).alias("text"))
    return _in_order(rules, results)


def sarif_document(rows: Iterable, tool_name: str = "faultlens") -> str:
    """The SARIF document of one project from its ``sarif_rows`` in order."""
    texts = [(r.part, r.text) for r in rows]
    rules, results = (",".join(t for part, t in texts if part == k) for k in (0, 1))
    driver = json.dumps({"name": tool_name, "version": __version__})[:-1]
    return (
        f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{driver},"rules":[{rules}]}}}},'
        f'"results":[{results}]}}]}}'
    )


def write_rows(rows: DataFrame, path: str) -> None:
    """Store ``json_rows`` or ``sarif_rows`` in their order, as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def attestations(
    findings: DataFrame,
    projects: DataFrame,
    scope: str = "full",
    gate: DataFrame | None = None,
    changed_files: DataFrame | None = None,
    tool_name: str = "faultlens",
) -> DataFrame:
    """``(project, document)``: what was scanned, found, and whether the gate passed.

    Severities form a map of at most a handful of entries; zero counts do not appear.
    """
    counts = findings.groupBy("project", "severity").agg(F.count("*").alias("n"))
    per_project = counts.groupBy("project").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("findings"),
        F.sum("n").alias("total_findings"),
    )
    base = projects.select("project").join(per_project, "project", "left")
    if changed_files is not None:
        changed = changed_files.groupBy("project").agg(F.count("*").alias("files_changed"))
        base = base.join(changed, "project", "left")
    else:
        base = base.withColumn("files_changed", F.lit(None).cast("long"))
    if gate is not None:
        outcome = gate.select("project", F.struct("threshold", "fail_count", "passed").alias("gate"))
        base = base.join(outcome, "project", "left")
    else:
        base = base.withColumn("gate", F.lit(None).cast("struct<threshold:string>"))
    doc = F.struct(
        F.lit(tool_name).alias("tool"),
        F.lit(__version__).alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        F.lit(scope).alias("scope"),
        F.col("project").alias("target"),
        F.nullif("files_changed", F.lit(0)).alias("files_changed"),
        F.coalesce("findings", F.create_map().cast("map<string,bigint>")).alias("findings"),
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
        "gate",
    )
    return base.select("project", F.to_json(doc).alias("document"))


def notification_rows(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """Scores, counts and the five top findings per project."""
    top = grouping.top_finding_lines(findings)
    lines = top.groupBy("project").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]
        ).alias("top_issues")
    )
    return summary.join(lines, "project", "left").select(
        "project", "security_score", "security_grade", "health_score", "health_grade",
        "total", "critical", "high", "medium", "low",
        F.coalesce("top_issues", F.array().cast("array<string>")).alias("top_issues"),
    )
