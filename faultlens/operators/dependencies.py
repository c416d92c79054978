"""Pinned dependencies against advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import text
from faultlens.operators.detect import PHASE_EXTERNAL
from faultlens.schemas import FINDING_COLUMNS


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """One row per dependency and matching advisory; exact name and version.

    ``deps(project, source, ecosystem, name, version)``, ``advisories(id, ecosystem, name,
    version, severity, summary)``. Neither side is forced to be broadcast.
    """
    severity_word = F.initcap(text.trim(F.col("severity")))
    return deps.join(
        advisories.withColumn("severity", severity_word), ["ecosystem", "name", "version"]
    )


def dependency_findings(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """``DEP_CVE`` findings without a line."""
    summary = F.coalesce("summary", F.lit(""))
    made = vulnerable(deps, advisories).select(
        "project",
        F.lit("DEP_CVE").alias("rule_id"),
        "severity",
        F.lit("Dependencies").alias("category"),
        F.concat(F.col("name"), F.lit("@"), F.col("version"), F.lit(" — "), F.col("id")).alias("title"),
        F.col("source").alias("file"),
        F.lit(0).alias("line"),
        F.lit("").alias("snippet"),
        F.when(text.trim(summary) == "", F.lit("Known vulnerability in a dependency."))
        .otherwise(summary)
        .alias("explanation"),
        F.concat(
            F.lit("Review advisory "), F.col("id"), F.lit(" and upgrade "), F.col("name"), F.lit(".")
        ).alias("recommendation"),
        F.lit("").alias("cwe"),
        F.lit("").alias("owasp"),
        F.lit(PHASE_EXTERNAL).alias("phase"),
        F.lit(0).alias("ord"),
        F.lit(None).cast("string").alias("identity"),
    )
    return made.select(*FINDING_COLUMNS)


def scan_counts(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies checked and vulnerabilities found, per project."""
    checked = deps.groupBy("project").agg(F.count("*").alias("deps_scanned"))
    found = vulnerable(deps, advisories).groupBy("project").agg(F.count("*").alias("vulnerabilities"))
    return checked.join(found, "project", "left").na.fill(0, ["vulnerabilities"])
