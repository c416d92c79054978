"""Severity scale, effort, indicative CVSS, density score and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity scale and what hangs on it.
RANKS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
EFFORT_MINUTES = {"Critical": 60, "High": 30, "Medium": 15, "Low": 5}
CVSS = {"Critical": "9.5", "High": "8.0", "Medium": "5.0", "Low": "2.0"}
WEIGHTS = {"Critical": 15.0, "High": 5.0, "Medium": 1.0, "Low": 0.2}
SECURITY_CATEGORIES = ("Security", "Database", "Dependencies", "Configuration", "Infrastructure")
CATEGORIES = (
    "Security",
    "Database",
    "Error Handling",
    "Performance",
    "Configuration",
    "Dependencies",
    "Infrastructure",
)


def lookup(key: Column, table: dict, default) -> Column:
    """CASE expression over a small fixed table."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def rank(severity: Column) -> Column:
    return lookup(severity, RANKS, 0)


def effort_minutes(severity: Column) -> Column:
    return lookup(severity, EFFORT_MINUTES, 10)


def cvss(severity: Column) -> Column:
    return lookup(severity, CVSS, "0.0")


def parse(text: Column) -> Column:
    """Severity named by free text; anything unknown is Low."""
    from faultlens.functions.text import trim

    return lookup(
        F.lower(trim(text)), {"critical": "Critical", "high": "High", "medium": "Medium"}, "Low"
    )


def from_rank(r: Column) -> Column:
    return lookup(r, {v: k for k, v in RANKS.items()}, "none")


def is_security(category: Column) -> Column:
    return category.isin(*SECURITY_CATEGORIES)


def density_score(total: Column, crit: Column, high: Column, med: Column, low: Column, files: Column) -> Column:
    """0-100 score from severity-weighted findings per file, capped at 79 by a Critical."""
    weighted = (
        crit * F.lit(WEIGHTS["Critical"])
        + high * F.lit(WEIGHTS["High"])
        + med * F.lit(WEIGHTS["Medium"])
        + low * F.lit(WEIGHTS["Low"])
    )
    density = weighted / F.greatest(files, F.lit(1)).cast("double")
    raw = F.floor(F.lit(100.0) / (F.lit(1.0) + density) + F.lit(0.5)).cast("int")
    capped = F.when(crit > 0, F.least(raw, F.lit(79))).otherwise(raw)
    return F.when(total == 0, F.lit(100)).otherwise(F.greatest(capped, F.lit(1)))


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A")
        .when(score >= 80, "B")
        .when(score >= 70, "C")
        .when(score >= 60, "D")
        .otherwise("F")
    )


def rating(worst_rank: Column) -> Column:
    """Letter for the worst security-relevant severity: E for Critical up to A for none."""
    return lookup(worst_rank, {4: "E", 3: "D", 2: "C", 1: "B"}, "A")


def sarif_level(severity: Column) -> Column:
    return lookup(severity, {"Critical": "error", "High": "error", "Medium": "warning"}, "note")


def sarif_security_severity(severity: Column) -> Column:
    return lookup(severity, {"Critical": "9.5", "High": "8.0", "Medium": "5.0"}, "2.0")


def from_runtime(severity: Column) -> Column:
    return lookup(severity, {"fatal": "Critical", "error": "High"}, "Medium")


def from_log_level(level: Column) -> Column:
    return (
        F.when(level.isin("EMERGENCY", "ALERT", "CRITICAL", "FATAL"), "Critical")
        .when(level.isin("ERROR", "EXCEPTION"), "High")
        .when(level == "WARNING", "Medium")
        .otherwise("Low")
    )


def effort_text(minutes: Column) -> Column:
    """``none``, ``~5m``, ``~2h`` or ``~2h 5m``."""
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return (
        F.when(minutes <= 0, F.lit("none"))
        .when(minutes < 60, F.concat(F.lit("~"), minutes.cast("string"), F.lit("m")))
        .when(minutes % 60 == 0, F.concat(F.lit("~"), hours, F.lit("h")))
        .otherwise(F.concat(F.lit("~"), hours, F.lit("h "), rest, F.lit("m")))
    )
