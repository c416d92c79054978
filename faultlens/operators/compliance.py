"""OWASP Top 10, PCI-DSS / ISO 27001 and CWE roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# OWASP Top 10 (2021) and whether any rule can map to the category.
OWASP_TOP_10 = [
    ("A01", "Broken Access Control", True),
    ("A02", "Cryptographic Failures", True),
    ("A03", "Injection", True),
    ("A04", "Insecure Design", False),
    ("A05", "Security Misconfiguration", True),
    ("A06", "Vulnerable and Outdated Components", True),
    ("A07", "Identification and Authentication Failures", True),
    ("A08", "Software and Data Integrity Failures", True),
    ("A09", "Security Logging and Monitoring Failures", True),
    ("A10", "Server-Side Request Forgery (SSRF)", True),
]

# Indicative PCI-DSS and ISO/IEC 27001:2022 mapping.
FRAMEWORKS = [
    ("A01", "Access control", "Req 7 — Restrict access by need-to-know", "A.8.3 Information access restriction"),
    ("A02", "Cryptography", "Req 3 & 4 — Protect stored & transmitted data", "A.8.24 Use of cryptography"),
    ("A03", "Injection", "Req 6.2.4 — Prevent injection flaws", "A.8.28 Secure coding"),
    ("A05", "Configuration", "Req 2.2 — Secure system configuration", "A.8.9 Configuration management"),
    ("A06", "Dependencies", "Req 6.3.3 — Patch known vulnerabilities", "A.8.8 Mgmt of technical vulnerabilities"),
    ("A07", "Authentication", "Req 8 — Identify & authenticate access", "A.5.17 Authentication information"),
    ("A08", "Data integrity", "Req 6.5 — Change & integrity control", "A.8.28 Secure coding"),
    ("A09", "Logging", "Req 10 — Log & monitor all access", "A.8.15 Logging"),
    ("A10", "SSRF", "Req 6.2.4 — Secure coding practices", "A.8.28 Secure coding"),
]


def owasp_code(owasp: Column) -> Column:
    """``A03`` of ``A03:2021 Injection``; empty when there is none."""
    return F.regexp_extract(owasp, r"^[:\s]*([^: ]+)", 1)


def owasp_counts(findings: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """Findings per OWASP code; ``findings`` are enriched."""
    return (
        findings.withColumn("code", owasp_code(F.col("owasp")))
        .where(F.col("code") != "")
        .groupBy(*by, "code")
        .agg(F.count("*").alias("n"))
    )


def _against(names: Sequence[str], rows: list[tuple], findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Every catalogue row for every project, with its count (0 when absent).

    The catalogue has at most ten rows, so repeating it per project is a bounded inline.
    """
    catalogue = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    grid = projects.select("project", F.inline(catalogue))
    counts = owasp_counts(findings)
    return grid.join(counts, ["project", "code"], "left").withColumn(
        "count", F.coalesce("n", F.lit(0)).cast("long")
    )


def owasp_report(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """All ten categories per project with count and status."""
    status = (
        F.when(~F.col("assessable"), "Not assessed")
        .when(F.col("count") > 0, "Issues found")
        .otherwise("No issues detected")
    )
    return _against(("code", "name", "assessable"), OWASP_TOP_10, findings, projects).select(
        "project", "code", "name", "count", status.alias("status")
    )


def framework_report(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """PCI-DSS / ISO areas per project with count and status."""
    status = F.when(F.col("count") > 0, "Action needed").otherwise("OK")
    return _against(("code", "area", "pci_dss", "iso"), FRAMEWORKS, findings, projects).select(
        "project", "area", "code", "pci_dss", "iso", "count", status.alias("status")
    )


def cwe_breakdown(findings: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """Findings per CWE; order by count descending, then id."""
    return (
        findings.where(F.col("cwe") != "")
        .groupBy(*by, F.col("cwe").alias("cwe"))
        .agg(F.count("*").alias("count"))
    )
