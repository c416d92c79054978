"""The whole scan: files to findings, scope, suppression, gate and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.operators import codelines, compliance, configscan, dependencies, detect
from faultlens.operators import diffscope, findings as fo, grouping, manifests


def analysed(files: DataFrame) -> DataFrame:
    is_file = ~F.coalesce(F.col("is_dir"), F.lit(False)) if "is_dir" in files.columns else F.lit(True)
    return codelines.analysed_paths(files.where(is_file))


def static_findings(files: DataFrame) -> DataFrame:
    """Code, manifest and config findings of a ``files`` table.

    On a table partitioned by unit each of the three branches scans its own partitions.
    """
    return _static_findings(analysed(files))


def _static_findings(rows: DataFrame) -> DataFrame:
    return fo.merge(
        detect.code_findings(codelines.code_files(rows)),
        manifests.manifest_findings(rows),
        configscan.config_findings(rows),
    )


def files_scanned(files: DataFrame) -> DataFrame:
    """Source files plus recognised config files per project; a file can count in both.

    Counted by path and kind alone, for every project that has a file at all.
    """
    return _files_scanned(files, analysed(files))


def _files_scanned(files: DataFrame, rows: DataFrame) -> DataFrame:
    code = codelines.code_files(rows).groupBy("project").agg(F.count("*").alias("n"))
    config = configscan.config_files(rows).groupBy("project").agg(F.count("*").alias("n"))
    seen = files.select("project").distinct().withColumn("n", F.lit(0).cast("long"))
    return (
        seen.unionByName(code)
        .unionByName(config)
        .groupBy("project")
        .agg(F.sum("n").alias("files_scanned"))
    )


@dataclass
class ScanOptions:
    """What a scan keeps, in the order it is applied."""

    categories: Sequence[str] = ()
    minimum_severity: str = ""
    disabled_rules: Sequence[str] = ()
    diff_lines: DataFrame | None = None
    new_files: DataFrame | None = None
    baseline: DataFrame | None = None
    fail_on: str = ""


@dataclass
class ScanResult:
    findings: DataFrame
    files_scanned: DataFrame
    summary: DataFrame
    gate: DataFrame | None = None
    extras: dict[str, DataFrame] = field(default_factory=dict)


def apply_options(found: DataFrame, options: ScanOptions) -> DataFrame:
    """Scope, disabled rules, changed lines, baseline: in this order."""
    kept = fo.in_scope(found, options.categories, options.minimum_severity)
    kept = fo.without_rules(kept, options.disabled_rules)
    if options.diff_lines is not None:
        kept = fo.on_changed_spans(kept, diffscope.changed_spans(options.diff_lines), options.new_files)
    if options.baseline is not None:
        kept = fo.suppress_known(kept, options.baseline)
    return kept


def scan(
    files: DataFrame,
    options: ScanOptions | None = None,
    external: Sequence[DataFrame] = (),
    deps: DataFrame | None = None,
    advisories: DataFrame | None = None,
) -> ScanResult:
    """Run the scan lazily. Write ``findings`` once when several results are wanted."""
    options = options or ScanOptions()
    rows = analysed(files)
    parts = [_static_findings(rows), *external]
    if deps is not None and advisories is not None:
        parts.append(dependencies.dependency_findings(deps, advisories))
    found = apply_options(fo.enrich(fo.merge(*parts)), options)
    scanned = _files_scanned(files, rows)
    return ScanResult(
        findings=found,
        files_scanned=scanned,
        summary=fo.summary(found, scanned),
        gate=fo.gate(found, scanned, options.fail_on) if options.fail_on else None,
    )


def reports(result: ScanResult) -> dict[str, DataFrame]:
    """Roll-ups of a scan by name."""
    groups = grouping.finding_groups(result.findings)
    projects = result.files_scanned.select("project")
    return {
        "summary": result.summary,
        "by_severity": fo.by_severity(result.findings),
        "by_category": fo.by_category(result.findings),
        "groups": groups,
        "occurrences": grouping.occurrences(result.findings),
        "priorities": grouping.priorities(groups),
        "owasp": compliance.owasp_report(result.findings, projects),
        "frameworks": compliance.framework_report(result.findings, projects),
        "cwe": compliance.cwe_breakdown(result.findings),
    }
