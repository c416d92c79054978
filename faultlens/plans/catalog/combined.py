"""Queries that put several operators together, checked against the parts' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import paths
from faultlens.operators import codelines
from faultlens.operators import findings as fo
from faultlens.operators import inventory, manifests, technology
from faultlens.plans import corpora, project_scan
from faultlens.plans.catalog import ORACLES, register
from faultlens.plans.catalog.files import every_file
from faultlens.plans.catalog.findings import _grade, _score
from faultlens.plans.corpora_sql import case_table, sql
from faultlens.sources import history, scanners, tree


def _of(name: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({ORACLES[name]})"


register(
    "u_1_merge_all_engines",
    lambda spark, d: fo.merge(*[f(corpora.scanner_reports(spark, d, e)) for e, f in scanners.ENGINES.items()])
    .groupBy("severity", "category")
    .agg(F.count("*").alias("n")),
    "SELECT severity, category, count(*) AS n FROM ("
    + " UNION ALL ".join(
        _of(n, "severity, category") for n in ("s_7_semgrep", "s_8_bandit", "s_9_gosec", "s_10_eslint", "s_11_phpstan")
    )
    + ") GROUP BY ALL",
)


def whole_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every rule over every file of three corpora, scored per project."""
    summary = project_scan.scan(tree.with_unit(every_file(spark, d))).summary
    return summary.select(
        "project", "files_scanned", "total", "critical", "high", "medium", "low", "score", "grade", "security_score",
        "health_score", "effort_minutes",
    )


_DEPS = " UNION ALL ".join(
    _of(n, "project, severity, 'Dependencies' AS category") for n in ("r_v_dep_eol_php", "r_u_dep_unpinned")
)
_COUNTS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("total", "critical", "high", "medium", "low"))
register(
    "a_8_whole_scan_summary",
    whole_scan,
    sql(
        f"""SELECT s.project, s.files_scanned, {_COUNTS}, coalesce(score, 100) AS score, {_grade('coalesce(score, 100)')} AS grade,
          coalesce(security_score, 100) AS security_score, coalesce(health_score, 100) AS health_score, coalesce(effort_minutes, 0) AS effort_minutes
        FROM ({ORACLES['a_7_files_scanned']}) s LEFT JOIN (
          SELECT project, count(*) AS total, {', '.join(f"count(*) FILTER (severity = '{x}') AS {x.lower()}" for x in fo.SEVERITIES)},
            {_score('true')} AS score, {_score('is_sec')} AS security_score, {_score('NOT is_sec')} AS health_score,
            CAST(sum({case_table('severity', {'Critical': 60, 'High': 30, 'Medium': 15, 'Low': 5}, '10')}) AS BIGINT) AS effort_minutes
          FROM (SELECT *, category IN ('Security', 'Database', 'Dependencies', 'Configuration', 'Infrastructure') AS is_sec FROM (
              SELECT project, severity, category FROM code_found UNION ALL SELECT project, severity, category FROM config_found UNION ALL {_DEPS}))
            JOIN ({ORACLES['a_7_files_scanned']}) USING (project) GROUP BY project) USING (project)""",
        "code_found", "config_found",
    ),
)


def scan_record_rows(spark: SparkSession, d: str) -> DataFrame:
    """Scan records of the manifest projects: dependency findings, language and stack."""
    files = corpora.manifest_files(spark, d)
    found = manifests.manifest_findings(codelines.analysed_paths(files))
    seen = files.groupBy("project").agg(F.count("*").alias("files_scanned"))
    scans = seen.select(
        "project",
        F.concat(F.lit("scan-"), F.col("project")).alias("id"),
        F.concat(F.lit("/srv/"), F.col("project")).alias("path"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.lit(0).alias("duration_ms"),
    )
    listing = files.select("project", "path", "is_dir")
    records = history.scan_records(
        fo.summary(found, seen), inventory.dominant_language(listing), technology.technologies(files), scans
    )
    return records.select(
        "id", "project", "path", "language", F.array_join("stack", ", ").alias("stack"), "total", "medium", "files_scanned",
        "security_score", "health_grade",
    )


register(
    "a_23_scan_record",
    scan_record_rows,
    sql(
        f"""SELECT 'scan-' || project AS id, project, '/srv/' || project AS path, coalesce(language, 'Unknown') AS language, coalesce(stack, '') AS stack,
          coalesce(n, 0) AS total, coalesce(n, 0) AS medium, files_scanned,
          CAST(CASE WHEN n IS NULL THEN 100 ELSE floor(100.0::DOUBLE / (1.0::DOUBLE + n * 1.0::DOUBLE / files_scanned) + 0.5::DOUBLE) END AS INTEGER) AS security_score, 'A' AS health_grade
        FROM (SELECT project, count(*) AS files_scanned FROM manifest_files GROUP BY project)
        LEFT JOIN (SELECT project, count(*) AS n FROM ({_DEPS}) GROUP BY project) USING (project)
        LEFT JOIN (SELECT project, string_agg(name, ', ' ORDER BY concern DESC, ord) AS stack FROM tech WHERE concern IN ('framework', 'database') GROUP BY project) USING (project)
        LEFT JOIN (SELECT project, arg_min(lang, struct_pack(b := -b, n := -n, l := lang)) AS language FROM (
            SELECT project, lang, sum(n) AS n, max(b) AS b FROM (
              SELECT project, {case_table('ext', paths.EXT_LANGUAGE, 'NULL')} AS lang, 1 AS n, 0 AS b FROM manifest_names
              UNION ALL SELECT project, {case_table('name', paths.BACKEND_LANGUAGE, 'NULL')}, 0, 1 FROM manifest_names)
            WHERE lang IS NOT NULL GROUP BY ALL HAVING sum(n) > 0) GROUP BY project) USING (project)""",
        "manifest_files", "manifest_names", "tech",
    ),
)
