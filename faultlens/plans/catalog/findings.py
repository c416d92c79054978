"""Queries on findings: enrichment, filters, suppression, scores, roll-ups and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import paths, severity
from faultlens.operators import compliance, diffscope, grouping, insights, remediation
from faultlens.operators import errorgroups, loggroups
from faultlens.operators import findings as fo
from faultlens.plans import corpora, project_scan
from faultlens.plans.catalog import register
from faultlens.plans.corpora_sql import (
    FINGERPRINT, ORDER, case_table, define, sql, text, trim,
)
from faultlens.session import scratch_dir
from faultlens.sources import baselines, events, exports, history


def found(spark: SparkSession, d: str) -> DataFrame:
    return corpora.findings(spark, d)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return fo.enrich(found(spark, d))


def scanned(spark: SparkSession, d: str) -> DataFrame:
    """Projects with their number of files, standing in for a scan's file count."""
    files = found(spark, d).select("project", "file").distinct()
    return files.groupBy("project").agg(F.count("*").alias("files_scanned"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return fo.summary(found(spark, d), scanned(spark, d))


# --- joins --------------------------------------------------------------------

register(
    "j_1_metadata_enrich",
    lambda spark, d: enriched(spark, d).groupBy("rule_id", "cwe", "owasp").agg(F.count("*").alias("n")),
    sql("SELECT rule_id, cwe, owasp, count(*) AS n FROM enriched GROUP BY ALL", "enriched"),
)


def known(spark: SparkSession, d: str) -> DataFrame:
    """Baseline of the accepted findings: those of the performance category."""
    return baselines.baseline_of(found(spark, d).where(F.col("category") == "Performance"))


define(
    "baseline",
    f"SELECT DISTINCT project, {FINGERPRINT} AS fingerprint FROM findings WHERE category = 'Performance'",
    "findings",
)
register(
    "j_2_baseline_suppression",
    lambda spark, d: fo.suppress_known(found(spark, d), known(spark, d))
    .groupBy("project", "rule_id")
    .agg(F.count("*").alias("n"), F.sum("line").alias("lines")),
    sql(
        f"""SELECT project, rule_id, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM findings f
        WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.project = f.project AND b.fingerprint = {FINGERPRINT}) GROUP BY ALL""",
        "findings", "baseline",
    ),
)


def suppressed_by_table(spark: SparkSession, d: str) -> DataFrame:
    """The same suppression against a stored, bucketed baseline."""
    path = scratch_dir(spark, "baseline-table")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    baselines.write_baseline_table(found(spark, d).where(F.col("category") == "Performance"), name, path, buckets)
    return fo.suppress_known(found(spark, d), baselines.read_baseline_table(spark, name))


register(
    "j_2_bucketed_baseline",
    lambda spark, d: suppressed_by_table(spark, d).groupBy("project", "rule_id").agg(F.count("*").alias("n"), F.sum("line").alias("lines")),
    sql(
        f"""SELECT project, rule_id, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM findings f
        WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.project = f.project AND b.fingerprint = {FINGERPRINT}) GROUP BY ALL""",
        "findings", "baseline",
    ),
)


def changed(spark: SparkSession, d: str) -> DataFrame:
    return fo.on_changed_spans(found(spark, d), diffscope.changed_spans(corpora.diff_lines(spark, d)))


register(
    "j_3_changed_line_scope",
    lambda spark, d: changed(spark, d)
    .groupBy("project", "file")
    .agg(F.count("*").alias("n"), F.sum("line").alias("lines")),
    sql(
        """SELECT project, file, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM findings f
        WHERE EXISTS (SELECT 1 FROM diff_files c WHERE c.project = f.project AND c.file = f.file)
          AND (line <= 0 OR EXISTS (SELECT 1 FROM diff_ranges r WHERE r.project = f.project AND r.file = f.file AND f.line BETWEEN r.start AND r."end"))
        GROUP BY ALL""",
        "findings", "diff_files", "diff_ranges",
    ),
)


def scan_with_options(spark: SparkSession, d: str) -> DataFrame:
    """Categories, disabled rules, changed lines, baseline and gate, as one scan applies them.

    No least severity is asked for, so severities without a rank stay.
    """
    unranked = F.when(F.col("line") % 7 == 0, F.lit("MODERATE")).otherwise(F.col("severity"))
    options = project_scan.ScanOptions(
        categories=["Security", " Database "],
        disabled_rules=["SEC_TOKEN"],
        diff_lines=corpora.diff_lines(spark, d),
        baseline=known(spark, d),
        fail_on="high",
    )
    kept = project_scan.apply_options(found(spark, d).withColumn("severity", unranked), options)
    gate = fo.gate(kept, kept.select("project").distinct(), options.fail_on)
    return kept.groupBy("project", "severity").agg(F.count("*").alias("n")).join(gate, "project")


register(
    "scan_with_options",
    scan_with_options,
    sql(
        f"""SELECT project, severity, n, 'high' AS threshold,
          CAST(coalesce(sum(n) FILTER (severity IN ('Critical', 'High')) OVER (PARTITION BY project), 0) AS BIGINT) AS fail_count,
          coalesce(sum(n) FILTER (severity IN ('Critical', 'High')) OVER (PARTITION BY project), 0) = 0 AS passed
        FROM (SELECT project, CASE WHEN line % 7 = 0 THEN 'MODERATE' ELSE severity END AS severity, count(*) AS n FROM findings f
          WHERE category IN ('Security', 'Database') AND rule_id <> 'SEC_TOKEN'
            AND EXISTS (SELECT 1 FROM diff_files c WHERE c.project = f.project AND c.file = f.file)
            AND (line <= 0 OR EXISTS (SELECT 1 FROM diff_ranges r WHERE r.project = f.project AND r.file = f.file AND f.line BETWEEN r.start AND r."end"))
            AND NOT EXISTS (SELECT 1 FROM baseline b WHERE b.project = f.project AND b.fingerprint = {FINGERPRINT})
          GROUP BY ALL)""",
        "findings", "diff_files", "diff_ranges", "baseline",
    ),
)


def _remediation_rows(rows: dict, key: str) -> str:
    values = ", ".join("(" + ", ".join(text(v) for v in (k, *row)) + ")" for k, row in rows.items())
    return f"(VALUES {values}) AS {key}_t({key}, exploit, complexity, effort, fix_example)"


define("rem_cwe", f"SELECT * FROM {_remediation_rows(remediation.BY_CWE, 'cwe')}")
define("rem_category", f"SELECT * FROM {_remediation_rows(remediation.BY_CATEGORY, 'category')}")
register(
    "j_5_remediation_lookup",
    lambda spark, d: remediation.with_remediation(enriched(spark, d).select("project", "cwe", "category"))
    .groupBy("cwe", "category", "exploit", "complexity", "effort", "fix_example")
    .agg(F.count("*").alias("n")),
    sql(
        """SELECT e.cwe, e.category, coalesce(a.exploit, b.exploit, '') AS exploit, coalesce(a.complexity, b.complexity, 'Medium') AS complexity,
          coalesce(a.effort, b.effort, 'varies') AS effort, coalesce(a.fix_example, b.fix_example, '') AS fix_example, count(*) AS n
        FROM enriched e LEFT JOIN rem_cwe a ON a.cwe = e.cwe LEFT JOIN rem_category b ON b.category = e.category GROUP BY ALL""",
        "enriched", "rem_cwe", "rem_category",
    ),
)

_CATALOGUE = ", ".join(f"({text(a)}, {text(b)}, {str(ok).lower()})" for a, b, ok in compliance.OWASP_TOP_10)
define("owasp_catalogue", f"SELECT * FROM (VALUES {_CATALOGUE}) AS t(code, name, assessable)")
_FRAMEWORKS = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in compliance.FRAMEWORKS)
define("framework_catalogue", f"SELECT * FROM (VALUES {_FRAMEWORKS}) AS t(code, area, pci_dss, iso)")
_CODE = "regexp_extract(owasp, '^[: ]*([^: ]+)', 1)"
define(
    "owasp_counts",
    f"SELECT project, {_CODE} AS code, count(*) AS n FROM enriched WHERE {_CODE} <> '' GROUP BY ALL",
    "enriched",
)


def projects(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("project").distinct()


_OWASP = """SELECT p.project, c.code, c.name, CAST(coalesce(n.n, 0) AS BIGINT) AS count,
  CASE WHEN NOT c.assessable THEN 'Not assessed' WHEN coalesce(n.n, 0) > 0 THEN 'Issues found' ELSE 'No issues detected' END AS status
FROM (SELECT DISTINCT project FROM findings) p CROSS JOIN owasp_catalogue c LEFT JOIN owasp_counts n ON n.project = p.project AND n.code = c.code"""
register(
    "j_7_owasp_catalogue",
    lambda spark, d: compliance.owasp_report(enriched(spark, d), projects(spark, d)),
    sql(_OWASP, "findings", "owasp_catalogue", "owasp_counts"),
)
register(
    "a_18_owasp_counts",
    lambda spark, d: compliance.owasp_counts(enriched(spark, d)),
    sql("SELECT project, code, n FROM owasp_counts", "owasp_counts"),
)
register(
    "a_19_framework_rollup",
    lambda spark, d: compliance.framework_report(enriched(spark, d), projects(spark, d)),
    sql(
        """SELECT p.project, c.area, c.code, c.pci_dss, c.iso, CAST(coalesce(n.n, 0) AS BIGINT) AS count,
          CASE WHEN coalesce(n.n, 0) > 0 THEN 'Action needed' ELSE 'OK' END AS status
        FROM (SELECT DISTINCT project FROM findings) p CROSS JOIN framework_catalogue c LEFT JOIN owasp_counts n ON n.project = p.project AND n.code = c.code""",
        "findings", "framework_catalogue", "owasp_counts",
    ),
)
register(
    "a_20_cwe_breakdown",
    lambda spark, d: compliance.cwe_breakdown(enriched(spark, d)),
    sql("SELECT project, cwe, count(*) AS count FROM enriched WHERE cwe <> '' GROUP BY ALL", "enriched"),
)
register(
    "x_12_owasp_code",
    lambda spark, d: enriched(spark, d).groupBy("owasp", compliance.owasp_code(F.col("owasp")).alias("code")).agg(F.count("*").alias("n")),
    sql(f"SELECT owasp, {_CODE} AS code, count(*) AS n FROM enriched GROUP BY ALL", "enriched"),
)

# --- filters ------------------------------------------------------------------


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


register(
    "f_13_category_and_severity",
    lambda spark, d: _count(fo.in_scope(found(spark, d), ["Security", "Database"], "MEDIUM"), "project", "category", "severity"),
    sql(
        "SELECT project, category, severity, count(*) AS n FROM findings WHERE category IN ('Security', 'Database') AND rank >= 2 GROUP BY ALL",
        "findings",
    ),
)
register(
    "f_14_severity_parse",
    lambda spark, d: _count(
        corpora.advisories(spark, d).unionByName(
            found(spark, d).select(F.concat(F.lit("  "), F.upper("severity"), F.lit("\t")).alias("severity")), allowMissingColumns=True
        ).withColumn("parsed", severity.parse(F.col("severity"))),
        "severity", "parsed",
    ),
    sql(
        f"""SELECT severity, {case_table('lower(' + trim('severity') + ')', {'critical': 'Critical', 'high': 'High', 'medium': 'Medium'}, "'Low'")} AS parsed, count(*) AS n
        FROM (SELECT severity FROM advisories UNION ALL SELECT '  ' || upper(severity) || chr(9) FROM findings) GROUP BY ALL""",
        "advisories", "findings",
    ),
)
register(
    "f_15_rule_disable",
    lambda spark, d: _count(fo.without_rules(found(spark, d), ["SEC_TOKEN", " DEP_CVE "]), "rule_id"),
    sql("SELECT rule_id, count(*) AS n FROM findings WHERE rule_id NOT IN ('SEC_TOKEN', 'DEP_CVE') GROUP BY ALL", "findings"),
)
register(
    "f_16_generic_keep",
    lambda spark, d: _count(fo.keep(found(spark, d), F.col("snippet") != ""), "project", "severity"),
    sql("SELECT project, severity, count(*) AS n FROM findings WHERE snippet <> '' GROUP BY ALL", "findings"),
)


def _top(n: int, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {ORDER}) AS position FROM findings) WHERE position <= {n}"""


_POS = "CAST(position AS INTEGER) AS position"
register(
    "f_18_top_findings",
    lambda spark, d: grouping.top_finding_lines(found(spark, d)),
    sql(_top(5, f"project, {_POS}, '[' || severity || '] ' || title || ' — ' || file || ':' || line AS text"), "findings"),
)
_ROW = f"project, {_POS}, severity, file, line, title"
register(
    "o_11_console_findings",
    lambda spark, d: grouping.capped(found(spark, d), grouping.MAX_CONSOLE_FINDINGS).select(
        "project", "position", "severity", "file", "line", "title"
    ),
    sql(_top(grouping.MAX_CONSOLE_FINDINGS, _ROW), "findings"),
)


def ordered_places(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """All findings in order, by a sort over ranges that no project fills alone."""
    rows = found(spark, d).select(*by, "severity", "file", "line", "title", fo.order_key().alias("_order"))
    return rows.orderBy(*by, "_order").drop("_order")


register(
    "w_8_finding_order",
    lambda spark, d: ordered_places(spark, d, "project"),
    sql(f"SELECT project, severity, file, line, title FROM findings ORDER BY project, {ORDER}", "findings"),
)
register(
    "o_1_sorted_findings",
    lambda spark, d: ordered_places(spark, d),
    sql(f"SELECT severity, file, line, title FROM findings ORDER BY {ORDER}", "findings"),
)
register(
    "o_9_report_cap",
    lambda spark, d: grouping.report_findings(found(spark, d))
    .groupBy("project", "total", "capped")
    .agg(F.count("*").alias("shown"), F.sum("line").alias("lines")),
    sql(
        """SELECT project, total, total > 2000 AS capped, count(*) AS shown, CAST(sum(line) AS BIGINT) AS lines
        FROM (SELECT *, count(*) OVER (PARTITION BY project) AS total, row_number() OVER (PARTITION BY project ORDER BY """
        + ORDER + """) AS position FROM findings) WHERE position <= 2000 GROUP BY ALL""",
        "findings",
    ),
)

# --- counts and scores ----------------------------------------------------------

register(
    "a_6_by_severity",
    lambda spark, d: fo.by_severity(found(spark, d)),
    sql("SELECT project, severity, count(*) AS n FROM findings GROUP BY ALL", "findings"),
)
register(
    "a_6_by_category",
    lambda spark, d: fo.by_category(found(spark, d)),
    sql("SELECT project, category, count(*) AS n FROM findings GROUP BY ALL", "findings"),
)


def _score(where: str) -> str:
    n = {s: f"count(*) FILTER ({where} AND severity = '{s}')" for s in fo.SEVERITIES}
    raw = (
        f"floor(100.0::DOUBLE / (1.0::DOUBLE + ({n['Critical']} * 15.0::DOUBLE + {n['High']} * 5.0::DOUBLE + {n['Medium']} * 1.0::DOUBLE"
        f" + {n['Low']} * 0.2::DOUBLE) / greatest(max(files_scanned), 1)) + 0.5::DOUBLE)"
    )
    return (
        f"CAST(CASE WHEN count(*) FILTER ({where}) = 0 THEN 100 ELSE greatest(CASE WHEN {n['Critical']} > 0 THEN least({raw}, 79) ELSE {raw} END, 1) END AS INTEGER)"
    )


def _grade(score: str) -> str:
    return f"CASE WHEN {score} >= 90 THEN 'A' WHEN {score} >= 80 THEN 'B' WHEN {score} >= 70 THEN 'C' WHEN {score} >= 60 THEN 'D' ELSE 'F' END"


define(
    "summary",
    f"""
SELECT *, {_grade('score')} AS grade, {_grade('security_score')} AS security_grade, {_grade('health_score')} AS health_grade FROM (
  SELECT project, max(files_scanned) AS files_scanned, count(*) AS total,
    {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in fo.SEVERITIES)},
    {_score('true')} AS score, {_score('is_sec')} AS security_score, {_score('NOT is_sec')} AS health_score,
    max(CASE WHEN is_sec THEN rank ELSE 0 END) AS worst,
    CAST(sum({case_table('severity', {'Critical': 60, 'High': 30, 'Medium': 15, 'Low': 5}, '10')}) AS BIGINT) AS effort_minutes,
    count(*) FILTER (category = 'Security') AS security_findings, count(*) FILTER (category = 'Performance') AS performance_findings
  FROM findings JOIN scanned USING (project) GROUP BY project)
""",
    "findings",
    "scanned",
)
for name, columns in (
    ("a_8_density_score", "project, files_scanned, total, critical, high, medium, low, score, grade"),
    ("a_9_security_and_health_score", "project, security_score, security_grade, health_score, health_grade"),
):
    register(
        name,
        lambda spark, d, columns=columns: summary(spark, d).select(*columns.split(", ")),
        sql(f"SELECT {columns} FROM summary", "summary"),
    )
register(
    "a_10_security_rating",
    lambda spark, d: summary(spark, d).select("project", "security_rating", "rating_basis"),
    sql(
        """SELECT project, CASE worst WHEN 4 THEN 'E' WHEN 3 THEN 'D' WHEN 2 THEN 'C' WHEN 1 THEN 'B' ELSE 'A' END AS security_rating,
          CASE worst WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'none' END AS rating_basis FROM summary""",
        "summary",
    ),
)
register(
    "a_11_gate_count",
    lambda spark, d: fo.gate(found(spark, d), scanned(spark, d), "high"),
    sql(
        "SELECT project, 'high' AS threshold, count(*) FILTER (rank >= 3) AS fail_count, count(*) FILTER (rank >= 3) = 0 AS passed FROM findings GROUP BY project",
        "findings",
    ),
)
_HM = "'~' || (effort_minutes // 60) || 'h'"
EFFORT = f"""CASE WHEN effort_minutes <= 0 THEN 'none' WHEN effort_minutes < 60 THEN '~' || effort_minutes || 'm'
  WHEN effort_minutes % 60 = 0 THEN {_HM} ELSE {_HM} || ' ' || (effort_minutes % 60) || 'm' END"""
register(
    "a_12_remediation_effort",
    lambda spark, d: summary(spark, d).select("project", "effort_minutes"),
    sql("SELECT project, effort_minutes FROM summary", "summary"),
)
register(
    "x_14_effort_text",
    lambda spark, d: _count(
        found(spark, d)
        .groupBy("file", "line")
        .agg(F.sum(severity.effort_minutes(F.col("severity"))).alias("effort_minutes"))
        .withColumn("effort_text", severity.effort_text(F.col("effort_minutes"))),
        "effort_minutes", "effort_text",
    ),
    sql(
        f"""SELECT effort_minutes, {EFFORT} AS effort_text, count(*) AS n FROM (
          SELECT file, line, CAST(sum({case_table('severity', {'Critical': 60, 'High': 30, 'Medium': 15, 'Low': 5}, '10')}) AS BIGINT) AS effort_minutes
          FROM findings GROUP BY ALL) GROUP BY ALL""",
        "findings",
    ),
)
_CVSS = case_table("severity", severity.CVSS, "'0.0'")
register(
    "a_13_indicative_cvss",
    lambda spark, d: _count(found(spark, d).withColumn("cvss", severity.cvss(F.col("severity"))), "severity", "cvss"),
    sql(f"SELECT severity, {_CVSS} AS cvss, count(*) AS n FROM findings GROUP BY ALL", "findings"),
)
register(
    "x_20_sarif_level",
    lambda spark, d: _count(
        found(spark, d)
        .withColumn("level", severity.sarif_level(F.col("severity")))
        .withColumn("security_severity", severity.sarif_security_severity(F.col("severity"))),
        "severity", "level", "security_severity",
    ),
    sql(
        """SELECT severity, CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' ELSE 'note' END AS level,
          CASE severity WHEN 'Critical' THEN '9.5' WHEN 'High' THEN '8.0' WHEN 'Medium' THEN '5.0' ELSE '2.0' END AS security_severity, count(*) AS n
        FROM findings GROUP BY ALL""",
        "findings",
    ),
)
register(
    "a_21_report_counters",
    lambda spark, d: grouping.report_counters(found(spark, d)).withColumn("categories", F.array_join("categories", ",")),
    sql(
        """SELECT project, count(*) FILTER (severity IN ('Critical', 'High')) AS critical_and_high, count(*) FILTER (category = 'Security') AS security_findings,
          count(*) FILTER (category = 'Performance') AS performance_findings, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
        FROM findings GROUP BY project""",
        "findings",
    ),
)
register(
    "a_21_severity_summary",
    lambda spark, d: grouping.severity_summary(found(spark, d)),
    sql(
        """SELECT project, severity, count(*) AS n, CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END AS position
        FROM findings WHERE rank > 0 GROUP BY ALL""",
        "findings",
    ),
)

# --- groups ---------------------------------------------------------------------

define(
    "finding_groups",
    f"""
SELECT project, rule_id, count(*) AS count, max(rank) AS rank, min(CASE WHEN pos = 1 THEN title END) AS title,
  min(CASE WHEN pos = 1 THEN category END) AS category, min(CASE WHEN pos = 1 THEN explanation END) AS explanation,
  min(CASE WHEN pos = 1 THEN cwe END) AS cwe, min(CASE WHEN pos = 1 THEN owasp END) AS owasp,
  greatest(count(*) - 100, 0) AS extra_count, min(struct_pack(r := -rank, f := file, l := line, p := phase, o := ord)) AS first_order
FROM (SELECT *, row_number() OVER (PARTITION BY project, rule_id ORDER BY {ORDER}) AS pos FROM enriched) GROUP BY project, rule_id
""",
    "enriched",
)
_SEV = "CASE rank WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE '' END"


def groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.finding_groups(enriched(spark, d))


register(
    "a_17_finding_groups",
    lambda spark, d: groups(spark, d).select(
        "project", "group_key", "severity", "cvss", "category", "title", "cwe", "owasp", "explanation", "fix_example", "count", "extra_count"
    ),
    sql(
        f"""SELECT g.project, g.rule_id AS group_key, {_SEV} AS severity, CASE rank WHEN 4 THEN '9.5' WHEN 3 THEN '8.0' WHEN 2 THEN '5.0' WHEN 1 THEN '2.0' ELSE '0.0' END AS cvss,
          g.category, g.title, g.cwe, g.owasp, g.explanation, coalesce(a.fix_example, b.fix_example, '') AS fix_example, g.count, g.extra_count
        FROM finding_groups g LEFT JOIN rem_cwe a ON a.cwe = g.cwe LEFT JOIN rem_category b ON b.category = g.category""",
        "finding_groups", "rem_cwe", "rem_category",
    ),
)
register(
    "a_17_group_occurrences",
    lambda spark, d: grouping.occurrences(found(spark, d)),
    sql(
        f"""SELECT project, rule_id AS group_key, CAST(position AS INTEGER) AS position, file || ':' || line AS location, snippet
        FROM (SELECT *, row_number() OVER (PARTITION BY project, rule_id ORDER BY {ORDER}) AS position FROM findings) WHERE position <= 100""",
        "findings",
    ),
)
_GROUP_ORDER = "rank DESC, count DESC, first_order"
register(
    "o_6_finding_group_order",
    lambda spark, d: grouping.numbered(groups(spark, d), ["project"], grouping.group_order()).select(
        "project", "position", "group_key", "severity", "count"
    ),
    sql(
        f"""SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY {_GROUP_ORDER}) AS INTEGER) AS position, rule_id AS group_key, {_SEV} AS severity, count
        FROM finding_groups""",
        "finding_groups",
    ),
)
register(
    "o_7_fix_first",
    lambda spark, d: grouping.priorities(groups(spark, d)).select("project", "position", "group_key", "severity", "count"),
    sql(
        f"""SELECT project, CAST(position AS INTEGER) AS position, rule_id AS group_key, {_SEV} AS severity, count FROM (
          SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_GROUP_ORDER}) AS position FROM finding_groups WHERE rank >= 3) WHERE position <= 6""",
        "finding_groups",
    ),
)
register(
    "x_13_links",
    lambda spark, d: _count(
        enriched(spark, d).select(
            "cwe", paths.cwe_link(F.col("cwe")).alias("cwe_link"), paths.owasp_link(F.col("owasp")).alias("owasp_link"),
            paths.editor_link(F.lit("/srv/my app/"), F.col("file"), F.col("line")).alias("link"),
        ),
        "cwe", "cwe_link", "owasp_link", "link",
    ),
    sql(
        """SELECT cwe, CASE WHEN starts_with(cwe, 'CWE-') THEN 'https://cwe.mitre.org/data/definitions/' || substr(cwe, 5) || '.html' ELSE '' END AS cwe_link,
          CASE WHEN owasp = '' THEN '' ELSE 'https://owasp.org/Top10/' || replace(string_split(owasp, ' ')[1], ':', '_') || '-'
            || replace(substr(owasp, instr(owasp, ' ') + 1), ' ', '_') || '/' END AS owasp_link,
          'vscode://file//srv/my%20app/' || file || CASE WHEN line > 0 THEN ':' || line ELSE '' END AS link, count(*) AS n
        FROM enriched GROUP BY ALL""",
        "enriched",
    ),
)
register(
    "x_2_fingerprint",
    lambda spark, d: _count(fo.fingerprinted(found(spark, d)), "fingerprint"),
    sql(f"SELECT {FINGERPRINT} AS fingerprint, count(*) AS n FROM findings GROUP BY ALL", "findings"),
)

# --- set operations ---------------------------------------------------------------


def external(spark: SparkSession, d: str) -> DataFrame:
    from faultlens.sources import scanners

    return scanners.bandit_findings(corpora.scanner_reports(spark, d, "bandit"))


register(
    "u_1_merge_external",
    lambda spark, d: _count(fo.merge(found(spark, d), external(spark, d)), "severity", "category"),
    sql(
        """SELECT severity, category, count(*) AS n FROM (
          SELECT severity, category FROM findings UNION ALL
          SELECT CASE upper(json_extract_string(r, '$.issue_severity')) WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' ELSE 'Low' END, 'Security'
          FROM (SELECT unnest(CAST(json_extract(substr(payload, instr(payload, '{')), '$.results') AS JSON[])) AS r FROM bandit_reports)) GROUP BY ALL""",
        "findings", "bandit_reports",
    ),
)
register(
    "u_3_fingerprint_distinct",
    lambda spark, d: _count(baselines.baseline_of(found(spark, d)), "project"),
    sql(f"SELECT project, count(DISTINCT {FINGERPRINT}) AS n FROM findings GROUP BY project", "findings"),
)

define(
    "problems",
    f"""
SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY src, rnk) AS INTEGER) AS position FROM (
  SELECT project, 0 AS src, rnk, 'static' AS source, severity, category, title, file || ':' || line AS location, explanation AS detail,
    recommendation, '' AS cause, cwe, CAST(0 AS BIGINT) AS count
  FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {ORDER}) AS rnk FROM enriched)
  UNION ALL
  SELECT project, 1, row_number() OVER (PARTITION BY project ORDER BY count DESC, last_seen DESC, type, file, line), 'runtime',
    CASE severity WHEN 'fatal' THEN 'Critical' WHEN 'error' THEN 'High' ELSE 'Medium' END, 'Runtime', type,
    CASE WHEN line > 0 THEN file || ':' || line ELSE file END, last_message, '', '', '', count
  FROM runtime_groups_by_project
  UNION ALL
  SELECT project, 2, row_number() OVER (PARTITION BY project ORDER BY count DESC, signature), 'log',
    CASE WHEN level IN ('EMERGENCY','ALERT','CRITICAL','FATAL') THEN 'Critical' WHEN level IN ('ERROR','EXCEPTION') THEN 'High' WHEN level = 'WARNING' THEN 'Medium' ELSE 'Low' END,
    category, sample, '', sample, '', cause, '', count
  FROM log_groups_by_project)
""",
    "enriched",
    "runtime_groups_by_project",
    "log_groups_by_project",
)


def problems(spark: SparkSession, d: str) -> DataFrame:
    runtime = errorgroups.runtime_groups(events.parse_events(corpora.runtime_json(spark, d)), ["project"])
    logs = loggroups.log_groups(corpora.log_lines(spark, d), ["project"])
    return insights.problem_list(enriched(spark, d), runtime, logs)


_PROBLEM = "project, source, severity, category, title, location, detail, recommendation, cause, cwe, count"
register("u_2_problem_list", lambda spark, d: problems(spark, d).drop("newest", "place"), sql(f"SELECT {_PROBLEM} FROM problems", "problems"))
define(
    "insights",
    """
SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY
  CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, count DESC, position) AS INTEGER) AS insight
FROM problems QUALIFY insight <= 12
""",
    "problems",
)
register(
    "o_10_insight_ranking",
    lambda spark, d: insights.priority_lines(insights.insights(problems(spark, d))),
    sql("SELECT project, insight, '[' || severity || '] ' || title AS priority FROM insights WHERE insight <= 5", "insights"),
)
_IMPACT = """CASE lower(severity) WHEN 'critical' THEN 'Critical — can cause outages, data loss, or a security breach if unaddressed.'
  WHEN 'high' THEN 'High — significant risk to stability, security, or correctness.'
  WHEN 'medium' THEN 'Medium — degrades performance or quality, or creates latent risk.'
  WHEN 'low' THEN 'Low — minor issue or best-practice deviation.' ELSE 'Unclassified.' END"""
register(
    "x_19_insight_texts",
    lambda spark, d: insights.insights(problems(spark, d)).select(
        "project", "insight", "problem", "root_cause", "impact", "suggestion", "complexity", "effort"
    ),
    sql(
        f"""SELECT i.project, i.insight,
          title || CASE WHEN location <> '' THEN ' (' || location || ')' ELSE '' END || CASE WHEN count > 1 THEN ' — observed ' || count || ' times' ELSE '' END AS problem,
          CASE WHEN cause <> '' THEN cause WHEN detail <> '' THEN detail ELSE 'Not determined from the available findings.' END AS root_cause,
          {_IMPACT} AS impact,
          CASE WHEN recommendation <> '' THEN recommendation ELSE 'Investigate the finding at its location and address the underlying condition.' END AS suggestion,
          coalesce(a.complexity, b.complexity, 'Medium') AS complexity, coalesce(a.effort, b.effort, 'varies') AS effort
        FROM insights i LEFT JOIN rem_cwe a ON a.cwe = i.cwe LEFT JOIN rem_category b ON b.category = i.category""",
        "insights", "rem_cwe", "rem_category",
    ),
)


def summaries(spark: SparkSession, d: str) -> DataFrame:
    listed = problems(spark, d)
    stack = listed.groupBy("project").agg(F.sort_array(F.collect_set("source")).alias("names"))
    return insights.local_summary(listed, stack)


register(
    "a_25_local_summary",
    summaries,
    sql(
        """SELECT project, 'Analyzed ' || project || ' (' || array_to_string(list_sort(list(DISTINCT source)), ', ') || '). Collected ' || count(*) || ' finding(s): '
          || count(*) FILTER (severity = 'Critical') || ' critical, ' || count(*) FILTER (severity = 'High') || ' high, '
          || count(*) FILTER (severity = 'Medium') || ' medium, ' || count(*) FILTER (severity = 'Low')
          || ' low, spanning static analysis, runtime errors, and logs. The most pressing items are listed below; explanations restate the detected findings without adding unverified conclusions.' AS summary
        FROM problems GROUP BY project""",
        "problems",
    ),
)

# --- diff -------------------------------------------------------------------------

register(
    "w_3_diff_current_file",
    lambda spark, d: diffscope.tagged_headers(corpora.diff_lines(spark, d)).select("project", "line_no", "file"),
    sql("SELECT project, line_no, file FROM diff_tagged", "diff_tagged"),
)
register(
    "x_18_hunk_header",
    lambda spark, d: diffscope.changed_lines(corpora.diff_lines(spark, d))[1],
    sql('SELECT project, file, start, "end" FROM diff_ranges', "diff_ranges"),
)
register(
    "x_17_path_normalise",
    lambda spark, d: _count(
        corpora.diff_lines(spark, d)
        .where(F.col("text").startswith("+++ b/"))
        .select(
            F.expr("substring(text, 7)").alias("raw"),
            paths.normalise(F.expr("substring(text, 7)")).alias("clean"),
            paths.relative_to(F.concat(F.lit("/srv/app/"), F.expr("substring(text, 7)")), F.lit("/srv/app")).alias("relative"),
        ),
        "raw", "clean", "relative",
    ),
    sql(
        r"""SELECT raw, regexp_replace(raw, '^\./', '') AS clean, raw AS relative, count(*) AS n
        FROM (SELECT substr(text, 7) AS raw FROM diff_lines WHERE starts_with(text, '+++ b/')) GROUP BY ALL""",
        "diff_lines",
    ),
)

# --- baseline and exports -----------------------------------------------------------


def baseline_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "baseline")
    baselines.write_baseline(found(spark, d), path)
    return baselines.read_baseline(spark, path).groupBy("project").agg(
        F.count("*").alias("n"), F.min("fingerprint").alias("first"), F.max("fingerprint").alias("last")
    )


register(
    "s_12_baseline",
    baseline_round_trip,
    sql(
        f"""SELECT project, count(*) AS n, min(f) AS first, max(f) AS last FROM (SELECT DISTINCT project, {FINGERPRINT} AS f FROM findings) GROUP BY project""",
        "findings",
    ),
)


def _json_text(*fields: tuple[str, str]) -> str:
    """A JSON object of the fields; those marked with ? are left out when empty."""
    parts = []
    for name, value in fields:
        key = f"""',"{name.rstrip('?')}":' || {value if value.startswith("'") else f"to_json({value})"}"""
        parts.append(f"CASE WHEN {value} <> '' THEN {key} ELSE '' END" if name.endswith("?") else key)
    return "'{' || substr(" + " || ".join(parts) + ", 2) || '}'"


_FINDING_JSON = _json_text(
    ("rule", "rule_id"), ("severity", "severity"), ("cvss", case_table("severity", severity.CVSS, "'0.0'")), ("category", "category"),
    ("title", "title"), ("file", "file"), ("line", "line"), ("snippet?", "snippet"), ("explanation?", "explanation"),
    ("recommendation?", "recommendation"), ("cwe?", "cwe"), ("owasp?", "owasp"),
)
register(
    "s_13_json_export",
    # The time of the export is the only part that differs from run to run.
    lambda spark, d: exports.json_rows(enriched(spark, d), summary(spark, d)).withColumn(
        "text", F.regexp_replace("text", '"generated_at":"[^"]*"', '"generated_at":""')
    ),
    sql(
        f"""SELECT project, 1 AS part, {_FINDING_JSON} AS text FROM enriched UNION ALL
        SELECT project, 0, '{{"project":' || to_json(project) || ',"generated_at":"","security_score":{{"value":' || security_score || ',"grade":"' || security_grade
          || '"}},"code_health_score":{{"value":' || health_score || ',"grade":"' || health_grade || '"}},"summary":{{"total":' || total || ',"critical":' || critical
          || ',"high":' || high || ',"medium":' || medium || ',"low":' || low || ',"remediation_effort_minutes":' || effort_minutes || '}}}}' FROM summary""",
        "summary", "enriched",
    ),
)


def csv_export(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    exports.write_csv(enriched(spark, d), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.groupBy("Severity", "CWE", "File").agg(F.count("*").alias("n"), F.sum(F.col("Line").cast("int")).alias("lines"))


register(
    "s_14_csv_export",
    csv_export,
    sql(
        """SELECT severity AS "Severity", nullif(cwe, '') AS "CWE", file AS "File", count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM enriched GROUP BY ALL""",
        "enriched",
    ),
)
_LEVEL = case_table("severity", {"Critical": "error", "High": "error", "Medium": "warning"}, "'note'")
_RISK = case_table("severity", {"Critical": "9.5", "High": "8.0", "Medium": "5.0"}, "'2.0'")
register(
    "s_15_sarif_export",
    lambda spark, d: exports.sarif_rows(enriched(spark, d)),
    sql(
        f"""SELECT project, 1 AS part, '{{"ruleId":' || to_json(rule_id) || ',"level":"' || {_LEVEL} || '","message":{{"text":' || to_json(title || ' — ' || recommendation)
          || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(replace(file, chr(92), '/')) || '}}'
          || CASE WHEN line > 0 THEN ',"region":{{"startLine":' || line || '}}' ELSE '' END || '}}}}]}}' AS text FROM enriched
        UNION ALL
        SELECT project, 0, '{{"id":' || to_json(rule_id) || ',"name":' || to_json(title) || ',"shortDescription":{{"text":' || to_json(title)
          || '}},"fullDescription":{{"text":' || to_json(explanation) || '}},"help":{{"text":' || to_json(recommendation) || '}},"properties":{{"tags":['
          || array_to_string(list_filter([to_json(category), CASE WHEN cwe <> '' THEN to_json(cwe) END, CASE WHEN owasp <> '' THEN to_json('OWASP ' || owasp) END], lambda x: x IS NOT NULL), ',')
          || '],"security-severity":"' || {_RISK} || '"}}}}'
        FROM (SELECT *, row_number() OVER (PARTITION BY project, rule_id ORDER BY {ORDER}) AS place FROM enriched) WHERE place = 1""",
        "enriched",
    ),
)


def attestation(spark: SparkSession, d: str) -> DataFrame:
    files, _ = diffscope.changed_lines(corpora.diff_lines(spark, d))
    rows = changed(spark, d)
    gate = fo.gate(rows, scanned(spark, d), "high")
    docs = exports.attestations(rows, scanned(spark, d), "diff", gate, files)
    get = lambda path, kind: F.get_json_object("document", path).cast(kind)
    return docs.select(
        "project",
        F.get_json_object("document", "$.scope").alias("scope"),
        get("$.total_findings", "long").alias("total_findings"),
        get("$.findings.High", "long").alias("high"),
        get("$.files_changed", "long").alias("files_changed"),
        get("$.gate.fail_count", "long").alias("fail_count"),
        get("$.gate.passed", "boolean").alias("passed"),
    )


register(
    "s_16_attestation",
    attestation,
    sql(
        """SELECT p.project, 'diff' AS scope, coalesce(c.n, 0) AS total_findings, nullif(c.high, 0) AS high, d.n AS files_changed,
          coalesce(c.bad, 0) AS fail_count, coalesce(c.bad, 0) = 0 AS passed
        FROM (SELECT DISTINCT project FROM findings) p LEFT JOIN (SELECT project, count(*) AS n FROM diff_files GROUP BY project) d USING (project)
        LEFT JOIN (SELECT project, count(*) AS n, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (rank >= 3) AS bad FROM findings f
          WHERE EXISTS (SELECT 1 FROM diff_files c WHERE c.project = f.project AND c.file = f.file)
            AND (line <= 0 OR EXISTS (SELECT 1 FROM diff_ranges r WHERE r.project = f.project AND r.file = f.file AND f.line BETWEEN r.start AND r."end"))
          GROUP BY project) c USING (project)""",
        "findings", "diff_files", "diff_ranges",
    ),
)
register(
    "a_22_notification_row",
    lambda spark, d: exports.notification_rows(found(spark, d), summary(spark, d)).withColumn(
        "top_issues", F.array_join("top_issues", "\n")
    ),
    sql(
        """SELECT s.project, security_score, security_grade, health_score, health_grade, total, critical, high, medium, low, t.top_issues
        FROM summary s JOIN (SELECT project, string_agg('[' || severity || '] ' || title || ' — ' || file || ':' || line, chr(10) ORDER BY position) AS top_issues
          FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY """ + ORDER + """) AS position FROM findings) WHERE position <= 5 GROUP BY project) t USING (project)""",
        "summary", "findings",
    ),
)

# --- history ------------------------------------------------------------------------


def scans(spark: SparkSession, d: str) -> DataFrame:
    return corpora.scan_history(spark, d)


def history_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to the history table and the newest record per path."""
    path = scratch_dir(spark, "history")
    rows = scans(spark, d)
    for half in (F.col("total") % 2 == 0, F.col("total") % 2 == 1):
        history.append_records(rows.where(half), path)
    back = history.read_history(spark, path)
    return back.groupBy("path").agg(
        F.count("*").alias("scans"), F.max_by("total", F.struct("created_at", "id")).alias("latest_total")
    )


register(
    "s_17_scan_history",
    history_round_trip,
    sql("SELECT path, count(*) AS scans, arg_max(total, created_at || '|' || id) AS latest_total FROM scan_history GROUP BY path", "scan_history"),
)


def appended(spark: SparkSession, d: str) -> str:
    """The history appended in three batches, one after the other in time."""
    path = scratch_dir(spark, "appended")
    rows = scans(spark, d)
    year = F.substring("created_at", 1, 4)
    for batch, part in enumerate((year < "1994", (year >= "1994") & (year < "1997"), year >= "1997")):
        history.append_scans(rows.where(part), path, batch)
    return path


register(
    "w_6_appended_new_since",
    lambda spark, d: history.appended_scans(spark, appended(spark, d)).select("id", "path", "total", "new_since"),
    sql(
        """SELECT id, path, total, coalesce(greatest(total - prev, 0), 0) AS new_since
        FROM (SELECT *, lag(total) OVER (PARTITION BY path ORDER BY created_at, id) AS prev FROM scan_history)""",
        "scan_history",
    ),
)
register(
    "w_7_kept_scans",
    lambda spark, d: history.kept_scans(spark, appended(spark, d)),
    sql(
        """SELECT path, scans, total, prev AS previous_total, coalesce(greatest(total - prev, 0), 0) AS new_since,
          security_score AS last_score, security_grade AS last_grade
        FROM (SELECT *, lag(total) OVER w AS prev, lead(total) OVER w AS next, count(*) OVER (PARTITION BY path) AS scans
          FROM scan_history WINDOW w AS (PARTITION BY path ORDER BY created_at, id)) WHERE next IS NULL""",
        "scan_history",
    ),
)
register(
    "w_6_new_since_replay",
    lambda spark, d: history.replay_new_since(scans(spark, d)).select("id", "path", "total", "previous_total", "new_since"),
    sql(
        """SELECT id, path, total, prev AS previous_total, coalesce(greatest(total - prev, 0), 0) AS new_since
        FROM (SELECT *, lag(total) OVER (PARTITION BY path ORDER BY created_at, id) AS prev FROM scan_history)""",
        "scan_history",
    ),
)
register(
    "w_6_new_since_last",
    lambda spark, d: history.latest_two(scans(spark, d)),
    sql(
        """SELECT path, total, prev AS previous_total, coalesce(greatest(total - prev, 0), 0) AS new_since
        FROM (SELECT *, lag(total) OVER w AS prev, lead(total) OVER w AS next FROM scan_history WINDOW w AS (PARTITION BY path ORDER BY created_at, id)) WHERE next IS NULL""",
        "scan_history",
    ),
)
register(
    "w_7_score_trend",
    lambda spark, d: history.score_trend(scans(spark, d)),
    sql(
        """SELECT path, created_at, id, security_score, scans, last_score, last_grade FROM scan_history JOIN (
          SELECT path, count(*) AS scans, arg_max(security_score, created_at || '|' || id) AS last_score, arg_max(security_grade, created_at || '|' || id) AS last_grade
          FROM scan_history GROUP BY path HAVING count(*) >= 2) USING (path)""",
        "scan_history",
    ),
)
register(
    "o_12_scan_list",
    lambda spark, d: history.newest_first(scans(spark, d)).select("id", "created_at", "total"),
    sql("SELECT id, created_at, total FROM scan_history ORDER BY created_at DESC, id", "scan_history"),
)
