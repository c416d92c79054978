"""Queries on external scanner reports and lock files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.plans import corpora
from faultlens.plans.catalog import register
from faultlens.plans.corpora_sql import define, sql
from faultlens.sources import lockfiles, scanners

_OUT = ("project", "rule_id", "severity", "category", "title", "file", "line", "snippet", "explanation", "cwe", "owasp")


def _engine(name: str):
    return lambda spark, d: scanners.ENGINES[name](corpora.scanner_reports(spark, d, name)).select(*_OUT)


def _s(path: str) -> str:
    return f"coalesce(json_extract_string(r, '$.{path}'), '')"


_CWE_TEXT = "CASE WHEN json_type(r, '$.extra.metadata.cwe') = 'ARRAY' THEN json_extract_string(r, '$.extra.metadata.cwe[0]') ELSE " + _s("extra.metadata.cwe") + " END"
_OWASP_TEXT = _s("extra.metadata.owasp")
_LEVEL = "CASE upper({0}) WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' ELSE 'Low' END"
define(
    "semgrep_rows",
    "SELECT project, unnest(CAST(json_extract(payload, '$.results') AS JSON[])) AS r FROM semgrep_reports",
    "semgrep_reports",
)
register(
    "s_7_semgrep",
    _engine("semgrep"),
    sql(
        f"""SELECT project, 'SEMGREP:' || CASE WHEN ends_with({_s('check_id')}, '.') THEN {_s('check_id')} ELSE string_split({_s('check_id')}, '.')[-1] END AS rule_id,
          CASE upper({_s('extra.severity')}) WHEN 'ERROR' THEN 'High' WHEN 'WARNING' THEN 'Medium' ELSE 'Low' END AS severity,
          CASE {_s('extra.metadata.category')} WHEN 'performance' THEN 'Performance' WHEN 'correctness' THEN 'Error Handling' WHEN 'best-practice' THEN 'Error Handling' ELSE 'Security' END AS category,
          string_split({_s('extra.message')}, chr(10))[1] AS title, {_s('path')} AS file, CAST(json_extract(r, '$.start.line') AS INTEGER) AS line,
          trim(string_split({_s('extra.lines')}, chr(10))[1]) AS snippet, {_s('extra.message')} AS explanation,
          trim(CASE WHEN starts_with({_CWE_TEXT}, 'CWE-') AND contains({_CWE_TEXT}, ':') THEN string_split({_CWE_TEXT}, ':')[1] ELSE {_CWE_TEXT} END) AS cwe,
          {_OWASP_TEXT} AS owasp
        FROM semgrep_rows""",
        "semgrep_rows",
    ),
)
define(
    "bandit_rows",
    "SELECT project, unnest(CAST(json_extract(substr(payload, instr(payload, '{')), '$.results') AS JSON[])) AS r FROM bandit_reports",
    "bandit_reports",
)


def _relative(path: str) -> str:
    return f"CASE WHEN starts_with({path}, '/srv/app/') THEN substr({path}, 10) ELSE {path} END"


register(
    "s_8_bandit",
    _engine("bandit"),
    sql(
        f"""SELECT project, 'BANDIT:' || {_s('test_id')} AS rule_id, {_LEVEL.format(_s('issue_severity'))} AS severity, 'Security' AS category,
          trim(replace({_s('issue_text')}, chr(10), ' ')) AS title, {_relative(_s('filename'))} AS file, CAST(json_extract(r, '$.line_number') AS INTEGER) AS line,
          coalesce(nullif(regexp_extract({_s('code')}, '(?m)^' || json_extract_string(r, '$.line_number') || ' (.*)$', 1), ''), regexp_extract({_s('code')}, '^[0-9]+ (.*)', 1)) AS snippet,
          {_s('issue_text')} AS explanation, CASE WHEN {_s('issue_cwe.id')} <> '' THEN 'CWE-' || {_s('issue_cwe.id')} ELSE '' END AS cwe, '' AS owasp
        FROM bandit_rows""",
        "bandit_rows",
    ),
)
define(
    "gosec_rows",
    "SELECT project, unnest(CAST(json_extract(payload, '$.Issues') AS JSON[])) AS r FROM gosec_reports",
    "gosec_reports",
)
register(
    "s_9_gosec",
    _engine("gosec"),
    sql(
        f"""SELECT project, 'GOSEC:' || {_s('rule_id')} AS rule_id, {_LEVEL.format(_s('severity'))} AS severity, 'Security' AS category, {_s('details')} AS title,
          {_relative(_s('file'))} AS file, coalesce(TRY_CAST(string_split({_s('line')}, '-')[1] AS INTEGER), 0) AS line, trim({_s('code')}) AS snippet,
          {_s('details')} AS explanation, CASE WHEN {_s('cwe.id')} <> '' THEN 'CWE-' || {_s('cwe.id')} ELSE '' END AS cwe, '' AS owasp
        FROM gosec_rows""",
        "gosec_rows",
    ),
)
define(
    "eslint_rows",
    """SELECT project, json_extract_string(f, '$.filePath') AS path, unnest(CAST(json_extract(f, '$.messages') AS JSON[])) AS r
    FROM (SELECT project, unnest(CAST(CAST(payload AS JSON) AS JSON[])) AS f FROM eslint_reports)""",
    "eslint_reports",
)
register(
    "s_10_eslint",
    _engine("eslint"),
    sql(
        f"""SELECT project, 'ESLINT:' || coalesce(nullif({_s('ruleId')}, ''), 'parse-error') AS rule_id,
          CASE WHEN CAST(json_extract(r, '$.severity') AS INTEGER) >= 2 THEN 'Medium' ELSE 'Low' END AS severity, 'Error Handling' AS category, {_s('message')} AS title,
          {_relative('path')} AS file, CAST(json_extract(r, '$.line') AS INTEGER) AS line, '' AS snippet, {_s('message')} AS explanation, '' AS cwe, '' AS owasp
        FROM eslint_rows""",
        "eslint_rows",
    ),
)
define(
    "phpstan_rows",
    """SELECT project, path, unnest(CAST(json_extract(doc, '$."' || path || '".messages') AS JSON[])) AS r
    FROM (SELECT project, doc, unnest(json_keys(doc)) AS path FROM (SELECT project, json_extract(payload, '$.files') AS doc FROM phpstan_reports))""",
    "phpstan_reports",
)
register(
    "s_11_phpstan",
    _engine("phpstan"),
    sql(
        f"""SELECT project, 'PHPSTAN:' || coalesce(nullif({_s('identifier')}, ''), 'error') AS rule_id, 'Medium' AS severity, 'Error Handling' AS category, {_s('message')} AS title,
          {_relative('path')} AS file, CAST(json_extract(r, '$.line') AS INTEGER) AS line, '' AS snippet, {_s('message')} AS explanation, '' AS cwe, '' AS owasp
        FROM phpstan_rows""",
        "phpstan_rows",
    ),
)


def long_documents(spark: SparkSession, d: str) -> DataFrame:
    """One report of 950 to 1049 results per supplier."""
    suppliers = corpora.spread(corpora.table(spark, d, "supplier").select("s_suppkey"))
    s = F.col("s_suppkey")
    one = F.transform(
        F.sequence(F.lit(1).cast("long"), s % 100 + 950),
        lambda i: F.concat(
            F.lit('{"test_id": "B'), (i % 7).cast("string"), F.lit('", "issue_severity": "HIGH", "line_number": '),
            i.cast("string"), F.lit("}"),
        ),
    )
    return suppliers.select(
        F.concat(F.lit("s"), s.cast("string")).alias("project"),
        F.lit("").alias("root"),
        F.concat(F.lit('{"results": ['), F.array_join(one, ","), F.lit("]}")).alias("payload"),
    )


register(
    "w_9_long_reports",
    lambda spark, d: scanners.bandit_findings(long_documents(spark, d))
    .groupBy("project", "rule_id")
    .agg(F.count("*").alias("n"), F.max("line").alias("last_line")),
    """SELECT 's' || s_suppkey AS project, 'BANDIT:B' || (i % 7) AS rule_id, count(*) AS n, CAST(max(i) AS INTEGER) AS last_line
    FROM (SELECT s_suppkey, unnest(generate_series(1, s_suppkey % 100 + 950)) AS i FROM supplier) GROUP BY ALL""",
)
register(
    "s_6_lock_files",
    lambda spark, d: lockfiles.dependencies(corpora.manifest_files(spark, d)),
    sql(
        r"""SELECT project, path AS source, 'Packagist' AS ecosystem, json_extract_string(p, '$.name') AS name, json_extract_string(p, '$.version') AS version
        FROM (SELECT project, path, unnest(list_concat(CAST(json_extract(content, '$.packages') AS JSON[]), CAST(json_extract(content, '$."packages-dev"') AS JSON[]))) AS p
              FROM manifest_files WHERE path = 'composer.lock')
        UNION ALL
        SELECT project, path, 'PyPI', string_split(ln, '==')[1], string_split(ln, '==')[2]
        FROM (SELECT project, path, unnest(string_split(content, chr(10))) AS ln FROM manifest_files WHERE path = 'requirements.txt') WHERE contains(ln, '==')""",
        "manifest_files",
    ),
)
