"""One query per detection rule, over the source, config and manifest corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import text as ft
from faultlens.operators import codelines, configscan, dependencies, detect, manifests
from faultlens.operators import findings as fo
from faultlens.operators import rulebook as rb
from faultlens.plans import corpora
from faultlens.plans.catalog import register
from faultlens.plans.corpora_sql import (
    config_query, contains_any, in_vendored, matches, placeholder, rule_query, sql, starts_with_any, text, trim,
)

_OUT = ("project", "file", "line", "severity", "snippet")


def code_files(spark: SparkSession, d: str) -> DataFrame:
    return codelines.code_files(codelines.analysed_paths(corpora.source_files(spark, d)))


def _code_rules(*rules: rb.Rule):
    return lambda spark, d: detect.code_findings(code_files(spark, d), rules).select(*_OUT)


def _config_rules(rule: rb.Rule):
    return lambda spark, d: configscan.config_findings(corpora.config_files(spark, d), [rule]).select(*_OUT)


for i, rule in enumerate(rb.LINE_RULES, 1):
    register(f"r_{i}_{rule.rule_id.lower()}", _code_rules(rule), sql(rule_query(rule), "rule_lines"))

register(
    "r_s_sec_token",
    _code_rules(*rb.TOKEN_RULES),
    sql("\nUNION ALL\n".join(rule_query(r) for r in rb.TOKEN_RULES), "rule_lines"),
)
for key, rule in (
    ("c", rb.CREDENTIAL_RULE), ("q", rb.RAW_SQL_RULE), ("x", rb.XSS_RULE), ("n", rb.NULL_CHAIN_RULE), ("e", rb.EMPTY_CATCH_RULE),
):
    register(f"r_{key}_{rule.rule_id.lower()}", _code_rules(rule), sql(rule_query(rule), "rule_lines"))

for i, rule in enumerate(rb.CONFIG_RULES, 1):
    register(f"i_{i}_{rule.rule_id.lower()}", _config_rules(rule), sql(config_query(rule), "config_lines"))


#: Vendored directories below others, which the path filter must find as well.
_BELOW = ("api/vendor/x/", "lib/Third_Party/")


def nested_manifests(spark: SparkSession, d: str) -> DataFrame:
    """The manifests, and each of them once more in vendored directories further down."""
    files = corpora.manifest_files(spark, d)
    where = F.explode(F.array(F.lit(""), *[F.lit(b) for b in _BELOW]))
    return files.withColumn("_below", where).withColumn("path", F.concat("_below", "path")).drop("_below")


_NESTED = "(SELECT project, unnest(['', {}]) || path AS path, content FROM manifest_files)".format(", ".join(map(text, _BELOW)))


def _manifest_rule(rule: rb.Rule):
    return lambda spark, d: (
        manifests.manifest_findings(codelines.analysed_paths(nested_manifests(spark, d)))
        .where(F.col("rule_id") == rule.rule_id)
        .select(*_OUT, "explanation")
    )


def _line_of(found: str) -> str:
    return f"CAST(len(string_split(left(content, instr(content, {found}) - 1), chr(10))) AS INTEGER)"


_PHP = f"regexp_extract(content, {text(rb.EOL_PHP_RULE.pattern)}, %d)"
_MANIFEST = "string_split(path, '/')[-1] IN ('composer.json', 'package.json') AND NOT " + in_vendored("path")
register(
    "r_v_dep_eol_php",
    _manifest_rule(rb.EOL_PHP_RULE),
    sql(
        f"""SELECT project, path AS file, {_line_of(_PHP % 0)} AS line, 'Medium' AS severity, {trim(_PHP % 0)} AS snippet,
          'Requiring an EOL PHP version (' || {_PHP % 1} || '.' || {_PHP % 2} || ') means running without security patches.' AS explanation
        FROM {_NESTED} WHERE {_MANIFEST} AND string_split(path, '/')[-1] = 'composer.json' AND {_PHP % 0} <> ''
          AND (CAST({_PHP % 1} AS INTEGER) < 7 OR (CAST({_PHP % 1} AS INTEGER) = 7 AND CAST({_PHP % 2} AS INTEGER) < 4))""",
        "manifest_files",
    ),
)
_LOOSE = f"regexp_extract(content, {text(rb.UNPINNED_RULE.pattern)}, 0)"
register(
    "r_u_dep_unpinned",
    _manifest_rule(rb.UNPINNED_RULE),
    sql(
        f"""SELECT project, path AS file, {_line_of(_LOOSE)} AS line, 'Medium' AS severity, {trim(_LOOSE)} AS snippet,
          {text(rb.UNPINNED_RULE.explanation)} AS explanation
        FROM {_NESTED} WHERE {_MANIFEST} AND {_LOOSE} <> ''""",
        "manifest_files",
    ),
)


def dependency_findings(spark: SparkSession, d: str) -> DataFrame:
    found = dependencies.dependency_findings(corpora.deps(spark, d), corpora.advisories(spark, d))
    return found.groupBy("project", "title", "severity", "file", "explanation", "recommendation").agg(
        F.count("*").alias("n")
    )


_CVE = """
SELECT project, name || '@' || version || ' — ' || id AS title,
  upper(left(trim(severity), 1)) || lower(substr(trim(severity), 2)) AS severity, source AS file,
  CASE WHEN trim(summary) = '' THEN 'Known vulnerability in a dependency.' ELSE summary END AS explanation,
  'Review advisory ' || id || ' and upgrade ' || name || '.' AS recommendation, count(*) AS n
FROM deps JOIN advisories USING (ecosystem, name, version) GROUP BY ALL
"""
register("r_a_dep_cve", dependency_findings, sql(_CVE, "deps", "advisories"))


def dependency_counts(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.scan_counts(corpora.deps(spark, d), corpora.advisories(spark, d))


register(
    "j_4_dependency_advisory",
    dependency_counts,
    sql(
        """SELECT project, deps_scanned, coalesce(vulnerabilities, 0) AS vulnerabilities
        FROM (SELECT project, count(*) AS deps_scanned FROM deps GROUP BY project)
        LEFT JOIN (SELECT project, count(*) AS vulnerabilities FROM deps JOIN advisories USING (ecosystem, name, version) GROUP BY project)
        USING (project)""",
        "deps", "advisories",
    ),
)


def all_code_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every code rule in one pass over the source corpus."""
    return detect.code_findings(code_files(spark, d))


register(
    "u_4_static_and_config_findings",
    lambda spark, d: fo.merge(
        all_code_findings(spark, d), configscan.config_findings(corpora.config_files(spark, d))
    )
    .groupBy("project", "rule_id", "severity", "category", "title")
    .agg(F.count("*").alias("n"), F.sum("line").alias("lines")),
    sql(
        """SELECT project, rule_id, severity, category, title, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines
        FROM (SELECT project, rule_id, severity, category, title, line FROM code_found
              UNION ALL SELECT project, rule_id, severity, category, title, line FROM config_found) GROUP BY ALL""",
        "code_found", "config_found",
    ),
)

# --- line predicates ------------------------------------------------------------

register(
    "s_2_source_lines",
    lambda spark, d: codelines.source_lines(code_files(spark, d))
    .groupBy("project", "ext")
    .agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes")),
    sql(
        "SELECT project, ext, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM raw_lines GROUP BY ALL",
        "raw_lines",
    ),
)
register(
    "s_3_config_lines",
    lambda spark, d: configscan.config_lines(corpora.config_files(spark, d))
    .groupBy("project", "kind")
    .agg(F.count("*").alias("n"), F.sum("line_no").alias("line_numbers")),
    sql(
        "SELECT project, kind, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS line_numbers FROM config_lines GROUP BY ALL",
        "config_lines",
    ),
)


def _document_lines(spark: SparkSession, d: str) -> DataFrame:
    documents = corpora.table(spark, d, "documents").select("doc_id", "text")
    return documents.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))


register(
    "f_6_long_lines",
    lambda spark, d: _document_lines(spark, d)
    .groupBy("doc_id")
    .agg(
        F.count("*").alias("n"),
        F.count_if(F.octet_length("line") > codelines.LONG_LINE_BYTES).alias("long_lines"),
    ),
    """SELECT doc_id, count(*) AS n, count(*) FILTER (strlen(line) > 500) AS long_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""",
)
register(
    "f_7_code_mask",
    lambda spark, d: detect.annotated_lines(code_files(spark, d))
    .groupBy("project", "path")
    .agg(F.count("*").alias("n"), F.count_if("is_code").alias("code")),
    sql("SELECT project, path, count(*) AS n, count(*) FILTER (is_code) AS code FROM code_lines GROUP BY ALL", "code_lines"),
)
_T_COMMENT = starts_with_any("t", ("//", "#", "*", "/*", "<!--"))
register(
    "f_8_comment_predicate",
    lambda spark, d: codelines.source_lines(code_files(spark, d))
    .groupBy("project", "path")
    .agg(F.count_if(ft.is_comment(F.col("line"))).alias("comments")),
    sql(f"SELECT project, path, count(*) FILTER ({_T_COMMENT}) AS comments FROM masked_lines GROUP BY ALL", "masked_lines"),
)
_EXEC = rb.LINE_RULES[0]
register(
    "f_9_gated_regex",
    lambda spark, d: codelines.source_lines(code_files(spark, d))
    .groupBy("ext")
    .agg(
        F.count_if(ft.contains_any(F.lower("line"), _EXEC.gates)).alias("gated"),
        F.count_if(ft.contains_any(F.lower("line"), _EXEC.gates) & ft.matches(F.col("line"), _EXEC.pattern)).alias("matched"),
    ),
    sql(
        f"""SELECT ext, count(*) FILTER ({contains_any('lower(line)', _EXEC.gates)}) AS gated,
          count(*) FILTER ({contains_any('lower(line)', _EXEC.gates)} AND {matches('line', _EXEC.pattern)}) AS matched
        FROM raw_lines GROUP BY ext""",
        "raw_lines",
    ),
)
_CRED = rb.CREDENTIAL_RULE.pattern


def _credential_values(spark: SparkSession, d: str) -> DataFrame:
    pattern = "(?d)" + ft.ascii_words(_CRED)
    lines = codelines.source_lines(code_files(spark, d)).where(F.col("line").rlike(pattern))
    return lines.select(F.regexp_extract("line", pattern, 2).alias("value"))


register(
    "f_10_secret_placeholder",
    lambda spark, d: _credential_values(spark, d)
    .groupBy("value", detect.is_placeholder(F.col("value")).alias("placeholder"))
    .agg(F.count("*").alias("n")),
    sql(
        f"""SELECT value, {placeholder('value')} AS placeholder, count(*) AS n
        FROM (SELECT regexp_extract(line, {text(_CRED)}, 2) AS value FROM raw_lines WHERE {matches('line', _CRED)}) GROUP BY ALL""",
        "raw_lines",
    ),
)
_ENV = rb.CONFIG_RULES[12]
register(
    "f_12_env_placeholder",
    lambda spark, d: configscan.config_lines(corpora.config_files(spark, d))
    .where(F.col("kind") == "env")
    .groupBy("line", configscan.is_env_placeholder(F.col("line")).alias("placeholder"))
    .agg(F.count("*").alias("n")),
    sql(
        f"""SELECT line, NOT contains(line, '=') OR v = '' OR {starts_with_any('v', ('${', '$(', '<'))} OR {contains_any('lower(v)', rb.ENV_PLACEHOLDER_PARTS)} AS placeholder,
          count(*) AS n
        FROM (SELECT line, trim({trim("substr(line, instr(line, '=') + 1)")}, chr(34) || chr(39)) AS v FROM config_lines WHERE kind = 'env') GROUP BY ALL""",
        "config_lines",
    ),
)
register(
    "w_1_block_comment_state",
    lambda spark, d: codelines.source_lines(code_files(spark, d))
    .where("in_block")
    .select("project", "path", F.col("line_no").cast("long").alias("line_no"), "line"),
    sql("SELECT project, path, line_no, line FROM masked_lines WHERE in_block", "masked_lines"),
)
register(
    "w_2_empty_catch_lookahead",
    lambda spark, d: codelines.source_lines(code_files(spark, d))
    .where(F.col("empty_body") & F.col("line").contains("catch") & F.col("line").rlike(r"^[^{]*\{\s*$"))
    .select("project", "path", F.col("line_no").cast("long").alias("line_no")),
    sql(
        r"""SELECT project, path, line_no FROM masked_lines
        WHERE ext IN ('.php', '.js', '.ts', '.java') AND contains(line, 'catch') AND coalesce(next_code, '') = '}'
          AND regexp_matches(line, '^[^{]*\{\s*$')""",
        "masked_lines",
    ),
)
register(
    "x_3_trailing_comment_strip",
    lambda spark, d: detect.annotated_lines(code_files(spark, d))
    .where(F.col("is_code"))
    .groupBy("ext", "line", "code")
    .agg(F.count("*").alias("n")),
    sql("SELECT ext, line, code, count(*) AS n FROM rule_lines WHERE is_code GROUP BY ALL", "rule_lines"),
)
_TRIMMED = trim("line")
register(
    "x_4_snippet",
    # A cut may fall inside a character, which the SQL side cannot show: the cut snippets
    # are counted, those of whole lines are compared in full.
    lambda spark, d: _document_lines(spark, d)
    .select("doc_id", ft.snippet(F.col("line")).alias("s"))
    .groupBy("doc_id")
    .agg(
        F.count_if(F.col("s").endswith("…")).alias("cut"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(~F.col("s").endswith("…"), F.col("s")))), "|"), 256).alias("whole"),
    ),
    f"""SELECT doc_id, count(*) FILTER (strlen(t) > 160 OR ends_with(t, '…')) AS cut,
         sha256(coalesce(string_agg(t, '|' ORDER BY t) FILTER (NOT (strlen(t) > 160 OR ends_with(t, '…'))), '')) AS whole
       FROM (SELECT doc_id, {_TRIMMED} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
       GROUP BY doc_id""",
)
register(
    "x_5_line_of_substring",
    lambda spark, d: corpora.table(spark, d, "documents").select(
        "doc_id", ft.line_of(F.col("text"), F.lit(" the ")).cast("long").alias("line")
    ),
    """SELECT doc_id, CASE WHEN contains(text, ' the ')
         THEN CAST(len(string_split(left(text, instr(text, ' the ') - 1), chr(10))) AS BIGINT) ELSE 1 END AS line FROM documents""",
)
