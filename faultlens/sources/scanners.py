"""JSON reports of external scanners to findings.

Input: ``reports(project, root, payload)``, one JSON document per row. All its results
count, unless a caller sets a limit for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths, severity, text
from faultlens.operators.detect import PHASE_EXTERNAL
from faultlens.schemas import FINDING_COLUMNS

# Title length, recommendations, report schemas.
MAX_TITLE = 120
REVIEW = {
    "semgrep": "Review the Semgrep finding and remediate.",
    "phpstan": "Review the PHPStan finding and fix the reported issue.",
    "bandit": "Review the Bandit finding and remediate.",
    "gosec": "Review the gosec finding and remediate.",
    "eslint": "Review the ESLint finding and remediate.",
}

SEMGREP = (
    "results ARRAY<STRUCT<check_id STRING, path STRING, start STRUCT<line INT>, extra STRUCT<"
    "message STRING, severity STRING, lines STRING, "
    "metadata STRUCT<cwe STRING, owasp STRING, category STRING>>>>"
)
BANDIT = (
    "results ARRAY<STRUCT<filename STRING, issue_severity STRING, issue_text STRING, "
    "test_id STRING, line_number INT, code STRING, issue_cwe STRUCT<id INT>>>"
)
GOSEC = (
    "Issues ARRAY<STRUCT<severity STRING, rule_id STRING, details STRING, file STRING, "
    "code STRING, line STRING, cwe STRUCT<id STRING>>>"
)
ESLINT = "ARRAY<STRUCT<filePath STRING, messages ARRAY<STRUCT<ruleId STRING, severity INT, message STRING, line INT>>>>"
PHPSTAN = "files MAP<STRING, STRUCT<messages ARRAY<STRUCT<message STRING, line INT, identifier STRING>>>>"


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first results of every document, where a limit is set."""
    return rows if limit is None else rows.where(F.col("pos") < limit)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _from_first(payload: Column, opening: str) -> Column:
    """Cut whatever precedes the first opening bracket."""
    at = F.locate(opening, payload)
    return F.when(at > 1, F.substring(payload, at, F.length(payload))).otherwise(payload)


def _whole_line(c: Column) -> Column:
    """Line feeds to blanks, trimmed."""
    return text.trim(F.translate(_or_empty(c), "\n", " "))


def _one_line(c: Column) -> Column:
    """Line feeds to blanks, trimmed, cut to the title length."""
    return text.truncate_bytes(_whole_line(c), MAX_TITLE)


def _identity(title: Column, snippet: Column | None = None) -> Column:
    """Hash of what ``_one_line`` cuts of a snippet, or of a title without a snippet."""
    of_title = text.hash_if_cut(_whole_line(title), MAX_TITLE)
    if snippet is None:
        return of_title
    return F.when(_whole_line(snippet) != "", text.hash_if_cut(_whole_line(snippet), MAX_TITLE)).otherwise(of_title)


def _level(c: Column) -> Column:
    return severity.lookup(F.upper(_or_empty(c)), {"HIGH": "High", "MEDIUM": "Medium"}, "Low")


def _findings(rows: DataFrame, engine: str, **columns: Column) -> DataFrame:
    """Finding rows; columns that an engine does not provide are empty."""
    empty = {c: F.lit("") for c in ("snippet", "explanation", "cwe", "owasp")}
    values = {
        "project": F.col("project"),
        **empty,
        "recommendation": F.lit(REVIEW[engine]),
        "phase": F.lit(PHASE_EXTERNAL),
        "ord": F.col("pos"),
        "identity": F.lit(None).cast("string"),
        **columns,
    }
    values["line"] = F.coalesce(values["line"], F.lit(0))
    return rows.select(*[values[c].alias(c) for c in FINDING_COLUMNS])


def _first_value(raw: Column) -> Column:
    """First entry of a field that is a string or a list of strings; CWE names cut."""
    # A plain JSON string arrives unquoted, a list arrives as its JSON text.
    listed = F.from_json(raw, "array<string>")
    value = text.trim(
        F.coalesce(F.when(raw.startswith("["), F.coalesce(F.get(listed, 0), F.lit(""))), raw, F.lit(""))
    )
    short = text.trim(F.substring_index(value, ":", 1))
    return F.when(value.startswith("CWE-") & value.contains(":"), short).otherwise(value)


def _first_line(c: Column) -> Column:
    return F.substring_index(_or_empty(c), "\n", 1)


def semgrep_findings(reports: DataFrame, limit: int | None = None) -> DataFrame:
    doc = F.from_json(F.col("payload"), SEMGREP)
    rows = _first(reports.select("project", F.posexplode(doc["results"]).alias("pos", "r")), limit)
    rule = _or_empty(F.col("r.check_id"))
    tail = F.substring_index(rule, ".", -1)
    category = severity.lookup(
        F.lower(_or_empty(F.col("r.extra.metadata.category"))),
        {
            "performance": "Performance",
            "correctness": "Error Handling",
            "best-practice": "Error Handling",
            "maintainability": "Error Handling",
        },
        "Security",
    )
    level = severity.lookup(
        F.upper(_or_empty(F.col("r.extra.severity"))), {"ERROR": "High", "WARNING": "Medium"}, "Low"
    )
    return _findings(
        rows,
        "semgrep",
        rule_id=F.concat(F.lit("SEMGREP:"), F.when(tail == "", rule).otherwise(tail)),
        severity=level,
        category=category,
        title=_first_line(F.col("r.extra.message")),
        file=_or_empty(F.col("r.path")),
        line=F.col("r.start.line"),
        snippet=text.trim(_first_line(F.col("r.extra.lines"))),
        explanation=_or_empty(F.col("r.extra.message")),
        cwe=_first_value(F.col("r.extra.metadata.cwe")),
        owasp=_first_value(F.col("r.extra.metadata.owasp")),
    )


def _excerpt_line(code: Column, number: Column) -> Column:
    """The excerpt line that carries ``number``, else the first line with code."""
    lines = F.filter(
        F.transform(F.split(_or_empty(code), "\n", -1), text.trim),
        lambda ln: ln != "",
    )
    numbered = r"(?s)^([0-9]+) (.*)$"
    parts = F.transform(
        lines,
        lambda ln: F.struct(
            F.when(ln.rlike(numbered), F.regexp_extract(ln, numbered, 1).try_cast("int"))
            .otherwise(F.lit(0))
            .alias("n"),
            F.when(ln.rlike(numbered), text.trim(F.regexp_extract(ln, numbered, 2)))
            .otherwise(ln)
            .alias("code"),
        ),
    )
    filled = F.filter(parts, lambda p: p["code"] != "")
    wanted = F.filter(filled, lambda p: p["n"] == number)
    return F.coalesce(F.get(wanted, 0)["code"], F.get(filled, 0)["code"], F.lit(""))


def bandit_findings(reports: DataFrame, limit: int | None = None) -> DataFrame:
    doc = F.from_json(_from_first(F.col("payload"), "{"), BANDIT)
    rows = _first(reports.select("project", "root", F.posexplode(doc["results"]).alias("pos", "r")), limit)
    cwe = F.col("r.issue_cwe.id")
    number = F.coalesce(F.col("r.line_number"), F.lit(0))
    return _findings(
        rows,
        "bandit",
        rule_id=F.concat(F.lit("BANDIT:"), _or_empty(F.col("r.test_id"))),
        severity=_level(F.col("r.issue_severity")),
        category=F.lit("Security"),
        title=_one_line(F.col("r.issue_text")),
        file=paths.relative_to(_or_empty(F.col("r.filename")), F.col("root")),
        line=number,
        snippet=_one_line(_excerpt_line(F.col("r.code"), number)),
        identity=_identity(F.col("r.issue_text"), _excerpt_line(F.col("r.code"), number)),
        explanation=_or_empty(F.col("r.issue_text")),
        cwe=F.when(cwe > 0, F.concat(F.lit("CWE-"), cwe.cast("string"))).otherwise(""),
    )


def gosec_findings(reports: DataFrame, limit: int | None = None) -> DataFrame:
    doc = F.from_json(_from_first(F.col("payload"), "{"), GOSEC)
    rows = _first(reports.select("project", "root", F.posexplode(doc["Issues"]).alias("pos", "r")), limit)
    cwe = text.trim(_or_empty(F.col("r.cwe.id")))
    line = F.regexp_extract(text.trim(_or_empty(F.col("r.line"))), r"(?s)^([^-]+)(?:-.*)?$", 1)
    return _findings(
        rows,
        "gosec",
        rule_id=F.concat(F.lit("GOSEC:"), _or_empty(F.col("r.rule_id"))),
        severity=_level(F.col("r.severity")),
        category=F.lit("Security"),
        title=_one_line(F.col("r.details")),
        file=paths.relative_to(_or_empty(F.col("r.file")), F.col("root")),
        line=F.coalesce(F.when(line.rlike(r"^[+-]?[0-9]+$"), line.try_cast("int")), F.lit(0)),
        snippet=_one_line(F.col("r.code")),
        identity=_identity(F.col("r.details"), F.col("r.code")),
        explanation=_or_empty(F.col("r.details")),
        cwe=F.when(cwe != "", F.concat(F.lit("CWE-"), cwe)).otherwise(""),
    )


def _numbered_messages(reports: DataFrame, files: Column, limit: int | None) -> DataFrame:
    """Messages of ``array<struct<path, messages>>`` numbered over the whole document."""
    flat = F.flatten(
        F.transform(
            files,
            lambda f: F.transform(
                F.coalesce(f["messages"], F.array()),
                lambda m: F.struct(f["path"].alias("path"), m.alias("m")),
            ),
        )
    )
    return _first(reports.select("project", "root", F.posexplode(flat).alias("pos", "r")), limit)


def eslint_findings(reports: DataFrame, limit: int | None = None) -> DataFrame:
    doc = F.from_json(_from_first(F.col("payload"), "["), ESLINT)
    files = F.transform(
        doc, lambda f: F.struct(f["filePath"].alias("path"), f["messages"].alias("messages"))
    )
    rule = F.coalesce(F.nullif(F.col("r.m.ruleId"), F.lit("")), F.lit("parse-error"))
    return _findings(
        _numbered_messages(reports, files, limit),
        "eslint",
        rule_id=F.concat(F.lit("ESLINT:"), rule),
        severity=F.when(F.col("r.m.severity") >= 2, "Medium").otherwise("Low"),
        category=F.lit("Error Handling"),
        title=_one_line(F.col("r.m.message")),
        identity=_identity(F.col("r.m.message")),
        file=paths.relative_to(_or_empty(F.col("r.path")), F.col("root")),
        line=F.col("r.m.line"),
        explanation=_or_empty(F.col("r.m.message")),
    )


def phpstan_findings(reports: DataFrame, limit: int | None = None) -> DataFrame:
    """Files of a report are taken in path order, so that the cap is deterministic."""
    doc = F.from_json(_from_first(F.col("payload"), "{"), PHPSTAN)
    files = F.sort_array(
        F.transform(
            F.map_entries(doc["files"]),
            lambda e: F.struct(e["key"].alias("path"), e["value"]["messages"].alias("messages")),
        )
    )
    rule = F.coalesce(F.nullif(F.col("r.m.identifier"), F.lit("")), F.lit("error"))
    return _findings(
        _numbered_messages(reports, files, limit),
        "phpstan",
        rule_id=F.concat(F.lit("PHPSTAN:"), rule),
        severity=F.lit("Medium"),
        category=F.lit("Error Handling"),
        title=_one_line(F.col("r.m.message")),
        identity=_identity(F.col("r.m.message")),
        file=paths.relative_to(_or_empty(F.col("r.path")), F.col("root")),
        line=F.col("r.m.line"),
        explanation=_or_empty(F.col("r.m.message")),
    )


ENGINES = {
    "semgrep": semgrep_findings,
    "bandit": bandit_findings,
    "gosec": gosec_findings,
    "eslint": eslint_findings,
    "phpstan": phpstan_findings,
}
