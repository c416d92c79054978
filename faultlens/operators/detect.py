"""Line rules on source files: one narrow pass from files to findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import text
from faultlens.operators import codelines
from faultlens.operators import rulebook as rb
from faultlens.schemas import FINDING_COLUMNS

_NONE = -1
STAGE_SIZE = 14
PHASE_CODE, PHASE_CATCH, PHASE_CONFIG, PHASE_EXTERNAL = 0, 1, 2, 3


def _gated(rule: rb.Rule, lower: Column, code: Column) -> Column:
    return text.contains_any(lower, rule.gates) & text.matches(code, rule.pattern)


def is_placeholder(value: Column) -> Column:
    """A literal that is no real secret: short, spaced, interpolated or an example."""
    return _is_placeholder(F.lower(text.trim(value)))


def _is_placeholder(t: Column) -> Column:
    return (
        (F.octet_length(t) < 4)
        | t.rlike("[ \t\n]")
        | t.startswith("$")
        | t.isin(*rb.PLACEHOLDER_WORDS)
        | text.contains_any(t, rb.PLACEHOLDER_PARTS)
    )


def _token_condition(rule: rb.Rule) -> Column:
    hit = _gated(rule, F.col("lower"), F.col("line"))
    if rule.number == rb.PEM_RULE_NUMBER:
        hit = hit & ~F.col("benign_path")
    return hit


def _with_credential_value(lines: DataFrame) -> DataFrame:
    """Add the literal of a line's credential assignment, null where none counts.

    Lines with a token and places of benign literals do not count.
    """
    pattern = "(?d)" + text.ascii_words(rb.CREDENTIAL_RULE.pattern)
    line, gated = F.col("line"), text.contains_any(F.col("lower"), rb.CREDENTIAL_RULE.gates)
    any_token = reduce(or_, [_token_condition(t) for t in rb.TOKEN_RULES])
    assigned = ~F.col("benign_path") & gated & line.rlike(pattern) & ~any_token
    value = F.when(assigned, F.regexp_extract(line, pattern, 2))
    return _staged(lines, credential=value)


def _raw_sql_condition() -> Column:
    code = F.col("code")
    return (
        code.contains("$")
        & text.contains_any(F.col("code_lower"), rb.RAW_SQL_RULE.gates)
        & text.matches(code, rb.SQL_VERB)
        & text.matches(code, rb.SQL_CLAUSE)
        & text.matches(code, rb.SQL_CONCAT)
    )


def _null_chain_condition() -> Column:
    return F.col("code").contains("->") & _gated(rb.NULL_CHAIN_RULE, F.col("code_lower"), F.col("code"))


def _xss_condition() -> Column:
    return _gated(rb.XSS_RULE, F.col("code_lower"), F.col("code")) & ~text.matches(
        F.col("code"), rb.XSS_ESCAPED
    )


def _empty_catch_condition() -> Column:
    line = F.col("line")
    rest = text.trim(F.regexp_extract(line, r"(?s)^[^{]*+\{(.*)$", 1))
    return (
        F.col("is_code")
        & F.lower(line).contains("catch")
        & text.matches(line, rb.EMPTY_CATCH_RULE.pattern)
        & line.contains("{")
        & ((rest == "}") | ((rest == "") & F.col("empty_body")))
    )


def _condition(rule: rb.Rule) -> Column:
    if rule.rule_id == "SEC_TOKEN":
        return _token_condition(rule)
    if rule.rule_id == "SEC_HARDCODED_CREDENTIAL":
        return F.col("credential").isNotNull() & ~F.col("placeholder")
    if rule.rule_id == "ERR_EMPTY_CATCH":
        return _empty_catch_condition()
    on_code = F.col("is_code")
    if rule.rule_id == "DB_RAW_SQL_CONCAT":
        return on_code & _raw_sql_condition()
    if rule.rule_id == "NPE_NULLABLE_CHAIN":
        return on_code & _null_chain_condition()
    if rule.rule_id == "XSS_REFLECTED":
        return on_code & _xss_condition()
    return on_code & ~F.col("code_comment") & _gated(rule, F.col("code_lower"), F.col("code"))


def annotated_lines(files: DataFrame) -> DataFrame:
    """Source lines with the derived columns the conditions read."""
    lines = codelines.source_lines(files)
    line, ext = F.col("line"), F.col("ext")
    with_flags = lines.select(
        "*",
        F.lower(line).alias("lower"),
        codelines.is_code(line, ext, F.col("in_block")).alias("is_code"),
    )
    with_code = with_flags.select(
        "*",
        F.when(F.col("is_code"), text.strip_trailing_comment(line, ext))
        .otherwise(F.lit(""))
        .alias("code"),
    )
    return with_code.select(
        "*",
        F.lower(F.col("code")).alias("code_lower"),
        text.is_comment(F.col("code")).alias("code_comment"),
    )


def _stages(rules: Sequence[rb.Rule]) -> list[dict[tuple[str, ...], list[rb.Rule]]]:
    """Rules in stages of limited size, within a stage by their set of extensions."""
    ordered = sorted(rules, key=lambda r: r.exts)
    stages = []
    for i in range(0, len(ordered), STAGE_SIZE):
        by_exts: dict[tuple[str, ...], list[rb.Rule]] = {}
        for rule in ordered[i : i + STAGE_SIZE]:
            by_exts.setdefault(rule.exts, []).append(rule)
        stages.append(by_exts)
    return stages


def _found(by_exts: dict[tuple[str, ...], list[rb.Rule]]) -> Column:
    """Numbers of a stage's rules that fire; only the line's own language is tested."""
    none = F.array().cast("array<int>")
    arrays = []
    for exts, members in by_exts.items():
        tests = F.array(*[F.when(_condition(r), F.lit(r.number)).otherwise(F.lit(_NONE)) for r in members])
        found = F.array_remove(tests, F.lit(_NONE))
        arrays.append(F.when(F.col("ext").isin(*exts), found).otherwise(none) if exts else found)
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns in an operator of their own: computed once, and one generated method."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_hits(lines: DataFrame, rules: Sequence[rb.Rule]) -> DataFrame:
    """One row per line and rule that fires on it, with the rule's ``number``.

    A line is only tested against the rules of its own language. The rules run in a
    few stages, as the JVM leaves generated methods beyond 8000 bytes uncompiled.
    """
    if rb.CREDENTIAL_RULE in rules:
        lines = _with_credential_value(lines)
        lines = _staged(lines, bare=F.lower(text.trim(F.col("credential"))))
        lines = _staged(lines, placeholder=F.coalesce(_is_placeholder(F.col("bare")), F.lit(False)))
    names = []
    for i, by_exts in enumerate(_stages(rules)):
        names.append(f"_hits{i}")
        lines = _staged(lines, **{names[-1]: _found(by_exts)})
    return lines.select("*", F.explode(F.concat(*names)).alias("number"))


def code_findings(files: DataFrame, rules: Sequence[rb.Rule] | None = None) -> DataFrame:
    """Findings of the code rules on files already restricted by ``codelines``.

    Files become lines, lines become rule numbers, and only lines with a hit meet the
    small fixed rule table; nothing is shuffled.
    """
    rules = list(rb.CODE_RULES if rules is None else rules)
    hit = with_hits(annotated_lines(files), rules).select(
        "project", "path", "line_no", "line", "code", "number"
    )
    raw_text_rules = [r.number for r in (*rb.TOKEN_RULES, rb.CREDENTIAL_RULE, rb.EMPTY_CATCH_RULE)]
    shown = F.when(F.col("number").isin(*raw_text_rules), F.col("line")).otherwise(F.col("code"))
    catch = F.col("number") == rb.EMPTY_CATCH_RULE.number
    table = F.broadcast(rb.rule_table(files.sparkSession, rules))
    return (
        hit.join(table, "number")
        .withColumn("file", F.col("path"))
        .withColumn("snippet", text.snippet(shown))
        .withColumn("identity", text.snippet_identity(shown))
        .withColumn("line", F.col("line_no").cast("int"))
        .withColumn("phase", F.when(catch, PHASE_CATCH).otherwise(PHASE_CODE))
        .withColumn("ord", F.col("number"))
        .select(*FINDING_COLUMNS)
    )
