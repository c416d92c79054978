"""Rules on container, orchestration, environment and web-server files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths, text
from faultlens.operators import codelines
from faultlens.operators import rulebook as rb
from faultlens.operators.detect import PHASE_CONFIG
from faultlens.schemas import FINDING_COLUMNS


def config_files(files: DataFrame) -> DataFrame:
    """Config files with the kind that selects their rules."""
    kind = paths.config_kind(F.col("path"), F.col("content"))
    return (
        codelines.unit(files, "config")
        # By the path first: contents decide on YAML files alone.
        .where(paths.may_be_config(F.col("path")))
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
    )


def config_lines(files: DataFrame) -> DataFrame:
    """``(project, path, kind, line_no, line)`` without blank and ``#`` lines."""
    return (
        config_files(files)
        .select("project", "path", "kind", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
        .select("project", "path", "kind", (F.col("pos") + 1).alias("line_no"), "line")
        .where(~F.col("line").rlike(rf"^[{text.BLANK_IN_LINE}]*+(?:\z|#)"))
    )


def is_env_placeholder(line: Column) -> Column:
    """An assignment whose value is empty, a reference or a template word."""
    value = text.trim(F.regexp_extract(line, r"(?s)^[^=]*+=(.*)$", 1))
    bare = F.btrim(value, F.lit("\"'"))
    return (
        ~line.contains("=")
        | (bare == "")
        | text.starts_with_any(bare, ("${", "$(", "<"))
        | text.contains_any(F.lower(bare), rb.ENV_PLACEHOLDER_PARTS)
    )


def _condition(rule: rb.Rule) -> Column:
    line, low = F.col("line"), F.lower(F.col("line"))
    hit = text.contains_any(low, rule.gates) & text.matches(line, rule.pattern)
    if rule.rule_id == "COMPOSE_DB_PORT_EXPOSED":
        hit = hit & ~text.contains_any(low, ("127.0.0.1", "localhost"))
    if rule.rule_id == "ENV_SECRET_COMMITTED":
        hit = hit & ~is_env_placeholder(line)
    return hit


def config_findings(files: DataFrame, rules: Sequence[rb.Rule] | None = None) -> DataFrame:
    """Findings on config files; their CWE and OWASP come with the rule."""
    rules = list(rb.CONFIG_RULES if rules is None else rules)
    kinds: dict[str, list[rb.Rule]] = {}
    for rule in rules:
        kinds.setdefault(rule.kind, []).append(rule)
    branches = None
    for kind, members in kinds.items():
        tests = F.array(*[F.when(_condition(r), F.lit(r.number)).otherwise(F.lit(-1)) for r in members])
        test = F.col("kind") == kind
        found = F.array_remove(tests, F.lit(-1))
        branches = F.when(test, found) if branches is None else branches.when(test, found)
    hit = config_lines(files).select(
        "project", "path", "line_no", "line", F.explode(branches).alias("number")
    )
    table = F.broadcast(rb.rule_table(files.sparkSession, rules))
    return (
        hit.join(table, "number")
        .withColumn("file", F.col("path"))
        .withColumn("snippet", text.snippet(F.col("line")))
        .withColumn("identity", text.snippet_identity(F.col("line")))
        .withColumn("line", F.col("line_no").cast("int"))
        .withColumn("phase", F.lit(PHASE_CONFIG))
        .withColumn("ord", F.col("number"))
        .select(*FINDING_COLUMNS)
    )
