"""Version checks on ``composer.json`` and ``package.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths, text
from faultlens.operators import codelines
from faultlens.operators import rulebook as rb
from faultlens.operators.detect import PHASE_CODE
from faultlens.schemas import FINDING_COLUMNS


def manifest_findings(files: DataFrame) -> DataFrame:
    """End-of-life PHP requirement and the first unpinned version, per manifest."""
    body, name = F.col("content"), paths.basename(F.col("path"))
    php = F.regexp_extract(body, rb.EOL_PHP_RULE.pattern, 0)
    major = F.regexp_extract(body, rb.EOL_PHP_RULE.pattern, 1)
    minor = F.regexp_extract(body, rb.EOL_PHP_RULE.pattern, 2)
    # Numbers too long for an int stand for a huge version, never for an old one.
    major_n, minor_n = major.try_cast("long"), minor.try_cast("long")
    old = (name == "composer.json") & (php != "") & (
        (major_n < 7) | ((major_n == 7) & (F.coalesce(minor_n, F.lit(4)) < 4))
    )
    loose = F.regexp_extract(body, rb.UNPINNED_RULE.pattern, 0)

    def hit(rule: rb.Rule, found, version):
        return F.struct(
            F.lit(rule.number).alias("number"), found.alias("found"), version.alias("version")
        )

    hits = F.array(
        F.when(old, hit(rb.EOL_PHP_RULE, php, F.concat_ws(".", major, minor))),
        F.when(loose != "", hit(rb.UNPINNED_RULE, loose, F.lit(""))),
    )
    table = F.broadcast(rb.rule_table(files.sparkSession, [rb.EOL_PHP_RULE, rb.UNPINNED_RULE]))
    return (
        codelines.readable_text(
            codelines.unit(files, "manifest").where(paths.is_manifest(F.col("path")))
        )
        .select("project", "path", "content", F.explode(F.array_compact(hits)).alias("hit"))
        .select("project", "path", "content", "hit.*")
        .join(table, "number")
        .withColumn("file", F.col("path"))
        .withColumn("line", text.line_of(F.col("content"), F.col("found")))
        .withColumn("snippet", text.trim(F.col("found")))
        .withColumn("explanation", F.replace("explanation", F.lit("{version}"), F.col("version")))
        .withColumn("phase", F.lit(PHASE_CODE))
        .withColumn("ord", F.col("number"))
        .withColumn("identity", F.lit(None).cast("string"))
        .select(*FINDING_COLUMNS)
    )
