"""Operators on findings: enrich, filter, suppress, scope, order, count and score."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths, severity
from faultlens.operators import diffscope
from faultlens.operators import rulebook as rb
from faultlens.schemas import FINDING_COLUMNS

SEVERITIES = ("Critical", "High", "Medium", "Low")


def finding_order() -> list[Column]:
    """Severity first, then file and line; ties keep the order of emission."""
    return [
        severity.rank(F.col("severity")).desc(),
        F.col("file").asc(),
        F.col("line").asc(),
        F.col("phase").asc(),
        F.col("ord").asc(),
    ]


def order_key() -> Column:
    """The same order as one ascending comparable value."""
    return F.struct(
        (-severity.rank(F.col("severity"))).alias("r"),
        F.col("file").alias("f"),
        F.col("line").alias("l"),
        F.col("phase").alias("p"),
        F.col("ord").alias("o"),
    )


def enrich(findings: DataFrame) -> DataFrame:
    """Fill CWE and OWASP from the rule where the finding brings none."""
    meta = F.broadcast(rb.rule_meta(findings.sparkSession))
    own_cwe, own_owasp = F.nullif(F.col("cwe"), F.lit("")), F.nullif(F.col("owasp"), F.lit(""))
    return (
        findings.join(meta, "rule_id", "left")
        .withColumn("cwe", F.coalesce(own_cwe, "meta_cwe", F.lit("")))
        .withColumn("owasp", F.coalesce(own_owasp, "meta_owasp", F.lit("")))
        .select(*findings.columns)
    )


def merge(*frames: DataFrame) -> DataFrame:
    """Bag union of findings from several sources."""
    return reduce(DataFrame.unionByName, [with_identity(f).select(*FINDING_COLUMNS) for f in frames])


def with_identity(findings: DataFrame) -> DataFrame:
    """The findings with their column ``identity``, null where a given table has none."""
    return findings if "identity" in findings.columns else findings.withColumn("identity", F.lit(None).cast("string"))


def in_scope(findings: DataFrame, categories: Iterable[str] = (), minimum: str = "") -> DataFrame:
    """Keep chosen categories (none chosen: all) at or above a severity (none given: all)."""
    kept, minimum = findings, minimum.strip()
    if minimum:
        least = severity.RANKS.get(minimum.capitalize(), severity.RANKS["Low"])
        kept = findings.where(severity.rank(F.col("severity")) >= least)
    chosen = [c.strip() for c in categories if c.strip()]
    return kept.where(F.col("category").isin(*chosen)) if chosen else kept


def without_rules(findings: DataFrame, rule_ids: Iterable[str]) -> DataFrame:
    ids = [r.strip() for r in rule_ids if r.strip()]
    return findings.where(~F.col("rule_id").isin(*ids)) if ids else findings


def keep(findings: DataFrame, predicate: Column) -> DataFrame:
    return findings.where(predicate)


def fingerprint(identity: Column | None = None) -> Column:
    """Identity of a finding without its line: rule, file and offending text.

    ``identity`` stands for the text where the snippet or title shown is cut.
    """
    text = F.when(F.col("snippet") != "", F.col("snippet")).otherwise(F.col("title"))
    whole = text if identity is None else F.coalesce(identity, text)
    return F.sha1(F.concat_ws("|", F.col("rule_id"), F.col("file"), whole))


def fingerprinted(findings: DataFrame) -> DataFrame:
    """The findings with the fingerprints of their whole texts."""
    return with_identity(findings).withColumn("fingerprint", fingerprint(F.col("identity"))).select(*findings.columns, "fingerprint")


def suppress_known(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drop findings whose fingerprint is in ``baseline(project, fingerprint)``.

    The baseline's size is left to the optimizer: it is broadcast when its statistics
    allow, else the join shuffles and splits frequent fingerprints.
    """
    marked = fingerprinted(findings)
    return marked.join(baseline, ["project", "fingerprint"], "left_anti").drop("fingerprint")


def on_changed_spans(findings: DataFrame, spans: DataFrame, new_files: DataFrame | None = None) -> DataFrame:
    """Keep findings on changed lines, given ``diffscope.changed_spans``.

    A finding meets one row: that of its lines, or that of its file where it has no line or
    where ``new_files(project, file)`` names the file. The search of a row's ranges ends at the
    one that holds the line.
    """
    located = findings.withColumn("_file", paths.normalise(F.col("file")))
    whole = F.col("line") <= 0
    if new_files is not None:
        whole_file = F.lit(diffscope.WHOLE_FILE).alias("bucket")
        added = new_files.select("project", paths.normalise(F.col("file")).alias("file")).distinct()
        empty = F.array().cast(diffscope.SPANS).alias("spans")
        spans = spans.unionByName(added.select("project", "file", whole_file, empty))
        located = located.join(added.select("project", F.col("file").alias("_file"), F.lit(True).alias("_new")), ["project", "_file"], "left")
        whole = whole | F.coalesce("_new", F.lit(False))
    located = located.withColumn("_bucket", F.when(whole, F.lit(diffscope.WHOLE_FILE)).otherwise(diffscope.span_bucket(F.col("line"))))
    looked_up = spans.select(
        F.col("project").alias("_p"), F.col("file").alias("_f"), F.col("bucket").alias("_b"), F.col("spans").alias("_spans")
    )
    held = F.exists("_spans", lambda s: (s["start"] <= F.col("line")) & (s["end"] >= F.col("line")))
    on = (
        (F.col("project") == F.col("_p"))
        & (F.col("_file") == F.col("_f"))
        & (F.col("_bucket") == F.col("_b"))
        & ((F.col("_bucket") == diffscope.WHOLE_FILE) | held)
    )
    return located.join(looked_up, on, "left_semi").select(*findings.columns)


def on_changed_lines(findings: DataFrame, changed_files: DataFrame, changed_ranges: DataFrame) -> DataFrame:
    """Keep findings on changed lines.

    ``changed_files(project, file, all)`` has one row per file, ``changed_ranges(project,
    file, start, end)`` holds inclusive ranges of any files; only those of changed files count.
    """
    listed = changed_files.where(~F.col("all"))
    ranges = changed_ranges.join(listed.select("project", "file").distinct(), ["project", "file"], "left_semi")
    return on_changed_spans(findings, diffscope.spans_of(listed, ranges), changed_files.where("all"))


def by_severity(findings: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    return findings.groupBy(*by, "severity").agg(F.count("*").alias("n"))


def by_category(findings: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    return findings.groupBy(*by, "category").agg(F.count("*").alias("n"))


def summary(findings: DataFrame, files_scanned: DataFrame) -> DataFrame:
    """Counts, effort, both density scores and the rating, one row per scanned project.

    One aggregation with conditional sums; ``files_scanned(project, files_scanned)``
    keeps projects without findings in the result.
    """
    sev, security = F.col("severity"), severity.is_security(F.col("category"))

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    aggs = [
        F.count("*").alias("total"),
        *[n(sev == s).alias(s.lower()) for s in SEVERITIES],
        *[n(security & (sev == s)).alias(f"sec_{s.lower()}") for s in SEVERITIES],
        n(security).alias("sec_total"),
        F.sum(severity.effort_minutes(sev)).cast("long").alias("effort_minutes"),
        F.max(F.when(security, severity.rank(sev)).otherwise(0)).alias("worst"),
        n(F.col("category") == "Security").alias("security_findings"),
        n(F.col("category") == "Performance").alias("performance_findings"),
    ]
    counts = findings.groupBy("project").agg(*aggs)
    joined = files_scanned.join(counts, "project", "left").na.fill(0)
    joined = joined.select(
        "*",
        (F.col("total") - F.col("sec_total")).alias("health_total"),
        *[(F.col(s.lower()) - F.col(f"sec_{s.lower()}")).alias(f"health_{s.lower()}") for s in SEVERITIES],
    )

    def score(prefix: str, total: str) -> Column:
        return severity.density_score(
            F.col(total), *[F.col(f"{prefix}{s.lower()}") for s in SEVERITIES], F.col("files_scanned")
        )

    scored = joined.select(
        "*",
        score("", "total").alias("score"),
        score("sec_", "sec_total").alias("security_score"),
        score("health_", "health_total").alias("health_score"),
    )
    return scored.select(
        "project",
        "files_scanned",
        "total",
        *[s.lower() for s in SEVERITIES],
        "score",
        severity.grade(F.col("score")).alias("grade"),
        "security_score",
        severity.grade(F.col("security_score")).alias("security_grade"),
        "health_score",
        severity.grade(F.col("health_score")).alias("health_grade"),
        severity.rating(F.col("worst")).alias("security_rating"),
        severity.from_rank(F.col("worst")).alias("rating_basis"),
        "effort_minutes",
        severity.effort_text(F.col("effort_minutes")).alias("effort_text"),
        (F.col("critical") + F.col("high")).alias("critical_and_high"),
        "security_findings",
        "performance_findings",
    )


def gate(findings: DataFrame, files_scanned: DataFrame, threshold: str) -> DataFrame:
    """Findings at or above the threshold per project; the gate passes at zero.

    A threshold that names no severity counts as Low. The counts are sums of ``by_severity``,
    so that a plan which reads that too evaluates the findings once.
    """
    least = severity.RANKS.get(threshold.strip().capitalize(), severity.RANKS["Low"])
    failing = F.when(severity.rank(F.col("severity")) >= least, F.col("n"))
    counts = by_severity(findings).groupBy("project").agg(F.sum(failing).alias("fail_count"))
    return (
        files_scanned.select("project")
        .join(counts, "project", "left")
        .select(
            "project",
            F.lit(threshold).alias("threshold"),
            F.coalesce("fail_count", F.lit(0)).cast("long").alias("fail_count"),
        )
        .withColumn("passed", F.col("fail_count") == 0)
    )
