"""File inventory: counts, extensions, roles, markers and dominant language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths
from faultlens.operators.windows import first_n

MAX_EXTENSIONS = 10


def walked(files: DataFrame) -> DataFrame:
    """Rows outside ignored directories; a directory row is ignored by its own name too."""
    own = F.coalesce(F.col("is_dir"), F.lit(False)) & paths.basename(F.col("path")).isin(
        *paths.IGNORED_DIRS
    )
    return files.where(~paths.in_ignored_dir(F.col("path")) & ~own)


def _only_files(files: DataFrame) -> DataFrame:
    return walked(files).where(~F.coalesce(F.col("is_dir"), F.lit(False)))


def totals(files: DataFrame) -> DataFrame:
    """Files and directories per project, root not counted.

    Directories are the distinct ancestors of files plus listed directory rows; they are
    made distinct per (project, directory) before the count per project.
    """
    rows = walked(files)
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    seen = F.when(
        is_dir, F.concat(paths.ancestors(F.col("path")), F.array("path"))
    ).otherwise(paths.ancestors(F.col("path")))
    dirs = (
        rows.select("project", F.explode(seen).alias("dir"))
        .distinct()
        .groupBy("project")
        .agg(F.count("*").alias("dirs"))
    )
    counts = rows.groupBy("project").agg(F.count_if(~is_dir).alias("files"))
    return counts.join(dirs, "project", "left").select(
        "project", "files", F.coalesce("dirs", F.lit(0)).cast("long").alias("dirs")
    )


def by_extension(files: DataFrame) -> DataFrame:
    return (
        _only_files(files)
        .select("project", paths.extension(F.col("path")).alias("ext"))
        .where(F.col("ext") != "")
        .groupBy("project", "ext")
        .agg(F.count("*").alias("n"))
    )


def top_extensions(files: DataFrame, n: int = MAX_EXTENSIONS) -> DataFrame:
    """Most frequent extensions; ties by name."""
    order = [F.col("n").desc(), F.col("ext").asc()]
    return first_n(by_extension(files), ["project"], order, n, "position")


def by_role(files: DataFrame) -> DataFrame:
    return (
        _only_files(files)
        .select("project", paths.role(F.col("path")).alias("role"))
        .where(F.col("role").isNotNull())
        .groupBy("project", "role")
        .agg(F.count("*").alias("n"))
    )


def markers(files: DataFrame) -> DataFrame:
    """Sorted labels of the manifests present; at most one per known manifest name."""
    return (
        _only_files(files)
        .select("project", paths.marker_label(paths.basename(F.col("path"))).alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy("project")
        .agg(F.sort_array(F.collect_set("label")).alias("markers"))
    )


def dominant_language(files: DataFrame) -> DataFrame:
    """Backend manifest language with most source files, else the commonest one.

    One pass: each file contributes its extension's language as a source file and, when
    it is a backend manifest, that language as a mark. Ties go to the first name.
    """
    path = F.col("path")
    named = _only_files(files).select(
        "project",
        paths.language(paths.extension(path)).alias("source"),
        paths.backend_language(paths.basename(path)).alias("backend"),
    )
    marks = F.array(
        F.struct(F.col("source").alias("lang"), F.lit(1).alias("n"), F.lit(0).alias("b")),
        F.struct(F.col("backend").alias("lang"), F.lit(0).alias("n"), F.lit(1).alias("b")),
    )
    counted = (
        named.select("project", F.inline(marks))
        .groupBy("project", "lang")
        .agg(F.sum("n").alias("n"), F.max("b").alias("b"))
    )
    usable = F.col("lang").isNotNull() & (F.col("n") > 0)
    rank = F.struct((-F.col("b")).alias("b"), (-F.col("n")).alias("n"), F.col("lang").alias("lang"))
    best = counted.groupBy("project").agg(F.min(F.when(usable, rank)).alias("best"))
    return best.select("project", F.coalesce("best.lang", F.lit("Unknown")).alias("language"))
