"""Baselines of accepted findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.findings import fingerprinted


#: Files of a project's baseline, at most.
FILES_PER_PROJECT = 8
#: Buckets of a baseline table.
BUCKETS = 200


def baseline_of(findings: DataFrame) -> DataFrame:
    """Distinct ``(project, fingerprint)`` of findings."""
    return fingerprinted(findings).select("project", "fingerprint").distinct()


def write_baseline(findings: DataFrame, path: str) -> None:
    """Store the baseline as Parquet; projects that ``findings`` do not hold keep theirs.

    Rows are dealt by project and a hash, so a project has a few files, however many tasks
    there are and however large it is.
    """
    stamped = baseline_of(findings).withColumn("created_at", F.current_timestamp())
    dealt = stamped.repartition("project", F.pmod(F.xxhash64("fingerprint"), F.lit(FILES_PER_PROJECT)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("project").cast("string"), "fingerprint")


def write_baseline_table(findings: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Store the baseline as a catalog table bucketed by (project, fingerprint), one file a bucket.

    ``suppress_known`` against ``read_baseline_table`` then shuffles the findings alone, into the
    table's buckets; the baseline is read where it lies. Replaces the whole table. Choose
    ``buckets`` by the baseline's size (some 100 MB each), at least the session's shuffle partitions.
    """
    stamped = baseline_of(findings).withColumn("created_at", F.current_timestamp())
    dealt = stamped.repartition(buckets, "project", "fingerprint")
    writer = dealt.write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, "project", "fingerprint").sortBy("project", "fingerprint").saveAsTable(name)


def read_baseline_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).select("project", "fingerprint")


def read_baseline_documents(spark: SparkSession, path: str, project: str) -> DataFrame:
    """JSON documents ``{created_at, fingerprints[]}`` written by the command-line tool."""
    docs = spark.read.schema("created_at string, fingerprints array<string>").json(path, multiLine=True)
    return docs.select(F.lit(project).alias("project"), F.explode("fingerprints").alias("fingerprint")).distinct()
