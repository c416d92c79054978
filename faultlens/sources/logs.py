"""Application log files to ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that are read as logs in a directory, in order.
LOG_GLOBS = ("*.log", "*.txt", "log-*.php")


def line_order(glob_index: int) -> Column:
    """Order of lines over files: glob, file name, then place in the file.

    Taken at the scan, before any shuffle: the split's offset orders the splits of a
    file, the id orders the lines of a split.
    """
    return F.struct(
        F.lit(glob_index).alias("glob"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        raise FileNotFoundError(path)
    return fs.getFileStatus(hadoop_path).isDirectory()


def _has_match(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_text_lines(spark: SparkSession, path: str, globs: tuple[str, ...]) -> DataFrame:
    """``(source_file, line_order, value)`` of one file, or of a directory's matching files.

    Not recursive; a missing path is an error. A file that matches two globs is read
    twice, once per glob.
    """
    patterns = [f"{path.rstrip('/')}/{g}" for g in globs] if _is_dir(spark, path) else [path]
    patterns = [(i, p) for i, p in enumerate(patterns) if len(patterns) == 1 or _has_match(spark, p)]
    frames = [
        spark.read.option("lineSep", "\n")
        .text(p)
        .select(F.col("_metadata.file_path").alias("source_file"), line_order(i).alias("line_order"), "value")
        for i, p in patterns
    ]
    if not frames:
        schema = "source_file string, line_order struct<glob:int,path:string,block:bigint,id:bigint>, value string"
        return spark.createDataFrame([], schema)
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return read_text_lines(spark, path, LOG_GLOBS)
