"""Tables that keep one row per key, written anew by hash buckets.

A batch reads and writes the buckets of its own keys only, in a folder of its own, and then
lists the newest folder of every bucket in one of two slots. A batch that is run again after a
failure starts from the other slot, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a kept table, and the slots that the lists of its newest buckets alternate between.
BUCKETS, SLOTS = 32, 2
HEADS = "bucket int, batch long"


def bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def heads(spark: SparkSession, out: str, before: int | None = None) -> dict[int, int]:
    """The batch that last wrote each bucket; of batches below ``before`` only.

    At most ``BUCKETS`` rows lie in each of two slots, whatever the number of batches.
    """
    rows = []
    for slot in range(SLOTS):
        try:
            rows += spark.read.schema(HEADS + ", at long").parquet(f"{out}/heads/slot={slot}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    ats = {r["at"] for r in rows if before is None or r["at"] < before}
    return {r["bucket"]: r["batch"] for r in rows if ats and r["at"] == max(ats)}


def buckets(spark: SparkSession, out: str, newest: dict[int, int], schema) -> DataFrame:
    paths = [f"{out}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(newest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def held_for(rows: DataFrame, keys: Sequence[str], out: str, batch: int, schema) -> DataFrame:
    """What batches before this one have left in the buckets of the keys of ``rows``."""
    spark = rows.sparkSession
    touched = {r["bucket"] for r in rows.select(bucket_of(keys).alias("bucket")).distinct().collect()}
    newest = heads(spark, out, batch)
    return buckets(spark, out, {b: n for b, n in newest.items() if b in touched}, schema)


def merge_batch(found: DataFrame, merge: Callable[[DataFrame], DataFrame], keys: Sequence[str], out: str, batch: int) -> None:
    """Add the groups of one batch to the kept table; ``merge`` adds rows of the same key up."""
    spark = found.sparkSession
    path = f"{out}/batches/batch={batch}"
    found.withColumn("bucket", bucket_of(keys)).write.mode("overwrite").parquet(path)
    new = spark.read.parquet(path)
    newest = heads(spark, out, batch)
    touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    held = buckets(spark, out, {b: n for b, n in newest.items() if b in touched}, found.schema)
    merged = merge(new.select(*found.columns).unionByName(held.select(*found.columns)))
    by_bucket = merged.withColumn("bucket", bucket_of(keys)).repartition(F.col("bucket"))
    by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/data/batch={batch}")
    newest |= dict.fromkeys(touched, batch)
    rows = [(bucket, at, batch) for bucket, at in newest.items()]
    listed = spark.createDataFrame(rows, HEADS + ", at long").coalesce(1)
    listed.write.mode("overwrite").parquet(f"{out}/heads/slot={batch % SLOTS}")


def kept(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows of a kept table: one for each key, as of the last batch."""
    return buckets(spark, out, heads(spark, out), schema)
