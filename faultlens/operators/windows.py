"""Order-dependent steps that do not need one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: The largest limit per key that Spark applies before a shuffle by its default setting;
#: sessions of this library raise that (``session.GROUP_LIMIT``).
GROUP_LIMIT = 1000
#: Deals that the tasks of a key are put into for larger limits.
DEALS = 64


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str,
    marks: DataFrame | None = None,
) -> DataFrame:
    """Last non-null ``value`` at or before each row, per key in ``order``.

    The rows of one key are cut into order-preserving ``bucket``s. A window fills each
    bucket; the last value of every bucket, one row each, is then carried over the
    buckets. The work of a very large key is so spread over its buckets.

    ``marks`` may hold the same values with more rows around them, where these are cheaper to
    read than ``df`` once more; of them no more than a row per bucket and map task is shuffled.
    """
    rows = df.withColumn("_bucket", bucket).repartition(*keys, "_bucket")
    within = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    filled = rows.withColumn("_local", F.last(value, ignorenulls=True).over(within))
    held = F.when(F.col(value).isNotNull(), F.struct(*order))
    buckets = (df if marks is None else marks).withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(F.max_by(value, held).alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = buckets.select(
        *keys, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")
    )
    return (
        filled.join(carried, [*keys, "_bucket"], "left")
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop("_local", "_carried", "_bucket")
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rank") -> DataFrame:
    """First ``n`` rows per key.

    The ``row_number() <= n`` form lets Spark keep only ``n`` rows per key and map task
    before the shuffle, so a very frequent key does not travel whole. Above ``GROUP_LIMIT``
    what the map tasks keep is first cut to ``n`` within deals of those tasks, so that no
    task sorts all that is kept of a key. Which deal a row meets changes nothing but where
    it is dropped; ``order`` should leave no ties.
    """
    if n > GROUP_LIMIT:
        dealt = df.withColumn("_deal", F.pmod(F.spark_partition_id(), F.lit(DEALS)))
        within = W.partitionBy(*keys, "_deal").orderBy(*order)
        df = dealt.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= n).drop("_deal", "_place")
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
