"""The training-data pipeline: five stages over the table ``documents``.

Each stage reads what the one before it wrote, whole, and decides what stays, or in which
order or shard. Rows leave only by the decisions of the three filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultlens.llm import decontaminate, mixing, neardup, sharding, toxicity
from faultlens.llm.common import stored, table

#: Shards that the corpus ends in.
SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_mild(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8), the document of the least doc_id stays."""
    return neardup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of a benchmark item stands go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that holds every source at its target weight."""
    return mixing.in_mixed_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; shards of equal bytes follow the mixture."""
    return sharding.shard_documents(docs, SHARDS, sharding.file_order(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("shards", shard),
]

#: Trained scores, signatures and splitters have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharded corpus: the columns of ``documents``, shard and slot."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
