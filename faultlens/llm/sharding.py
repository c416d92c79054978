"""Sharding by sampled splitters.

Records are laid out in the order of (hash of the text, doc_id), so that equal texts lie
together and everything else is spread evenly. A size-weighted sample of the keys gives
quantile splitters, which cut the order into ranges of about equal bytes. A key that alone
overfills a range gets a range of its own, which is cut again by doc_id. Byte and row totals
of the ranges give every record its exact offset in the whole order without any task
seeing more than one range, and the offset decides the shard.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm import common

#: Bytes that every record has besides its text.
OVERHEAD = 16
#: Ranges per shard at least, rows in a range at most (on average).
RANGES_PER_SHARD = 4
ROWS_PER_RANGE = 500_000
#: Sampled keys per range.
SAMPLE_PER_RANGE = 100


@dataclass(frozen=True)
class Layout:
    """Where ranges, pieces and shards begin; bounded by the number of ranges."""

    cuts: list[int]
    subs: dict[int, list[int]]
    bases: list[tuple[int, int, int, int]]
    starts: list[tuple[int, int]]
    total_bytes: int
    n_shards: int


def _keyed(docs: DataFrame, key: Column | None) -> DataFrame:
    """The documents with their sizes, checksums and keys, which the working columns hold."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc32"),
        (F.xxhash64(text) if key is None else key.cast("long")).alias("_key"),
    )


def _quantiles(frame: DataFrame, column: str, n: int, sharpness: int) -> list[int]:
    """The distinct borders between ``n`` equal parts of the column."""
    if n < 2:
        return []
    points = ",".join(str(i / n) for i in range(1, n))
    found = frame.agg(F.expr(f"percentile_approx({column}, array({points}), {sharpness * n})")).first()[0]
    return sorted(set(found or []))


def _splitters(records: DataFrame, total_bytes: int, total_rows: int, n_shards: int):
    """Range boundaries on the key, and per range the boundaries on doc_id that subdivide it."""
    n_ranges = max(RANGES_PER_SHARD * n_shards, -(-total_rows // ROWS_PER_RANGE))
    target = total_bytes / n_ranges
    # A record is drawn with probability size / step; one of several steps is drawn that often.
    step = max(1, int(target / SAMPLE_PER_RANGE))
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id", "_key"), F.lit(step))
    times = F.expr(f"_size div {step}").cast("int") + F.when(draw < F.col("_size") % step, 1).otherwise(0)
    sample = records.select(F.col("_key").alias("key"), times.alias("times")).where("times > 0").select(
        "key", F.explode(F.sequence(F.lit(1), F.col("times")))
    )
    cuts = set(_quantiles(sample, "key", n_ranges, 20))
    # Keys of more than half a range; there are at most two for each range.
    heavy = [
        row["key"]
        for row in sample.groupBy("key").count().where(F.col("count") > SAMPLE_PER_RANGE / 2).collect()
    ]
    for key in heavy:
        cuts.add(key)
        if key < (1 << 63) - 1:
            cuts.add(key + 1)
    ordered = sorted(cuts)
    # Overfull ranges are cut by doc_id into pieces of about one range's bytes.
    loads = {
        row["_key"]: row["bytes"]
        for row in records.where(F.col("_key").isin(heavy)).groupBy("_key").agg(F.sum("_size").alias("bytes")).collect()
    } if heavy else {}
    subs: dict[int, list[int]] = {}
    for key, load in loads.items():
        n = -(-load // int(target + 1))
        if n > 1:
            inside = records.where(F.col("_key") == key)
            subs[ordered.index(key) + 1] = _quantiles(inside, "doc_id", n, 50)
    return ordered, subs


def _ranged(records: DataFrame, cuts: list[int], subs: dict[int, list[int]]) -> DataFrame:
    piece = F.lit(0)
    for r, points in subs.items():
        piece = F.when(F.col("_range") == r, common.range_index(F.col("doc_id"), points)).otherwise(piece)
    return records.withColumn("_range", common.range_index(F.col("_key"), cuts)).withColumn("_piece", piece)


def _placed(records: DataFrame, layout: Layout) -> DataFrame:
    """Every record with its shard and its row in the whole order."""
    bases = records.sparkSession.createDataFrame(
        layout.bases, "_range int, _piece int, _bytes_before long, _rows_before long"
    )
    inside = Window.partitionBy("_range", "_piece").orderBy("_key", "doc_id", "_crc32", "_size")
    ahead = F.coalesce(F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        _ranged(records, layout.cuts, layout.subs)
        .withColumn("_ahead", ahead)
        .withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(bases), ["_range", "_piece"])
        .withColumn(
            "_shard",
            F.expr(
                f"cast(((_bytes_before + _ahead) * cast({layout.n_shards} as decimal(20,0)))"
                f" div {layout.total_bytes} as int)"
            ),
        )
        .withColumn("_row", F.col("_rows_before") + F.col("_rank"))
        .drop("_range", "_piece", "_ahead", "_rank", "_bytes_before", "_rows_before")
    )


def _layout(records: DataFrame, n_shards: int) -> Layout:
    totals = records.agg(F.sum("_size"), F.count("*")).first()
    total_bytes, total_rows = int(totals[0] or 0), int(totals[1])
    if not total_rows:
        return Layout([], {}, [], [], 1, n_shards)
    cuts, subs = _splitters(records, total_bytes, total_rows, n_shards)
    loads = (
        _ranged(records, cuts, subs)
        .groupBy("_range", "_piece")
        .agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
        .collect()
    )
    bases, n_bytes, n_rows = [], 0, 0
    for r in sorted(loads):
        bases.append((r["_range"], r["_piece"], n_bytes, n_rows))
        n_bytes, n_rows = n_bytes + r["bytes"], n_rows + r["rows"]
    layout = Layout(cuts, subs, bases, [], total_bytes, n_shards)
    starts = _placed(records, layout).groupBy("_shard").agg(F.min("_row").alias("first")).collect()
    return replace(layout, starts=[(r["_shard"], r["first"]) for r in starts])


def _sharded(records: DataFrame, layout: Layout) -> DataFrame:
    starts = records.sparkSession.createDataFrame(layout.starts, "_shard int, _first long")
    return _placed(records, layout).join(F.broadcast(starts), "_shard").withColumn("_slot", F.col("_row") - F.col("_first"))


def file_order(docs: DataFrame) -> Column | None:
    """The order of the rows in the files that the frame was read from, or None where it has no such files.

    Spark numbers the files that it writes by partition, so a frame that was written in an
    order keeps it.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    number = F.when(part == "", F.lit(0)).otherwise(part.cast("long"))
    return number * F.lit(1 << 40) + F.col("_metadata.row_index")


def assign_shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """Shard and slot of every document, by the law ``bytes``.

    Returns doc_id, size (UTF-8 bytes of the text and 16 more), text_crc32, law, shard,
    slot (gapless from 0 within its shard) and grown_shard (null under this law). A shard
    holds its exact share of all bytes, give or take the document at each of its ends.
    Equal texts follow each other, so they share a shard unless they fill more than one or
    lie across a border.

    A null text counts as an empty one; a null doc_id sorts before all others. Every input
    row gives one result row, repeated ones too. More shards than documents leave some
    shards empty; an empty input gives no rows. Further columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    light = common.stored(_keyed(docs.select("doc_id", "text"), None).drop("text"), "shard-keys")
    return _sharded(light, _layout(light, n_shards)).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, n_shards: int, key: Column | None = None) -> DataFrame:
    """The documents themselves with their shard and slot, by the same law as ``assign_shards``.

    ``key`` replaces the hash of the text as the order in which shards are filled. Columns
    named shard and slot give way. Each text is shuffled once, to its range.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    docs = docs.drop("shard", "slot") if key is None else docs
    keyed = _keyed(docs, key).drop("shard", "slot")
    light = common.stored(keyed.select("doc_id", "_size", "_crc32", "_key"), "shard-keys")
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    return _sharded(keyed, _layout(light, n_shards)).select(
        *columns, F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot")
    )
