"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words, and a window is the set of
its places' shingles of three words. A document holds a window only if it holds all its
shingles, so the rarest one is the whole of the necessary prefix: shingles are ordered by
how often the corpus has them, and only each window's rarest is joined to the documents'
shingles. Candidates must leave room for the window before and after that shingle (length
and position), and are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm import common

#: Words of a window and of a shingle.
WINDOW = 10
SHINGLE = 3
#: Windows up to this number are broadcast (some 300 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 100_000
#: No word: marks the end of a document, so that each one has a row.
END = "\x00"


def _shingle(words: Column, at: Column) -> Column:
    """Hash of up to three words from a place; words past the end are left out."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)])


def item_windows(items: DataFrame) -> DataFrame:
    """The distinct windows of all items: words, and the item_ids that have them."""
    return (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), common.words("text").alias("words"))
        .where(F.size("words") > 0)
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))))
        .select("item", F.slice("words", F.col("at") + 1, F.lit(WINDOW)).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def _shingles(windows: DataFrame) -> DataFrame:
    """Every shingle of a window with its place in it; a window of fewer words is one shingle."""
    last = F.greatest(F.size("window") - SHINGLE, F.lit(0))
    placed = windows.select("window", F.posexplode(F.sequence(F.lit(0), last)).alias("at", "_"))
    # A short window's shingle covers all its words, whatever follows them in a document.
    return placed.select("window", "at", _shingle(F.col("window"), F.col("at")).alias("shingle"))


def _rolling(words: Column, at: Column, lengths: list[int]) -> Column:
    """The shingle hashes at a place: of three words, and of fewer where windows that short exist."""
    kinds = [F.xxhash64(*[F.get(words, at + k) for k in range(n)]) for n in lengths]
    return kinds[0] if len(kinds) == 1 else F.explode(F.array_distinct(F.array(*kinds)))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What of each document stands in the items' windows.

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items
    with occurring windows), items_sha256 (SHA-256 of their ids, sorted as strings and
    comma-joined), contaminated (whether n_hit is positive) and items, those ids.

    Null texts have no words, in documents and items alike; items without words have no
    windows. An item of fewer than ten words is one window. Repeated items change nothing;
    a null item_id counts as the id ``''``. Every document row gives a result row, repeated
    ones and null doc_ids included. Further columns are ignored; no documents give no rows.
    """
    windows = common.stored(item_windows(items), "windows")
    shape = windows.agg(F.count("*"), F.collect_set(F.least(F.size("window"), F.lit(SHINGLE)))).first()
    count, lengths = shape[0], sorted(shape[1], reverse=True) or [SHINGLE]
    small = count <= BROADCAST_WINDOWS

    def sized(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if small else frame

    words = F.concat(common.words("text"), F.array(F.lit(END)))
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))

    # How often the corpus has each shingle of the items.
    shingles = _shingles(windows)
    corpus = keyed.select("words", F.posexplode("words").alias("i", "_")).select(
        _rolling(F.col("words"), F.col("i"), lengths).alias("shingle")
    )
    counts = corpus.join(sized(shingles.select("shingle").distinct()), "shingle").groupBy("shingle").count()
    rarity = common.stored(counts, "rarity")
    rank = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "shingle", "at")
    prefixes = (
        shingles.join(rarity, "shingle", "left")
        .withColumn("rank", F.row_number().over(rank))
        .where((F.col("rank") == 1) & F.col("count").isNotNull())
        .join(windows, "window")
        .select(F.col("shingle").alias("key"), "at", "window", "items")
    )
    # The end of a document meets a window that only marks it.
    end = docs.sparkSession.range(1).select(
        F.xxhash64(F.lit(END)).alias("key"),
        F.lit(0).alias("at"),
        F.array(F.lit(END)).alias("window"),
        F.array().cast("array<string>").alias("items"),
    )
    prefixes = prefixes.unionByName(end)

    i, at, length = F.col("i"), F.col("at"), F.size("window")
    placed = keyed.select(
        "row", "doc_id", (F.size("words") - 1).alias("n_words"), "words", F.posexplode("words").alias("i", "_")
    )
    here = i
    if not small:
        # Without a broadcast, only the words that a window can reach travel.
        here = F.least(i, F.lit(WINDOW - 1))
        placed = placed.withColumn("words", F.slice("words", i - here + 1, F.lit(2 * WINDOW)))
    probed = placed.withColumn("probe", _rolling(F.col("words"), here, lengths))
    mark = i == F.col("n_words")
    room = (i >= at) & (i - at + length <= F.col("n_words") + F.when(mark, 1).otherwise(0))
    verified = F.slice("words", F.greatest(here - at, F.lit(0)) + 1, length) == F.col("window")
    hits = probed.join(sized(prefixes), (F.col("probe") == F.col("key")) & room & verified)

    spans = F.array_sort(F.collect_list(F.when(~mark, F.struct((i - at).alias("start"), (i - at + length).alias("end")))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["words"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("words"),
            F.greatest(s["end"], a["upto"]).alias("upto"),
        ),
        lambda a: a["words"],
    )
    ids = F.array_sort(F.array_distinct(F.flatten("found")))
    return (
        hits.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").cast("long").alias("n_words"),
            spans.alias("spans"),
            F.collect_set("items").alias("found"),
        )
        .select("doc_id", "n_words", covered.cast("long").alias("n_hit"), ids.alias("items"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            "items",
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, most: float = 0.0) -> DataFrame:
    """The documents of which at most the share ``most`` of words stands in benchmark windows.

    Columns are unchanged. Documents of one doc_id are judged by the worst of them.
    """
    judged = contaminated(docs.select("doc_id", "text"), items)
    bad = judged.where((F.col("n_hit") > 0) & (F.col("n_hit") > F.col("n_words") * most)).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
