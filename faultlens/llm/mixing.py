"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of rows, so that the schedule is small however large the
corpus is; time is counted in rows. A source of weight w gets, in fluid terms, w of every
row placed. A block may not run before its source's fluid share reaches its first row
(release) and must have run when the share reaches its end (deadline). Earliest deadline
first among the released blocks, a block giving way to one that is more urgent, then meets
every deadline, which keeps each source within one of its own blocks of its target over
every prefix of the corpus. A source's last block counts with the rows it has. Once a
source is used up, its weight goes to the others in proportion, so no document is left out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The whole corpus is about so many blocks, and every source is cut into its equal part of them at least.
BLOCKS = 10_000
#: Default targets: a source weighs its row count to this power, which lifts small sources.
POWER = 0.5
#: Columns that a mixture adds.
ADDED = ("mix_source", "weight", "block", "release", "deadline", "slot", "position")
#: Rows of one source in a bucket that one task sorts, at most (on average).
ROWS_PER_BUCKET = 200_000


def _fluid(counts: Mapping[str, int], weights: Mapping[str, float], sizes: Mapping[str, int]) -> dict[str, np.ndarray]:
    """Per source, when its fluid share reaches the start of each of its blocks, and its end.

    Rows are placed at the rate of one; sources without a target follow all others, by their row counts.
    """
    times: dict[str, np.ndarray] = {}
    now = 0.0
    aimed = {s: float(weights.get(s, 0.0)) for s, n in counts.items() if n}
    for rates in ({s: w for s, w in aimed.items() if w > 0}, {s: float(counts[s]) for s, w in aimed.items() if w <= 0}):
        if not rates:
            continue
        # A source ends at its rows over its weight on a clock that runs for all sources alike.
        rows, weight = np.array([counts[s] for s in rates], float), np.array(list(rates.values()))
        order = np.argsort(rows / weight)
        ends = (rows / weight)[order]
        ended = np.concatenate([[0.0], np.cumsum(rows[order])])
        active = np.concatenate([np.cumsum(weight[order][::-1])[::-1], [0.0]])
        for source, w in rates.items():
            shares = np.append(np.arange(0, counts[source], sizes[source]), counts[source])
            clock = shares / w
            before = np.searchsorted(ends, clock, "left")
            times[source] = now + ended[before] + clock * active[before]
        now += ended[-1]
    return times


def pieces(
    counts: Mapping[str, int], weights: Mapping[str, float], sizes: Mapping[str, int]
) -> list[tuple[str, int, int, int, int, int, int]]:
    """Rows (source, block, release, deadline, slot, first, n): n rows of the source from its
    row ``first``, all of one block, take the places from ``slot``.

    ``counts`` holds the rows of each source and ``sizes`` those of its blocks. A block is in
    several pieces if others came between; there are at most twice as many pieces as blocks.
    """
    jobs = []
    for source, times in _fluid(counts, weights, sizes).items():
        size, slack = sizes[source], np.minimum(1e-6 + 1e-12 * times, 0.1)
        releases, deadlines = np.floor(times + slack).astype(int).tolist(), np.ceil(times - slack).astype(int).tolist()
        for block, first in enumerate(range(0, counts[source], size)):
            jobs.append((releases[block], deadlines[block + 1], source, block, first, min(size, counts[source] - first)))
    jobs.sort()
    ready: list[tuple[int, str, int, int, int, int]] = []
    out: list[tuple[str, int, int, int, int, int, int]] = []
    now = at = 0
    while ready or at < len(jobs):
        while at < len(jobs) and (jobs[at][0] <= now or not ready):
            release, deadline, source, block, first, n = jobs[at]
            heapq.heappush(ready, (deadline, source, block, release, first, n))
            at += 1
        deadline, source, block, release, first, n = heapq.heappop(ready)
        run = min(n, jobs[at][0] - now) if at < len(jobs) else n
        if out and out[-1][:2] == (source, block):
            out[-1] = (*out[-1][:6], out[-1][6] + run)
        else:
            out.append((source, block, release, deadline, now, first, run))
        now += run
        if run < n:
            heapq.heappush(ready, (deadline, source, block, release, first + run, n - run))
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[str, int, int, int, int]]:
    """Rows (source, block, release, deadline, slot), one for every block, for blocks of equal length.

    ``blocks`` holds the number of blocks of each source; the work is that of sorting them.
    """
    return [piece[:5] for piece in pieces(blocks, weights, dict.fromkeys(blocks, 1))]


def block_sizes(counts: Mapping[str, int], blocks: int = BLOCKS) -> dict[str, int]:
    """Rows of a block of each source: at most ``blocks`` of the corpus, and less for a source
    that would have less than its equal part of the blocks. There are at most ``2 * blocks``
    blocks and two more for each source."""
    size = max(1, -(-sum(counts.values()) // blocks))
    part = max(1, blocks // max(1, len(counts)))
    return {s: min(size, -(-n // part)) for s, n in counts.items()}


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """The documents with their places in the mixture.

    Adds mix_source, weight, block, release, deadline, slot and position (0 to the number
    of documents less one; read in that order, the corpus has the target weights). Release,
    deadline and slot are positions: those between which the block has to stand, and that at
    which the row's unbroken run of its block begins. Columns of these names in the input
    give way.

    ``weights`` maps sources to targets of any scale; sources that it leaves out come after
    those it names. By default a source weighs its row count to the power of ``POWER``.
    Within a source, documents come in the order of a hash of their doc_id. A null source
    counts as the source ``''``. Every row is placed once, repeated rows too; rows that
    agree in doc_id and text take neighbouring places in any order. An empty input gives
    no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED, "_bucket", "_order").withColumn("mix_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    # Bounded by the number of sources, which the targets name one by one.
    counts = {r["mix_source"]: r["count"] for r in docs.groupBy("mix_source").count().collect()}
    rows = sum(counts.values())
    sizes = block_sizes(counts, blocks)
    targets = {s: n**POWER for s, n in counts.items()} if weights is None else dict(weights)
    total = sum(targets.get(s, 0.0) for s in counts) or 1.0

    plan: dict[tuple[str, int], list] = defaultdict(list)
    for source, block, release, deadline, slot, first, _ in pieces(counts, targets, sizes):
        plan[source, block].append((release, deadline, slot, first))
    # One row for every block, see ``block_sizes``, with at most twice as many pieces.
    table = spark.createDataFrame(
        [
            (source, block, *parts[0][:2], [p[2:] for p in parts], targets.get(source, 0.0) / total)
            for (source, block), parts in plan.items()
        ],
        "mix_source string, block long, release long, deadline long, pieces array<struct<slot: long, first: long>>, weight double",
    )
    lengths = spark.createDataFrame(list(sizes.items()), "mix_source string, _size long")

    # Places within a source: hash buckets, so that no task sorts a whole source.
    buckets = max(1, -(-rows // ROWS_PER_BUCKET), 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    order = F.xxhash64("doc_id")
    placed = docs.withColumn("_order", order).withColumn("_bucket", F.pmod(F.shiftright("_order", 20), F.lit(buckets)))
    before = Window.partitionBy("mix_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("mix_source", "_bucket")
        .count()
        .select("mix_source", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
        .join(F.broadcast(lengths), "mix_source")
    )
    inside = Window.partitionBy("mix_source", "_bucket").orderBy("_order", "doc_id", F.xxhash64("text"))
    return (
        placed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, ["mix_source", "_bucket"])
        .withColumn("_row", F.col("_row") + F.col("_start"))
        .withColumn("block", F.expr("_row div _size"))
        .join(F.broadcast(table), ["mix_source", "block"])
        .withColumn("_piece", F.expr("element_at(filter(pieces, p -> p.first <= _row), -1)"))
        .withColumn("slot", F.col("_piece.slot"))
        .withColumn("position", F.col("slot") + F.col("_row") - F.col("_piece.first"))
        .select(*[c for c in docs.columns if c != "mix_source"], *ADDED)
    )


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """The documents, their columns unchanged, in the order of the mixture.

    Partitions hold consecutive ranges of positions and are sorted, so files written from
    the result follow the mixture from the first to the last.
    """
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c in ADDED}
    mixed = mix(docs.withColumnsRenamed(own), weights, blocks).orderBy("position")
    return mixed.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
