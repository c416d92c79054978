"""Document fingerprints from prefix polynomial hashes.

A text is a sequence of code points c0 c1 ... Two modular prefix arrays hold, for every
length n, the sum of c(i) * B**i for i below n. The hash of any span follows from two
entries, so any two spans are compared in constant time and the longest common prefix or
suffix of two texts is found by binary search. The fingerprint keeps the hash of the whole
text and the hashes of prefixes and suffixes at a grid of lengths; two fingerprints alone
tell the common prefix and suffix, and equal spans between them, up to the grid.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm import common

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Two prime moduli below 2**31 (products fit 64 bits) and their bases.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: A grid has at most so many lengths.
GRID = 32

_powers = [np.ones(1, np.uint64) for _ in MODULI]


def _power(k: int, n: int) -> np.ndarray:
    """B**0 ... B**n, doubled as far as needed; kept while texts are short enough."""
    table = _powers[k]
    while len(table) <= n:
        step = np.uint64(pow(BASES[k], len(table), MODULI[k]))
        table = np.concatenate([table, table * step % np.uint64(MODULI[k])])
        if len(table) <= 1 << 20:
            _powers[k] = table
    return table[: n + 1]


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for k, modulus in enumerate(MODULI):
            sums = np.zeros(self.n + 1, np.uint64)
            # Terms stay below 2**31, so 2**33 of them fit the sum.
            np.cumsum(points * _power(k, self.n)[: self.n] % np.uint64(modulus), out=sums[1:])
            self.sums.append(sums % np.uint64(modulus))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Sum over the span, still multiplied by B**start."""
        return tuple((int(s[end]) - int(s[start])) % m for s, m in zip(self.sums, MODULI, strict=True))

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        """Whether the span of this length at ``start`` equals that at ``at`` in the other text."""
        here, there = self.span(start, start + length), other.span(at, at + length)
        return all(
            a * pow(b, max(0, at - start), m) % m == c * pow(b, max(0, start - at), m) % m
            for a, c, b, m in zip(here, there, BASES, MODULI, strict=True)
        )

    def common_prefix(self, other: PrefixHashes) -> int:
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(0, other, 0, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def common_suffix(self, other: PrefixHashes, most: int) -> int:
        low, high = 0, min(self.n, other.n, most)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(self.n - mid, other, other.n - mid, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self) -> str:
        """``length:whole hash:prefix hashes:suffix hashes``, all in hexadecimal.

        Grid lengths are the multiples of the least power of two that leaves at most
        ``GRID`` of them, so the grids of any two texts share the coarser one.
        """
        whole = "".join(f"{x:08x}" for x in self.span(0, self.n))
        step = grid_step(self.n)
        sums, modulus, base = self.sums[0], MODULI[0], BASES[0]
        ends = range(step, self.n + 1, step)
        prefixes = "".join(f"{int(sums[e]):08x}" for e in ends)
        # Divided by B**start, a suffix hash does not depend on what precedes the suffix.
        inverse = pow(base, -1, modulus)
        factor, shift = pow(inverse, self.n - step, modulus) if self.n >= step else 1, pow(base, step, modulus)
        suffixes, last = [], int(sums[self.n])
        for e in ends:
            suffixes.append(f"{(last - int(sums[self.n - e])) * factor % modulus:08x}")
            factor = factor * shift % modulus
        return f"{self.n:x}:{whole}:{prefixes}:{''.join(suffixes)}"


def grid_step(n: int) -> int:
    step = 1
    while n // step > GRID:
        step *= 2
    return step


def _longest(a: str, b: str, step_a: int, step_b: int, most: int) -> int:
    """The longest grid length at which both lists of hashes agree, by binary search."""
    step = max(step_a, step_b)

    def at(hashes: str, own: int, length: int) -> str:
        i = (length // own - 1) * 8
        return hashes[i : i + 8]

    low, high = 0, most // step
    while low < high:
        mid = (low + high + 1) // 2
        if at(a, step_a, mid * step) == at(b, step_b, mid * step):
            low = mid
        else:
            high = mid - 1
    return low * step


def _cells(hashes: str, own: int, step: int, count: int, shift: int) -> np.ndarray:
    """Hashes of the first ``count`` spans of length ``step``: what each grid hash adds to ``shift`` times the one before."""
    grid = np.frombuffer(bytes.fromhex(hashes), ">u4").astype(np.uint64)[step // own - 1 :: step // own][:count]
    before = np.concatenate([np.zeros(1, np.uint64), grid[:-1]])
    modulus = np.uint64(MODULI[0])
    return (grid + modulus - before * np.uint64(shift) % modulus) % modulus


def _inner(a: tuple[str, str], b: tuple[str, str], sa: int, sb: int, least: int, ahead: int, behind: int) -> int:
    """Code points in equal grid spans between the common prefix and suffix.

    Up to some place spans at one distance from the start are compared, from there on spans at
    one distance from the end; the place that gives most counts. ``least`` is the shorter length.
    """
    step = max(sa, sb)
    count = least // step
    if count == 0:
        return 0
    front = _cells(a[0], sa, step, count, 1) == _cells(b[0], sb, step, count, 1)
    shift = pow(BASES[0], step, MODULI[0])
    back = _cells(a[1], sa, step, count, shift) == _cells(b[1], sb, step, count, shift)
    at = np.arange(count) * step
    front &= (at >= ahead) & (at + step <= least - behind)
    back &= (at >= behind) & (at + step <= least - ahead)
    # Of the spans from the end, span j lies at least - (j + 1) * step; k spans of the front leave room for these.
    room = (least - np.arange(count + 1) * step) // step
    gained = np.concatenate([[0], np.cumsum(front)]) + np.concatenate([[0], np.cumsum(back)])[room]
    return int(gained.max()) * step


def likeness(a: str, b: str) -> float:
    """Share of the longer text that two fingerprints alone show to stand in the other one, in order.

    That is the common prefix and suffix and, between them, grid spans that are equal at one
    distance from the start or, further on, from the end: edits in several places leave what
    lies between them, as long as at most one of them changes the length. 1 for equal texts,
    two empty ones included.
    """
    if a == b:
        return 1.0
    (na, _, prefix_a, suffix_a), (nb, _, prefix_b, suffix_b) = a.split(":"), b.split(":")
    n, m = int(na, 16), int(nb, 16)
    if not n or not m:
        return 0.0
    sa, sb = grid_step(n), grid_step(m)
    ahead = _longest(prefix_a, prefix_b, sa, sb, min(n, m))
    behind = _longest(suffix_a, suffix_b, sa, sb, min(n, m) - ahead)
    inner = _inner((prefix_a, suffix_a), (prefix_b, suffix_b), sa, sb, min(n, m), ahead, behind)
    return min(1.0, (ahead + behind + inner) / max(n, m))


def _with_next_head(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``head``, the first quarter-of-this-text's length of the next document.

    Documents are cut into ranges of doc_id; each range also gets the first document of the
    next one, so that no range depends on another and each text is shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 2 * common.parallelism(spark)
    numbered = docs.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("key"))
    splits = numbered.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n))
    docs = docs.withColumn("range", common.range_index(F.col("doc_id"), sorted({int(s) for s in splits})))
    # One row per range: bounded by the number of ranges.
    firsts = sorted(
        (r["range"], r["nulls"] == 0, r["first"])
        for r in docs.groupBy("range")
        .agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
        .collect()
    )
    docs = docs.withColumn("tail", F.lit(False))
    tails = []
    for (before, _, _), (_, named, first) in zip([firsts[-1], *firsts[:-1]] if firsts else [], firsts, strict=True):
        tails.append((None if not named else first, before))
    heads = spark.createDataFrame(tails, "first long, before int")
    edge = (
        docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first")))
        .select("doc_id", "text", F.col("before").alias("range"), F.lit(True).alias("tail"))
    )
    # Ties go by text; rows of the range itself come before the added ones.
    order = Window.partitionBy("range").orderBy("tail", F.col("doc_id").asc_nulls_first(), "text")
    quarter = F.expr("char_length(text) div 4")
    return (
        docs.unionByName(edge)
        .withColumn("next", F.lead("text").over(order))
        .where(~F.col("tail"))
        .select("doc_id", "text", "next", F.substring("next", F.lit(1), quarter).alias("head"))
    )


OUTPUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, prefix_edited long, suffix_edited long"
)


def _fingerprint_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: str | None = None
    kept_print = ""
    for batch in batches:
        rows = []
        for doc_id, text, following, head in zip(batch["doc_id"], batch["text"], batch["next"], batch["head"], strict=True):
            quarter = len(text) // 4
            edited = text[: len(text) - quarter] + head
            own, other = PrefixHashes(text), PrefixHashes(edited)
            mine = kept_print if text == kept else own.fingerprint()
            kept, kept_print = following, PrefixHashes(following).fingerprint()
            changed = other.fingerprint()
            ahead = own.common_prefix(other)
            rows.append(
                (
                    doc_id, own.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine, changed,
                    likeness(mine, changed), likeness(mine, kept_print),
                    ahead, own.common_suffix(other, min(own.n, other.n) - ahead),
                )
            )
        columns = [c.split()[0] for c in OUTPUT.split(", ")]
        out = pd.DataFrame(rows, columns=columns)
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last quarter (rounded down, in code points) replaced by as
    many first code points of the next document in ascending doc_id, or all of them if it
    has fewer; the first document follows the last. ``near_edited`` and ``near_next``
    compare fingerprints alone; ``prefix_edited`` and ``suffix_edited`` are exact lengths
    from the prefix arrays.

    A null text counts as empty. Null doc_ids come first; rows of one doc_id follow each
    other by text, and each gives a result row. A lone document is its own successor.
    Further columns are ignored; no input gives no rows.
    """
    paired = _with_next_head(docs)
    return paired.mapInPandas(_fingerprint_batches, OUTPUT)
