"""Collocations of each language by best-first branch and bound.

A phrase of two or three words is scored by its count against those of the two parts that a
cut leaves, at the cut where that is least. Phrases grow word by word from their prefixes.
What starts with ``x y`` has no higher score than f(x y) / f(x): its own count is at most
f(x y), the first cut divides by f(x) and by the count of the rest, which is at least the
phrase's own. So the counts of a prefix bound all that grows from it, itself included.

The frontier is the set of frequent pairs. The first expansion takes the pairs of highest
score; it counts the triples that hold them, which settles the scores of the triples and
which pairs a longer phrase absorbs. The language's 2000th surviving score is then a
threshold that can only rise, and the second expansion takes every further pair whose bound
reaches it. No other pair, nor anything that grows from it, can be among the first 2000 or tie
with the last of them.

Counts are made by passes over all texts: tasks count the phrases of some megabytes at a time
over word codes and Spark adds them up. What a pass may leave out (phrases with words or pairs
that are too rare) it knows from hashed bitmaps of fixed size; a false hit there costs a row,
and all counts and decisions are exact.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import batch_bytes, stored

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Least count of a candidate, and the phrases reported of each language.
SUPPORT, REPORTED = 10, 2_000
#: Share of a phrase's occurrences, in percent, that a longer one must have to absorb it.
ABSORBED = 50
SCALE = 1_000_000
#: Pairs of a language that are expanded first.
FIRST = 2 * REPORTED
#: Bytes of text that a task counts at a time, and the bits of a bitmap (4 MB).
SLICE, BITS = 4 << 20, 25
#: Bytes of rows sent to a task's Python at a time.
BATCH = 8 << 20
_MIX = 1_000_003
#: Language of rows without one.
UNKNOWN = "und"

_SPACE, _END = 32, 10
# ASCII bytes by what they are: capitals become small, tabs spaces, and marks ends of pieces.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[9] = _SPACE
_BYTES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _END


def _hash(crcs: list[np.ndarray]) -> np.ndarray:
    """Places in a bitmap of phrases, given the CRC-32 of each word (and of the language first)."""
    return reduce(lambda a, b: (a * _MIX + b) & ((1 << BITS) - 1), crcs)


def _hash_column(names: list[str]) -> Column:
    return reduce(lambda a, b: F.pmod(a * _MIX + b, F.lit(1 << BITS)), [F.crc32(F.col(c).cast("binary")) for c in names])


def bitmap(frame: DataFrame, names: list[str]) -> np.ndarray:
    """The bits of all rows, as bytes: at most 2**25 bits reach the driver, whatever the rows."""
    place = _hash_column(names)
    # Spark counts places from 1.
    bits = frame.select((place + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for row in bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        start = (row["bucket"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Bytes of the texts by some megabytes, the places where texts begin, and whether the
    slice continues the one before.

    Texts above that size are cut at a space or at the end of a piece.
    """
    texts = batch.column("text").cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = int(ends[0])
    continues = False
    while at < ends[-1]:
        last = int(ends[np.searchsorted(ends, at + SLICE, "right") - 1])
        cut = last <= at
        if cut:  # one text of more than a slice
            last = int(ends[np.searchsorted(ends, at, "right")])
            step = at + SLICE
            while step < last:
                near = _BYTES[data[step : min(step + 65536, last)]]
                gaps = np.flatnonzero((near == _SPACE) | (near == _END))
                if len(gaps):
                    last = step + int(gaps[0]) + 1
                    break
                step += 65536
        begins = ends[np.searchsorted(ends, at) : np.searchsorted(ends, last)] - at
        yield data[at:last], begins, continues
        continues = last not in ends[np.searchsorted(ends, last) : np.searchsorted(ends, last) + 1]
        at = last


class Counter:
    """Counts of the phrases of ``size`` words in batches of lang and text."""

    def __init__(self, size: int, words: np.ndarray | None = None, pairs: np.ndarray | None = None, taken: np.ndarray | None = None):
        self.size, self.words, self.pairs, self.taken = size, words, pairs, taken

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                tail = b""
                for data, begins, continues in _slices(batch.filter(pc.equal(batch.column("lang"), lang))):
                    data = _BYTES[data]
                    text = np.concatenate([np.frombuffer(tail, np.uint8), data]) if continues and tail else data
                    shift = len(text) - len(data)
                    out = self._count(lang, text, begins + shift)
                    tail = self._tail(text)
                    if out is not None:
                        yield out

    def _tail(self, text: np.ndarray) -> bytes:
        """The last words, one fewer than a phrase has, with what parts them."""
        if self.size == 1:
            return b""
        for width in (4096, len(text)):
            end = text[-width:].tobytes()
            at, left = len(end.rstrip(b" \n")), self.size - 1
            while left and at > 0:
                at = max(end.rfind(b" ", 0, at), end.rfind(b"\n", 0, at)) + 1
                left -= 1
                if left:
                    at = len(end[:at].rstrip(b" \n"))
            if at > 0 or width >= len(text):
                return end[max(0, at) :]
        return b""

    def _count(self, lang: str, text: np.ndarray, begins: np.ndarray) -> pa.RecordBatch | None:
        gap = (text == _SPACE) | (text == _END)
        first = ~gap
        first[1:] &= gap[:-1]
        first[begins[begins < len(text)]] |= ~gap[begins[begins < len(text)]]
        starts = np.flatnonzero(first)
        if not len(starts):
            return None
        # Pieces end at marks and at the ends of texts.
        parted = text == _END
        parted[begins[begins < len(text)]] = True
        piece = np.searchsorted(np.flatnonzero(parted), starts, "right")
        # A word ends where the next one starts or a gap does.
        final = ~gap
        final[:-1] &= gap[1:] | first[1:]
        offsets = np.append(0, np.cumsum(np.flatnonzero(final) + 1 - starts))
        letters = text[~gap]
        del parted, final, gap, first
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
        coded = array.dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary
        if self.size == 1:
            found = np.bincount(codes, minlength=len(names))
            words = pa.concat_arrays([names, pa.array([b""], pa.large_binary())])
            return self._batch(lang, [words], np.append(found, len(codes)))
        crc = np.array([zlib.crc32(x) for x in names.to_pylist()], dtype=np.int64)
        of_lang = np.int64(zlib.crc32(lang.encode()))
        often = _has(self.words, _hash([of_lang, crc]))[codes]
        k = self.size - 1
        good = (piece[k:] == piece[:-k]) & reduce(np.logical_and, [often[i : len(often) - k + i] for i in range(k + 1)])
        at = np.flatnonzero(good)
        if self.size == 3:
            of_pair = _hash([of_lang, crc[codes[:-1]], crc[codes[1:]]])
            frequent, taken = _has(self.pairs, of_pair), _has(self.taken, of_pair)
            at = at[frequent[at] & frequent[at + 1] & (taken[at] | taken[at + 1])]
        if not len(at):
            return None
        # Two codes make one number; a third is added to their rank.
        key = codes[at].astype(np.int64) * len(names) + codes[at + 1]
        if self.size == 2:
            keys, found = np.unique(key, return_counts=True)
            parts = [keys // len(names), keys % len(names)]
        else:
            pairs, rank = np.unique(key, return_inverse=True)
            keys, found = np.unique(rank.astype(np.int64) * len(names) + codes[at + 2], return_counts=True)
            pair = pairs[keys // len(names)]
            parts = [pair // len(names), pair % len(names), keys % len(names)]
        return self._batch(lang, [names.take(pa.array(p)) for p in parts], found)

    def _batch(self, lang: str, words: list[pa.Array], found: np.ndarray) -> pa.RecordBatch:
        phrases = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        langs = pa.array([lang]).take(pa.array(np.zeros(len(found), np.int32)))
        return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.large_string()).cast(pa.string()), pa.array(found, pa.int64())], names=["lang", "phrase", "f"])


def _counts(texts: DataFrame, counter: Counter, label: str) -> DataFrame:
    """The words (x, y, z) of the phrases with a count f of ``SUPPORT`` or more."""
    parts = texts.mapInArrow(counter.__call__, "lang string, phrase string, f long")
    often = parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= SUPPORT)
    words = [F.split_part("phrase", F.lit(" "), F.lit(i + 1)).alias(c) for i, c in enumerate("xyz"[: counter.size])]
    with batch_bytes(texts.sparkSession, BATCH):
        return stored(often.select("lang", *words, "f"), label)


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE a a / (left right)), in decimals of 38 digits: exact for counts up to 10**15."""
    a, left, right = (F.col(c).cast("decimal(16,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, left * right)


def _bound() -> Column:
    """The highest score of what starts with a pair."""
    f, fx = (F.col(c).cast("decimal(16,0)") for c in ("f", "fx"))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * f, fx)


def collocations(docs: DataFrame, reported: int = REPORTED, first: int | None = None) -> DataFrame:
    """The ``reported`` best phrases of every language.

    Returns lang, rank (from 1), phrase, a, l, r, n and score, as the module describes them:
    a, l, r are the counts of the phrase and of its two parts at the cut that counts, n the
    words of the language. Order: score, a (both descending), phrase (ascending by bytes).
    Null texts hold no words; rows without a language belong to ``und``, those of that name
    included; repeated rows count as often as they stand; null doc_ids and further columns
    play no part. A language without candidates, and an empty table, give no rows.
    ``first``: pairs of a language expanded first, which changes the work, never the result.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    ones = _counts(texts, Counter(1), "collocation-words")
    words, total = ones.where("x != ''"), ones.where("x = ''").select("lang", F.col("f").alias("n"))
    often = bitmap(words, ["lang", "x"])
    twos = _counts(texts, Counter(2, often), "collocation-pairs-counted")
    pairs = (
        twos.join(words.select("lang", "x", F.col("f").alias("fx")), ["lang", "x"])
        .join(words.select("lang", F.col("x").alias("y"), F.col("f").alias("fy")), ["lang", "y"])
        .withColumn("score", _score("f", "fx", "fy"))
        .withColumn("bound", _bound())
    )
    pairs = stored(pairs, "collocation-pairs")
    frequent = bitmap(pairs, ["lang", "x", "y"])

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "x", "y")
    chosen = pairs.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= (first or 2 * reported)).drop("_at")
    chosen = stored(chosen, "collocation-first")
    settled = stored(_settle(texts, chosen, pairs, often, frequent), "collocation-settled")
    # One row for each language: the score that the last of the first ``reported`` survivors has.
    bar = _ranked(settled, reported).groupBy("lang").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    bar = bar.select("lang", F.when(F.col("_n") >= reported, F.col("_least")).otherwise(-1).alias("bar"))
    rest = (
        pairs.join(chosen.select("lang", "x", "y"), ["lang", "x", "y"], "left_anti")
        .join(bar, "lang", "left")
        .where(F.col("bound") >= F.coalesce("bar", F.lit(-1)))
        .drop("bar")
    )
    rest = stored(rest, "collocation-rest")
    if not rest.isEmpty():
        more = _settle(texts, rest, pairs, often, frequent)
        settled = settled.unionByName(more).dropDuplicates(["lang", "phrase"])
    return (
        _ranked(settled, reported)
        .join(total, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def _ranked(settled: DataFrame, reported: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return settled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reported)


def _settle(texts: DataFrame, taken: DataFrame, pairs: DataFrame, often: np.ndarray, frequent: np.ndarray) -> DataFrame:
    """lang, phrase, a, l, r, score: the pairs ``taken`` that no triple absorbs, and all triples
    that hold one of them."""
    threes = _counts(texts, Counter(3, often, frequent, bitmap(taken, ["lang", "x", "y"])), "collocation-triples")
    holds = taken.select("lang", "x", "y", F.col("f").alias("a"))
    after = holds.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), "a")
    enough = 100 * F.col("f") >= ABSORBED * F.col("a")
    absorbed = (
        threes.join(holds, ["lang", "x", "y"])
        .where(enough)
        .select("lang", "x", "y")
        .unionByName(threes.join(after, ["lang", "y", "z"]).where(enough).select("lang", F.col("y").alias("x"), F.col("z").alias("y")))
        .distinct()
    )
    kept = taken.join(absorbed, ["lang", "x", "y"], "left_anti").select(
        "lang", F.concat_ws(" ", "x", "y").alias("phrase"), F.col("f").alias("a"), F.col("fx").alias("l"), F.col("fy").alias("r"), "score"
    )
    heads = pairs.select("lang", "x", "y", "fx", F.col("f").alias("fxy"))
    tails = pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("f").alias("fyz"), F.col("fy").alias("fz"))
    grown = (
        threes.join(heads, ["lang", "x", "y"])
        .join(tails, ["lang", "y", "z"])
        .withColumns({"s1": _score("f", "fx", "fyz"), "s2": _score("f", "fxy", "fz")})
    )
    early = F.col("s1") <= F.col("s2")
    triples = grown.select(
        "lang",
        F.concat_ws(" ", "x", "y", "z").alias("phrase"),
        F.col("f").alias("a"),
        F.when(early, F.col("fx")).otherwise(F.col("fxy")).alias("l"),
        F.when(early, F.col("fyz")).otherwise(F.col("fz")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    return kept.unionByName(triples)
