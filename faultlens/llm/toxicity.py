"""Toxicity from a weighted lexicon.

Texts are folded (lower case, homoglyphs to Latin letters, digits and signs inside words to
the letters they stand for) and matched by one Aho-Corasick automaton over all lexicon
entries. An entry is a word or the beginning of words; its weight is the log odds of toxic
against other labelled documents that hold it. Phrases of an entry and a neighbouring word
that only clean documents have are exceptions and take the entry's weight back. The weights
found, by themselves and per word of the document, give the score through a logistic curve.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows of each class that the fit uses at most (on average), drawn by a hash of doc_id.
SAMPLE = 10_000
#: Lengths of word beginnings that may become entries; whole words may, too.
STEMS = range(3, 9)
#: An entry needs so many toxic documents that all of its holders are toxic by luck with less
#: than this probability.
LUCK = 1e-7
#: Least log odds of an entry.
ODDS = 3.0
#: Clean documents that must hold a phrase for it to be an exception.
EXCEPTION_SUPPORT = 3
#: Rows whose crc32(doc_id) leaves this remainder are held out of the fit.
FOLDS, HELD_OUT = 5, 0

# Letters that look like Latin ones, and what stands for letters inside words.
HOMOGLYPHS = str.maketrans(
    "авеёіјкмнорсԁѕтухһԛԝαβεικνορτυχγ" + "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
    "abeeijkmhopcdstyxhqwabeiknoptuxy" + "abcdefghijklmnopqrstuvwxyz",
)
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_INSIDE = re.compile(r"[013457@$!|](?=[0-9@$!|]*[^\W\d_])")
_APART = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded words, one space before and after each."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    text = _INSIDE.sub(lambda m: SUBSTITUTES[m[0]], text)
    return f" {_APART.sub(' ', text).strip()} "


def features(folded: str) -> set[str]:
    """The distinct words (``' word '``) and word beginnings (``' wor'``)."""
    out = set()
    for word in set(folded.split()):
        for n in STEMS:
            if n > len(word):
                break
            out.add(" " + word[:n])
        out.add(f" {word} ")
    return out


@dataclass
class Lexicon:
    """Weights of entries, weights that phrases take back, and the logistic curve."""

    weights: dict[str, float]
    exceptions: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    def __getstate__(self):
        return (self.weights, self.exceptions, self.curve)

    def __setstate__(self, state):
        self.weights, self.exceptions, self.curve = state

    @property
    def automaton(self):
        """Built once in each process that uses it."""
        if not hasattr(self, "_built"):
            self._built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._built.add_word(entry, (entry, weight))
            if self.weights:
                self._built.make_automaton()
        return self._built

    def hits(self, folded: str) -> Iterator[tuple[str, float, str, str]]:
        """Entry, weight and the phrases with the word before and the word after, for each word hit.

        A word counts once, with its heaviest entry.
        """
        if not self.weights:
            return
        best: dict[int, tuple[float, str]] = {}
        for end, (entry, weight) in self.automaton.iter(folded):
            start = end - len(entry) + 2
            if start not in best or weight > best[start][0]:
                best[start] = (weight, entry)
        for start, (weight, entry) in best.items():
            stop = folded.index(" ", start)
            before = folded[folded.rfind(" ", 0, start - 1) + 1 : start - 1] if start > 1 else ""
            after = folded[stop + 1 : folded.find(" ", stop + 1)] if stop + 1 < len(folded) else ""
            word = folded[start:stop]
            yield entry, weight, f"{before} {word}", f"{word} {after}"

    def measures(self, text: str | None) -> tuple[float, float, int]:
        """Log of the weight found, that of the weight per hundred words, and the number of words hit."""
        folded = fold(text)
        total, n = 0.0, 0
        for _, weight, before, after in self.hits(folded):
            weight -= max(self.exceptions.get(before, 0.0), self.exceptions.get(after, 0.0))
            if weight > 0:
                total, n = total + weight, n + 1
        words = max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), float(np.log1p(100.0 * total / words)), n


def _drawn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and the rows each one stands for: a sample of the labelled rows for the fit."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    labelled = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (rest != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    rate = {c: min(1.0, SAMPLE / n) for c, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = F.when(F.col("toxic") == 1, F.lit(rate.get(1, 1.0))).otherwise(F.lit(rate.get(0, 1.0)))
    sample = labelled.where(draw < kept).withColumn("stands_for", F.lit(1.0) / kept)
    # About twice SAMPLE rows of three numbers, by its definition.
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def _count(frame: DataFrame, of) -> DataFrame:
    """Documents of either class per feature, counted within batches first."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            toxic: Counter[str] = Counter()
            clean: Counter[str] = Counter()
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                (toxic if label else clean).update(of(fold(text)))
            keys = list(toxic.keys() | clean.keys())
            if keys:  # an empty list makes a column of floats, which Arrow can't turn into strings
                yield pd.DataFrame({"feature": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})

    counted = frame.select("text", "toxic").mapInPandas(batches, "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon, its exceptions and the curve, from labelled rows outside the held-out fold."""
    sample = _drawn(docs, labels).repartition(max(4, docs.sparkSession.sparkContext.defaultParallelism), "doc_id")
    sizes = {r["toxic"]: (r["n"], r["all"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("stands_for").alias("all")).collect()}
    n_toxic, n_clean = sizes.get(1, (0, 0))[0], sizes.get(0, (0, 0))[0]
    if not n_toxic or not n_clean:
        rate = (sizes.get(1, (0, 0.0))[1] + 0.5) / (sum(s[1] for s in sizes.values()) + 1)
        return Lexicon({}, {}, (float(np.log(rate / (1 - rate))), 0.0, 0.0))

    support = np.log(LUCK) / np.log(n_toxic / (n_toxic + n_clean))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    # Those of the sample alone, so boundedly many.
    found = (
        _count(sample, features)
        .where(F.col("toxic") >= support)
        .withColumn("odds", odds)
        .where(F.col("odds") >= ODDS)
        .orderBy(F.desc("odds"), F.length(F.trim("feature")).desc(), F.length("feature"), "feature")
        .collect()
    )
    weights: dict[str, float] = {}
    told: set[tuple[str, int, int]] = set()
    for row in found:
        entry, counts = row["feature"], (row["toxic"], row["clean"])
        # Of entries that the same number of documents hold, the longest is the most telling;
        # one that begins with a heavier entry adds nothing.
        longer = (entry.rstrip(), *counts) in told
        if not longer and not any(entry[:n] in weights for n in range(2, len(entry))):
            weights[entry] = float(row["odds"])
            told.update((entry[:n], *counts) for n in range(2, len(entry) + 1))
    lexicon = Lexicon(weights)

    def phrases(folded: str) -> set[str]:
        return {p for _, _, before, after in lexicon.hits(folded) for p in (before, after)}

    taken = _count(sample, phrases).where((F.col("clean") >= EXCEPTION_SUPPORT) & (F.col("toxic") == 0))
    most = max(weights.values(), default=0.0)
    lexicon = Lexicon(weights, {r["feature"]: most for r in taken.collect()})
    measured = score_measures(sample, lexicon, "toxic int, stands_for double").select("toxic", "stands_for", "m0", "m1").toPandas()
    lexicon.curve = _logistic(
        measured[["m0", "m1"]].to_numpy(float), measured["toxic"].to_numpy(float), measured["stands_for"].to_numpy(float)
    )
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method, lightly penalised; slopes are not negative."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weight = weight / weight.sum()
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[penalty / 10] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def score_measures(docs: DataFrame, lexicon: Lexicon, kept: str = "doc_id long") -> DataFrame:
    """The measures m0, m1 and hits of every text, and its score, beside the columns ``kept``."""
    names = [c.split()[0] for c in kept.split(", ")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            rows = np.array([lexicon.measures(t) for t in batch["text"]], dtype=float).reshape(-1, 3)
            base, a, b = lexicon.curve
            z = np.clip(base + a * rows[:, 0] + b * rows[:, 1], -500, 500)
            out = batch[names].copy()
            out["m0"], out["m1"], out["hits"] = rows[:, 0], rows[:, 1], rows[:, 2].astype("int64")
            out["score"] = 1 / (1 + np.exp(-z))
            yield out

    schema = f"{kept}, m0 double, m1 double, hits long, score double"
    return docs.select(*names, "text").mapInPandas(batches, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Toxicity of every whole text.

    Returns doc_id, held_out (whether the row is outside the fit), score (0 to 1),
    predicted (1 from a score of 0.5 on, else 0) and hits (words the lexicon matched).

    Labels are learned from at most about ``SAMPLE`` rows of each class; only the text is
    read for a score. Null and empty texts have no words and get the lowest score. Labels
    that are neither 0 nor 1 are left out; a doc_id labelled twice counts as toxic if any
    label says so. Without labels of both classes every text gets the same score. Every row
    gives a result row, repeated ones and null doc_ids included (a null doc_id is not held
    out). Further columns are ignored; no documents give no rows.
    """
    lexicon = lexicon or fit(docs, labels)
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return score_measures(docs.withColumn("doc_id", F.col("doc_id").cast("long")), lexicon).select(
        "doc_id",
        F.coalesce(rest == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "hits",
    )


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def keep_mild(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, their columns unchanged."""
    scored = score_toxicity(docs, labels)
    bad = scored.where("predicted = 1").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
