"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a fixed sparse random index vector. Its word vector is the sum of the index
vectors of its neighbours over the whole corpus, so words of like company get like vectors.
Words are hashed into a fixed number of rows, which bounds the memory for any vocabulary.
Beside the words themselves, their shapes (letters, capitals, digits, signs) and whether
they repeat what came just before are words of the company as well. A document is the mean
of its words' vectors and of its shapes' and repeats' index vectors. A network of two
layers is trained on a bounded sample of labelled documents, and a temperature fitted on a
part of the sample that training left out calibrates its probabilities.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of word vectors, their length, and non-zero entries of an index vector.
VOCABULARY, WIDTH, ENTRIES = 1 << 14, 64, 4
#: Shapes and repeats of words are told apart by so many index vectors.
SHAPES = 512
#: Neighbours on either side that make up a word's company.
REACH = 2
#: Rows of the word table that are summed and moved together.
BLOCK = 512
#: Words that are handled together.
CHUNK = 100_000
#: Labelled rows used for training at most (on average), drawn by a hash of doc_id.
SAMPLE = 20_000
#: Hidden units, passes over the sample, and the share of it that calibrates.
HIDDEN, EPOCHS, CALIBRATION = 32, 60, 0.2
#: Weight decay for one row; it weakens as rows are added.
DECAY = 10.0
#: Rows whose crc32(doc_id) leaves this remainder are held out of training.
FOLDS, HELD_OUT = 3, 1

_rng = np.random.default_rng(11)
#: Index vectors of words and shapes: places and signs of their entries.
_AT = _rng.integers(0, WIDTH, (VOCABULARY + SHAPES, ENTRIES))
_SIGN = _rng.choice(np.array([-1, 1], np.int64), (VOCABULARY + SHAPES, ENTRIES))
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")


def _shape(word: bytes) -> int:
    """Runs of letters, capitals and digits become one sign each; other signs stay."""
    plain = _DIGITS.sub(b"0", _CAPITALS.sub(b"A", _LETTERS.sub(b"a", word)))
    return zlib.crc32(plain) % (SHAPES - 3)


class _Codes(dict):
    """Row of the word times SHAPES plus its shape, per word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = zlib.crc32(word.lower()) % VOCABULARY * SHAPES + _shape(word)
        return code


def _tokens(text: str | None, codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Word rows and shape rows of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").split()
    code = np.fromiter(map(codes.__getitem__, found), np.int64, len(found))
    return code // SHAPES, code % SHAPES


def _repeats(words: np.ndarray) -> np.ndarray:
    """Per word: 0 if new, 1 if it repeats the word before, 2 if it was among the 40 words before."""
    out = np.zeros(len(words), np.int64)
    if len(words) > 1:
        order = np.argsort(words, kind="stable")
        near = (words[order][1:] == words[order][:-1]) & (np.diff(order) <= 40)
        out[order[1:][near]] = 2
        out[1:][words[1:] == words[:-1]] = 1
    return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of a batch, some CHUNK words at a time, with their tokens."""
    codes = _Codes()
    for batch in batches:
        start, load, held = 0, 0, []
        for at, text in enumerate(batch["text"]):
            held.append(_tokens(text, codes))
            load += len(held[-1][0])
            if load >= CHUNK:
                yield batch.iloc[start : at + 1], held
                start, load, held = at + 1, 0, []
        if held:
            yield batch.iloc[start:], held


def _company(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of this task, in blocks of word rows."""
    table = np.zeros(VOCABULARY * WIDTH, np.int64)
    for _, held in _chunks(batches):
        texts = [h for h in held if len(h[0])]
        if not texts:
            continue
        words = np.concatenate([w for w, _ in texts])
        shapes = np.concatenate([s for _, s in texts]) + VOCABULARY
        doc = np.repeat(np.arange(len(texts)), [len(w) for w, _ in texts])
        for step in range(1, REACH + 1):
            same = np.flatnonzero(doc[step:] == doc[:-step])
            for here, there in ((same, same + step), (same + step, same)):
                for company in (words, shapes):
                    index = company[there]
                    flat = words[here][:, None] * WIDTH + _AT[index]
                    table += np.bincount(flat.ravel(), _SIGN[index].ravel(), len(table)).astype(np.int64)
    blocks = table.reshape(-1, BLOCK * WIDTH)
    for i in np.flatnonzero(blocks.any(axis=1)):
        yield pd.DataFrame({"block": [int(i)], "sums": [blocks[i].astype(np.int64).tobytes()]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the blocks that a task gets; it holds one array per block, however many come."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch["block"], batch["sums"], strict=True):
            totals[block] = totals.get(block, 0) + np.frombuffer(sums, np.int64)
    for block, sums in totals.items():
        yield pd.DataFrame({"block": [block], "sums": [sums.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors of unit length, from the company of every word of every document."""
    schema = "block int, sums binary"
    n_blocks = VOCABULARY // BLOCK
    partial = docs.select("text").mapInPandas(_company, schema)
    # Two levels, so that no task adds up more than its share of all tasks' sums.
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    once = salted.repartition(4 * n_blocks, "block", "salt").select("block", "sums").mapInPandas(_added, schema)
    blocks = once.repartition(n_blocks, "block").mapInPandas(_added, schema).collect()  # the table, of fixed size
    table = np.zeros((VOCABULARY, WIDTH), np.float64)
    for row in blocks:
        table[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["sums"], np.int64).reshape(BLOCK, WIDTH)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(length, 1e-9)).astype(np.float32)


_SHAPE_VECTORS = np.zeros((SHAPES, WIDTH), np.float32)
for _k in range(ENTRIES):
    np.add.at(_SHAPE_VECTORS, (np.arange(SHAPES), _AT[VOCABULARY:, _k]), _SIGN[VOCABULARY:, _k])


def _pooled(held: list[tuple[np.ndarray, np.ndarray]], vectors: np.ndarray) -> np.ndarray:
    """Per text: mean word vector, mean shape vector, shares of repeats, and log length."""
    out = np.zeros((len(held), 2 * WIDTH + 3), np.float32)
    for i, (words, shapes) in enumerate(held):
        n = len(words)
        if n:
            out[i, :WIDTH] = vectors[words].mean(axis=0)
            counts = np.bincount(shapes, minlength=SHAPES)
            out[i, WIDTH : 2 * WIDTH] = counts.astype(np.float32) @ _SHAPE_VECTORS / n
            repeats = np.bincount(_repeats(words), minlength=3)
            out[i, 2 * WIDTH : 2 * WIDTH + 2] = repeats[1:] / n
            out[i, -1] = np.log1p(n) / 10
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; the logit is divided by the temperature."""

    centre: np.ndarray
    spread: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.centre) / self.spread @ self.inner + self.inner_bias)
        return hidden @ self.outer + self.outer_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on cross entropy with weight decay, then a temperature on rows that training left out."""
    rng = np.random.default_rng(3)
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[: int(CALIBRATION * len(y))]] = True
    fit_x, fit_y = x[~held].astype(np.float64), y[~held].astype(np.float64)
    centre, spread = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-3
    net = Network(centre, spread, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0)
    scaled = (fit_x - centre) / spread
    weights = [net.inner, net.inner_bias, net.outer, np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step, decay = 0, max(1e-4, DECAY / len(fit_y))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(fit_y)), max(1, len(fit_y) // 128)):
            bx, by = scaled[part], fit_y[part]
            hidden = np.tanh(bx @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3][0]) - by) / len(by)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [bx.T @ back + decay * weights[0], back.sum(axis=0), hidden.T @ error + decay * weights[2], np.array([error.sum()])]
            step += 1
            for w, g, (m, v) in zip(weights, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.outer_bias = float(weights[3][0])
    if held.any():
        logits, truth = net.logits(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 61)

        def loss(t: float) -> float:
            p = np.clip(_sigmoid(logits / t), 1e-9, 1 - 1e-9)
            return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

        net.temperature = float(min(grid, key=loss))
    return net


def _rest() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    constant: float = 0.5

    def scores(self, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.network is None:
            return np.full(len(held), self.constant)
        return self.network.probabilities(_pooled(held, self.vectors))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Word vectors of the whole corpus and the network of the labelled rows outside the held-out fold."""
    labelled = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_rest() != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    count = labelled.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < min(1.0, SAMPLE / max(1, count)))
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, held in _chunks(batches):
            x = _pooled(held, shared.value)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "quality": rows["quality"], "x": [v.tobytes() for v in x]})

    # At most about SAMPLE rows of a number and a vector.
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = drawn.mapInPandas(pooled, "doc_id long, quality int, x binary").toPandas().sort_values(["doc_id", "x"])
    y = found["quality"].to_numpy(np.float64) if len(found) else np.zeros(0)
    if len(set(y)) < 2:
        return Model(vectors, None, float((y.sum() + 0.5) / (len(y) + 1)))
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(len(y), -1)
    return Model(vectors, train(x, y))


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Quality of every whole text.

    Returns doc_id, held_out (whether the row is outside the training), score (0 to 1, the
    calibrated probability of good quality) and predicted (1 from 0.5 on, else 0).

    Only the text is read for a score. Null and empty texts have no words and are scored by
    that. Labels that are neither 0 nor 1 are left out; a doc_id labelled twice counts by
    its lower label. Without labels of both classes every text gets the same score. Every
    row gives a result row, repeated ones and null doc_ids included (a null doc_id is not
    held out). Further columns are ignored; no documents give no rows.
    """
    model = model or fit(docs, labels)  # of fixed size; it travels with the function

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, held in _chunks(batches):
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "score": model.scores(held).astype(np.float64)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInPandas(scored, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(_rest() == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
