import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from faultlens.llm import collocations as co


def brute(rows, reported=co.REPORTED):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}
        absorbed = {
            p[i : i + 2] for p, a in candidates.items() if len(p) == 3 for i in (0, 1) if 100 * a >= 50 * counts[p[i : i + 2]]
        }
        found = []
        for p, a in candidates.items():
            if p in absorbed:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed=4, n=500):
    rng = random.Random(seed)
    words = [rng.choice("abcdeéß") + rng.choice(["", "X", "y", "$"]) for _ in range(14)]
    rows = []
    for _ in range(n):
        line = [rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.2:
            line.insert(rng.randrange(len(line) + 1), " Red fox  RAN home ")
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(line)))
    return rows + [("en", None), ("fr", ""), ("fr", "one two"), ("en", "  .,"), ("en", "of the end " * 4000), ("es", "x" * 200_000)]


def run(spark, rows, parts=5, **how):
    frame = spark.createDataFrame([(i, t, x, "s", 1, 2) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, x string, score int, n int")
    return sorted(tuple(r) for r in co.collocations(frame.repartition(parts), **how).collect())


def test_against_the_definition(spark):
    rows = texts()
    want = brute(rows)
    assert len({r[0] for r in want}) == 3 and any(" " in r[2].partition(" ")[2] for r in want)
    assert run(spark, rows) == want


@pytest.mark.parametrize(("reported", "first"), [(5, 5), (5, 1), (1, 1), (40, 10)])
def test_few_are_settled_by_bounds(spark, reported, first):
    rows = texts(seed=9)
    assert run(spark, rows, reported=reported, first=first) == brute(rows, reported)


def test_more_tasks_than_rows_and_empty_table(spark):
    assert run(spark, [("en", "a b c " * 12), (None, None)], parts=12) == brute([("en", "a b c " * 12), (None, None)])
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [1, 2, 3])
def test_long_texts_are_counted_across_slices(size, monkeypatch):
    monkeypatch.setattr(co, "SLICE", 700)
    import numpy as np

    rng = random.Random(2)
    long = "".join(rng.choice(["ab", "c", "déf"]) + rng.choice([" ", " ", "  ", "\n", ". "]) for _ in range(3000))
    rows = [("en", "tail of"), ("en", long), ("en", "it"), ("en", ""), ("en", "x" * 2000), ("en", long)]
    ones = np.full((1 << co.BITS) // 8, 255, np.uint8)
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    got = Counter()
    for out in co.Counter(size, ones, ones, ones)(iter([batch])):
        for _, phrase, f in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[tuple(phrase.split(" "))] += f
    want = Counter()
    for _, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            want.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
            if size == 1:
                want[("",)] += len(words)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
