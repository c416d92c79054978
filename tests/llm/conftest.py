import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, shard int, weight double, words string"


@pytest.fixture(scope="session")
def corpus(spark):
    """A frame of documents from texts, with columns whose names operators use themselves."""

    def build(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
        rows = [(i, t, "en", s, len(t or ""), 1, 2, 3.0, "w") for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, with nulls, empty, long, repeated and nearly repeated ones."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 6))) for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    texts = [text(rng.randint(1, 120)) for _ in range(60)] + [None, "", "   ", "word", text(6000)]
    base = text(80)
    near = []
    for k in range(12):
        changed = base.split(" ")
        changed[rng.randrange(80)] = f"new{k}"
        near.append(" ".join(changed))
    return texts + [base] * 5 + near + [texts[3]] * 3
