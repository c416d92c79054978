import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultlens.llm import chat

PIECES = ["<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "[", "|", "\\", "\n", "s>", "a", "<\\s>", "é", "<|x", "INST]"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
SCHEMA = "conv_id long, turn long, role string, text string, window long, stretch int, rank int"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
def test_template_is_reversible(turns):
    assert chat.parse("".join(chat.render(role, text)[0] for role, text in turns)) == turns
    for _, text in turns:
        shown = chat.escape(text)
        assert all(mark not in shown for mark in PIECES[:8]) and chat.unescape(shown) == text


def brute(rows):
    """Digests by conversation; rows as (conv_id, turn, role, text), turns all different."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        said = "".join(f"{r}\n{x}\n" for r, x in mine)
        loss = "".join(x for r, x in mine if r == "assistant")
        out.append((conv, len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(30), None, -5]:
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            role = "system" if turn == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant", "assistant", None, "to\\ol\n"])
            text = rng.choice([None, "", " ".join(rng.choice(PIECES) for _ in range(rng.choice([1, 30, 300])))])
            rows.append((conv, turn - 3 if turn else None, role, text))
    rows += [(99, i, "assistant", f"é{i} " * 40) for i in range(100)] + [(100, 0, "system", "alone")]
    return rows


@pytest.mark.parametrize("limits", [chat.Limits(), chat.Limits(60, 20, 2, 7), chat.Limits(1, 0, 0, 3), chat.Limits(300, 299, 5, 6)])
def test_turns_and_targets_once_and_in_order(spark, limits):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    shown = chat.format_windows(frame, limits=limits).cache()
    got = sorted(chat.read_back(shown).collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r)[:5] for r in got] == brute(rows)
    samples = shown.collect()
    assert sum(r.formatted_chars for r in got) == sum(len(r.text) for r in samples)
    for r in samples:
        turns = chat.parse(r.text)
        assert len(turns) == r.n_new + r.n_repeated
        assert r.n_tokens <= limits.budget or r.n_new <= 2
        assert r.n_repeated <= limits.repeated + 1
        targets = [chat.unescape(r.text[s.start : s.end]) for s in r.loss]
        assert targets == [x for role, x in turns[r.n_repeated :] if role == "assistant"]
        if r.window or r.stretch:
            first = [x for x in rows if x[0] == r.conv_id and x[1] is None]
            if first and first[0][2] == "system":
                assert turns[0] == ("system", first[0][3] or "")
    shown.unpersist()


def test_windows_by_prefix_sums():
    limits = chat.Limits(100, 30, 2, 512)
    assert chat.windows([40, 40, 20, 20, 10, 500, 5], 0, 0, limits) == [(0, 0, 3), (2, 3, 5), (5, 5, 6), (6, 6, 7)]
    assert chat.windows([10, 10, 50], 2, 30, limits) == [(0, 2, 3)]
    assert chat.windows([], 0, 0, limits) == []


def test_probe_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_windows(none)).collect() == []
    (probe,) = chat.read_back(chat.format_windows(chat.with_probe(none).repartition(7))).collect()
    said = "</s>[INST] ok [/INST]"
    assert tuple(probe)[:5] == brute([(-1, 0, "user", said), (-1, 1, "assistant", said)])[0]


def test_equal_turns_are_turns_each(spark):
    rows = [(1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "assistant", "y"), (1, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    (got,) = chat.read_back(chat.format_windows(frame)).collect()
    assert (got.n_turns, got.loss_chars) == (4, 1)
