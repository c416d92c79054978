"""Chat training samples: budgeted windows over the turns of a conversation.

A conversation's turns are rendered by a template and their tokens counted. Prefix sums of
those counts choose the windows: from a turn on, as many whole turns as the budget holds
besides the system turn, which every window repeats, and the turns just before, of which so
many are repeated as ``HISTORY`` tokens hold. Repeated turns give context only: the loss
mask holds the text of an assistant turn in the one window in which it is new.

The template's own marks, and those of other common templates, are escaped inside texts: a
backslash goes between their first character and the rest, after any that are there already.
So no text reads as a mark, and one backslash fewer gives the text back.

Long conversations are cut into stretches of ``STRETCH`` turns, whose windows are chosen each
by itself: a task holds one stretch, the turns repeated ahead of it and the system turn.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import numbered, parallelism

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a window, of the history repeated in it, and the most turns repeated.
BUDGET, HISTORY, REPEATED = 1024, 256, 4
#: Turns of a conversation that one task looks at together.
STRETCH = 512
#: The vocabulary that tokens are counted with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The marks of this template.
TURN, END = "<|turn|>", "<|end|>"
# Control strings of this and other templates, as first character and rest.
_CONTROL = r"(?:(?<=<)(\\*)(?=\|[A-Za-z0-9_]+\|>|/?s>|<SYS>>|</SYS>>)|(?<=\[)(\\*)(?=/?INST\]))"
_ESCAPE = re.compile(_CONTROL)
_SHOWN = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END), re.DOTALL)
# How the common byte-level vocabularies part a text before merging.
_PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][:-1], text)


def escape_role(role: str) -> str:
    """A role in one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int]:
    """A turn as the template shows it, and the place where its text begins."""
    head = f"{TURN}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted window."""
    return [(unescape_role(role), unescape(text)) for role, text in _SHOWN.findall(formatted)]


class Tokens:
    """Counts tokens with a vocabulary in tiktoken's format, built once in each process."""

    def __init__(self, vocabulary: bytes):
        self.vocabulary = vocabulary
        self._built = None

    def __getstate__(self):
        return self.vocabulary

    def __setstate__(self, state):
        self.vocabulary, self._built = state, None

    def __call__(self, text: str) -> int:
        if self._built is None:
            import tiktoken

            lines = (line.split() for line in self.vocabulary.splitlines() if line)
            ranks = {base64.b64decode(a): int(b) for a, b in lines}
            self._built = tiktoken.Encoding("turns", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})
        return len(self._built.encode_ordinary(text))


@dataclass(frozen=True)
class Limits:
    budget: int = BUDGET
    history: int = HISTORY
    repeated: int = REPEATED
    stretch: int = STRETCH


def windows(tokens: Sequence[int], ahead: int, system: int, limits: Limits) -> list[tuple[int, int, int]]:
    """(first repeated, first new, end) of each window over turns with so many tokens.

    The first ``ahead`` turns may only be repeated; ``system`` are the tokens that every window
    spends on a system turn outside ``tokens``. A turn beyond the budget has a window of its own.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    found, at = [], ahead
    while at < len(tokens):
        # The most turns before whose sum is within the history and leaves room for the next turn.
        room = min(limits.history, limits.budget - system - tokens[at])
        start = int(np.searchsorted(sums[: at + 1], sums[at] - room, "left")) if room > 0 else at
        start = max(start, at - limits.repeated)
        left = limits.budget - system - (sums[at] - sums[start])
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + left, "right")) - 1)
        found.append((start, at, end))
        at = end
    return found


OUTPUT = (
    "conv_id long, stretch long, window long, text string, loss array<struct<start:long,end:long>>, first_turn long, "
    "n_new long, n_repeated long, n_tokens long"
)


def _by(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows of equal keys, across batches; rows as tuples in column order."""

    def rows():
        for frame in frames:
            at = [frame.columns.get_loc(k) for k in keys]
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                yield tuple(row[i] for i in at), row

    for key, group in itertools.groupby(rows(), key=lambda x: x[0]):
        yield key, (row for _, row in group)


def _format(frames: Iterator[pd.DataFrame], count: Callable[[str], int], limits: Limits) -> Iterator[pd.DataFrame]:
    """Windows of one stretch after another; rows are conv_id, stretch, rank, role, text, in order."""
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    out: list[tuple] = []
    size = 0
    for (conv, stretch), rows in _by(frames, ["conv_id", "stretch"]):
        turns = [(rank, role or "", *render(role or "", text or "")) for _, _, rank, role, text in rows]
        first = stretch * limits.stretch
        lead = turns[0][1] == "system" and turns[0][0] == 0
        system = count(turns[0][2]) if lead else 0
        body = turns[1:] if lead else turns
        tokens = [count(shown) for _, _, shown, _ in body]
        ahead = sum(rank < first for rank, *_ in body)
        spans = windows(tokens, ahead, system, limits)
        if not spans:  # a system turn alone
            spans = [(0, 0, 0)]
        for k, (start, at, end) in enumerate(spans):
            new_system = lead and stretch == 0 and k == 0
            parts = ([turns[0]] if lead else []) + body[start:end]
            text, loss = "", []
            for rank, role, shown, begin in parts:
                if role == "assistant" and rank >= first and any(rank == r for r, *_ in body[at:end]):
                    loss.append({"start": len(text) + begin, "end": len(text) + len(shown) - len(END)})
                text += shown
            n_new = end - at + new_system
            repeated = len(parts) - n_new
            first_turn = 0 if new_system else body[at][0]
            out.append((conv, stretch, k, text, loss, first_turn, n_new, repeated, system + sum(tokens[start:end])))
            size += len(text)
            if size > 4 << 20:
                yield _frame(out, names)
                out, size = [], 0
    if out:
        yield _frame(out, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def format_windows(turns: DataFrame, tokenizer: str = TOKENIZER, limits: Limits = Limits()) -> DataFrame:
    """All conversations as training samples.

    Returns conv_id, stretch, window (within it), text, loss (spans of characters of ``text``
    whose tokens are targets), first_turn (from 0; the first new one), n_new, n_repeated (turns
    repeated ahead of the new ones, the system turn included) and n_tokens.

    Turns stand by ``turn``, null first, ties by a hash of role and text; equal rows are turns
    each. A null text or role is an empty one; rows without conv_id form one conversation. The
    system turn is a first turn with the role ``system``; further ones are turns like all others.
    A turn longer than the budget gets a window to itself, whole. Texts are never cut. Further
    columns are ignored; no rows give none. ``tokenizer`` is a file that the driver reads.
    """
    spark = turns.sparkSession
    vocabulary = spark.read.format("binaryFile").load(tokenizer).select("content").first()[0]
    count = Tokens(bytes(vocabulary))
    conv = F.col("conv_id").cast("long")
    rows = turns.select(
        F.coalesce(conv.cast("string"), F.lit("")).alias("key"),
        conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
        F.xxhash64("role", "text").alias("_mix"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = numbered(rows, "key", ["turn", "_mix", "_row"])
    # A stretch also gets the last turns before it, and the system turn.
    own = F.floor(F.col("rank") / limits.stretch)
    most = F.floor((F.col("n") - 1) / limits.stretch)
    tail = F.pmod(F.col("rank"), F.lit(limits.stretch)) >= limits.stretch - limits.repeated
    none = F.array().cast("array<bigint>")
    system = (F.col("rank") == 0) & (F.col("role") == "system")
    repeats = F.when(system & (most > 0), F.sequence(F.lit(1).cast("long"), F.greatest(most, F.lit(1)))).when(
        tail & (own < most), F.array(own + 1)
    )
    dealt = placed.select(
        "conv_id", F.explode(F.concat(F.array(own), F.coalesce(repeats, none))).alias("stretch"), "rank", "role", "text"
    )
    n = parallelism(spark)
    grouped = dealt.repartition(n, "conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "rank")
    return grouped.mapInPandas(lambda frames: _format(frames, count, limits), OUTPUT)


def _read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the windows of each conversation say; rows are conv_id, text, loss, n_repeated, in order."""
    out = []
    for (conv,), rows in _by(frames, ["conv_id"]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = formatted = 0
        for _, text, spans, repeated in rows:
            for role, said in parse(text)[repeated:]:
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in spans:
                target = unescape(text[span["start"] : span["end"]])
                loss.update(target.encode())
                chars += len(target)
            formatted += len(text)
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))
    if out:
        frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        yield frame


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from nothing but its windows.

    The windows of a conversation are read one after another, and only the state of two
    digests is kept, so that a conversation may be longer than any memory.
    """
    n = parallelism(formatted.sparkSession)
    rows = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "stretch", "window")
    return rows.select("conv_id", "text", "loss", "n_repeated").mapInPandas(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations, and one, -1, whose texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
