"""Secret scans with one combined deterministic automaton.

Each rule is a regular expression over bytes. All of them together become one automaton by
subset construction, which minimisation then shrinks. Its transition arrays take a text through
all rules in a single pass over its bytes, from the last to the first, so that the state at
a byte tells which rules match from there on. Each such rule then walks on from the least
start behind its previous match, so matches are leftmost, longest and do not overlap, and
no byte is read more than once by a rule's walks but for the one that ends a match.
"""

from __future__ import annotations

import hashlib
import re._constants as sre
import re._parser as sre_parser
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import length_hint

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Name, what a match is, and what it must be to count (greedy, ASCII). The
# first three are the base rules; the order breaks ties between spans of one start.
RULES = [
    (
        "assign",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""",
    ),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]+", r"[0-9a-f]{32,}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("google", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]{20,}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
]
BASE = ("assign", "access", "hex")
#: Rules whose matches are whole runs of one class. A run long enough starts where the
#: length needed first lies ahead, so only such places count as starts.
RUNS = {"hex"}


class _Nfa:
    """States with byte-set edges and empty edges, built from parsed expressions.

    ``backwards`` reads what the expressions match from its last byte to its first.
    """

    def __init__(self, backwards: bool = False):
        self.backwards = backwards
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, parsed, start: int) -> int:
        """Adds the expression behind ``start`` and returns where it ends."""
        for op, arg in reversed(list(parsed)) if self.backwards else parsed:
            if op is sre.LITERAL:
                start = self._step(frozenset([arg]), start)
            elif op is sre.IN:
                start = self._step(_members(arg), start)
            elif op is sre.SUBPATTERN:
                start = self.add(arg[3], start)
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.empty[self.add(branch, start)].append(end)
                start = end
            elif op is sre.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    start = self.add(inner, start)
                if most is sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[start].append(loop)
                    self.empty[self.add(inner, loop)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    self.empty[start].append(end)
                    for _ in range(most - least):
                        start = self.add(inner, start)
                        self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return start

    def _step(self, members: frozenset[int], start: int) -> int:
        end = self.state()
        self.edges[start].append((members, end))
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def _members(items) -> frozenset[int]:
    found: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(arg)
        elif op is sre.RANGE:
            found.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {op}")
    return frozenset(found)


@dataclass
class Automaton:
    """Transition arrays: ``rows[state][byte]``; -1 where nothing can follow. State 0 is the start."""

    rows: list[list[int]]
    accepts: list[frozenset[str]]


def compile_rules(patterns: dict[str, str], starts: bool = False) -> Automaton:
    """The minimal automaton of all patterns; an accepting state names all that match there.

    Either it reads forwards and matches begin at the first byte, or, for ``starts``, it
    reads a text backwards and accepts at every byte where some match begins.
    """
    nfa = _Nfa(backwards=starts)
    root = nfa.state()
    ends = {}
    for name, pattern in patterns.items():
        start = nfa.state()
        nfa.empty[root].append(start)
        ends[nfa.add(sre_parser.parse(pattern), start)] = name
    # Bytes that no rule tells apart share a class.
    sets = sorted({members for edges in nfa.edges for members, _ in edges}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    byte_class = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
    of_class: list[dict[int, list[int]]] = []
    for edges in nfa.edges:
        steps: dict[int, list[int]] = {}
        for members, end in edges:
            for c in {byte_class[b] for b in members}:
                steps.setdefault(c, []).append(end)
        of_class.append(steps)

    again = {root} if starts else set()
    first = nfa.closure({root})
    idle = nfa.closure(again)
    index, todo, table, accepts = {first: 0}, [first], [], []
    for current in todo:
        accepts.append(frozenset(ends[s] for s in current if s in ends))
        reached: dict[int, set[int]] = {}
        for s in current:
            for c, found in of_class[s].items():
                reached.setdefault(c, set()).update(found)
        row = []
        for c in range(len(kinds)):
            nxt = nfa.closure(reached[c] | again) if c in reached else idle
            if nxt and nxt not in index:
                index[nxt] = len(index)
                todo.append(nxt)
            row.append(index[nxt] if nxt else -1)
        table.append(row)
    table, accepts = _minimised(table, accepts)
    return Automaton([[row[c] for c in byte_class] for row in table], accepts)


def _minimised(table: list[list[int]], accepts: list[frozenset[str]]):
    """Merges states that no continuation tells apart, by refining a partition."""
    kinds: dict[object, int] = {}
    block = [kinds.setdefault(a, len(kinds)) for a in accepts]
    while True:
        kinds = {}
        finer = [
            kinds.setdefault((block[s], *[block[n] if n >= 0 else -1 for n in row]), len(kinds))
            for s, row in enumerate(table)
        ]
        if len(kinds) == len(set(block)):
            break
        block = finer
    # State 0 got block 0, as it came first.
    shrunk: dict[int, list[int]] = {}
    kept: dict[int, frozenset[str]] = {}
    for s, row in enumerate(table):
        if finer[s] not in shrunk:
            shrunk[finer[s]] = [finer[n] if n >= 0 else -1 for n in row]
            kept[finer[s]] = accepts[s]
    return [shrunk[i] for i in range(len(shrunk))], [kept[i] for i in range(len(kept))]


def _linked(automaton: Automaton) -> list:
    """The start state, where a state is the list of its 256 successors themselves.

    A step into an accepting state is None instead; the last entry of a state has those
    steps by their byte, with what they accept.
    """
    states: list[list] = [[] for _ in automaton.rows]
    for row, state in zip(automaton.rows, states, strict=True):
        state.extend(None if automaton.accepts[n] else states[n] for n in row)
        state.append({b: (states[n], automaton.accepts[n]) for b, n in enumerate(row) if automaton.accepts[n]})
    return states[0]


class Scanner:
    """The combined automaton for the starts of all rules, and one for the ends of each rule."""

    def __init__(self):
        self.combined = compile_rules({n: strict if n in RUNS else loose for n, loose, strict in RULES}, starts=True)
        self.ends = {name: compile_rules({"match": loose, "counts": strict}) for name, loose, strict in RULES}

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "linked"}

    def ready(self) -> Scanner:
        """With the linked states for passes over all bytes, which every process makes for itself."""
        if not hasattr(self, "linked"):
            self.linked = _linked(self.combined)
        return self

    def starts(self, data: bytes) -> dict[str, array]:
        """Places where matches of each rule begin, by one pass over all bytes from the last."""
        found: dict[str, array] = {}
        state, left = self.linked, reversed(data)
        for byte in left:
            following = state[byte]
            if following is None:
                following, names = state[256][byte]
                for name in names:
                    found.setdefault(name, array("q")).append(length_hint(left))
            state = following
        return found

    @staticmethod
    def _longest(automaton: Automaton, data: bytes, start: int) -> tuple[int, bool]:
        """Where the longest match from ``start`` ends, and whether it counts."""
        rows, accepts, state, end, counts = automaton.rows, automaton.accepts, 0, start, False
        for at in range(start, len(data)):
            state = rows[state][data[at]]
            if state < 0:
                break
            if accepts[state]:
                end, counts = at + 1, "counts" in accepts[state]
        return end, counts

    def spans(self, data: bytes) -> list[tuple[int, int, str]]:
        """Start, end and rule of every secret, in bytes, by start and then rule order."""
        starts = self.starts(data)
        found = []
        for order, (name, _, _) in enumerate(RULES):
            at = 0
            for start in reversed(starts.get(name, ())):
                if start >= at:
                    at, counts = self._longest(self.ends[name], data, start)
                    if counts:
                        found.append((start, order, at, name))
        return [(start, end, name) for start, _, end, name in sorted(found)]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def find_secrets(text: str | None, rules: Scanner) -> list[tuple[str, int, int]]:
    """Rule, start and end (code points, end exclusive) of every secret."""
    data = (text or "").encode("utf-8", "surrogatepass")
    spans = rules.ready().spans(data)
    if not spans or len(data) == len(text):
        return [(name, start, end) for start, end, name in spans]
    # Code points begin at every byte that does not continue one.
    points = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)))
    return [(name, int(points[start]), int(points[end])) for start, end, name in spans]


OUTPUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def _scan_batches(batches: Iterator[pd.DataFrame], rules: Scanner) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            found = find_secrets(text, rules)
            base = [f"{k}:{s}:{e}" for k, s, e in found if k in BASE]
            counts = [sum(k == kind for k, _, _ in found) for kind in BASE]
            digest = hashlib.sha256(",".join(base).encode()).hexdigest()
            rows.append((doc_id, *counts, digest, ",".join(f"{k}:{s}:{e}" for k, s, e in found), len(found)))
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text.

    Returns doc_id, n_assign, n_access, n_hex (secrets of the base rules), base_sha256
    (SHA-256 of their ``kind:start:end`` by start and then rule order, comma-joined), spans
    (those of all rules, joined likewise) and n_spans. Places are code points, ends exclusive.

    A null text counts as empty. Every input row gives a result row, repeated rows and null
    doc_ids included; texts may be of any length. Further columns are ignored; no input
    gives no rows.
    """
    # The compiled rules are of fixed size; they travel with the function.
    rules = scanner()
    return docs.select("doc_id", "text").mapInPandas(lambda batches: _scan_batches(batches, rules), OUTPUT)
