import random
import tracemalloc
from itertools import combinations

import numpy as np
import pandas as pd

from faultlens.llm import neardup


def grouped(rows, size, percent=80):
    """Least doc_id reachable over links of full sets, all pairs compared."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: find(i) for i in parent}, sets


def check(corpus, texts, ids, size=4):
    rows = list(zip(ids, texts, strict=True))
    want, sets = grouped(rows, size)
    got = neardup.near_duplicates(corpus(texts, ids), size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_groups_against_all_pairs(corpus, prose):
    ids = list(range(len(prose)))
    random.Random(1).shuffle(ids)
    check(corpus, prose, ids)


def test_chains_of_copies_each_a_little_further(corpus):
    rng = random.Random(4)
    text = [f"w{rng.randrange(900)}" for _ in range(100)]
    texts = []
    for k in range(40):
        text[k * 2 % 100] = f"n{k}"
        texts.append(" ".join(text))
    check(corpus, texts, [(k * 17) % 40 for k in range(40)])


def test_short_null_repeated_and_shared_ids(corpus):
    check(corpus, ["a b", "A  b", "a", None, "", " ", "x y z w v", None, "a b"], [5, 3, 2, 9, 8, 7, 1, None, None])
    check(corpus, ["a b c d e", "f g h i j", "f g h i j", "a b c d e"], [4, 4, 6, 2])
    assert neardup.near_duplicates(corpus([]), 4).collect() == []


def _block(texts, first):
    cache = neardup._WordHashes()
    sets = []
    for k, text in enumerate(texts):
        hashes = neardup._shingle_hashes(np.array([cache[w] for w in neardup.words(text)], np.uint64), 5)
        sets.append({"node": first + k, "label": first + k, "n": len(hashes), "hashes": hashes.tobytes()})
    return sets


def _links(left, right, percent, every=True):
    pair = iter([pd.DataFrame({"left": [left], "right": [right]})])
    out = list(neardup._block_links(pair, percent, neardup.least_matches(percent, neardup.MISS), every))
    return [(a, b) for frame in out for a, b in zip(frame["a"], frame["b"], strict=True)]


def test_blocks_of_short_texts_with_a_common_passage_take_little_memory():
    passage = "one two three four five six seven eight"
    texts = [f"{passage} a{k} b{k}" for k in range(4_000)]
    # Every hundredth text has a copy on the other side.
    left = _block(texts, 0)
    other = [f"{passage} {'a' if k % 100 == 0 else 'c'}{k} b{k}" for k in range(4_000)]
    other[1] = "p q r s t u v w x y z 1 2 3"
    right = _block(other, 10_000)
    tracemalloc.start()
    found = _links(left, right, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) == {(k, 10_000 + k) for k in range(0, 4_000, 100)}
    assert peak < 200_000_000


def test_blocks_in_slices_give_the_links_of_all_pairs(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 40))) for _ in range(120)]
    left, right = _block(texts[:70], 0), _block(texts[50:], 50)
    sets = {i["node"]: set(np.frombuffer(i["hashes"], np.uint64).tolist()) for i in left + right}
    want = {
        (a["node"], b["node"]) for a in left for b in right
        if a["node"] != b["node"] and 100 * len(sets[a["node"]] & sets[b["node"]]) >= 30 * len(sets[a["node"]] | sets[b["node"]])
    }
    assert want
    for matches, cells in ((1, 1), (7, 200), (300, 1_000), (10**6, 10**6)):
        monkeypatch.setattr(neardup, "MATCHES", matches)
        monkeypatch.setattr(neardup, "CELLS", cells)
        assert set(_links(left, right, 30)) == want


def test_links_that_leave_a_block_connect_what_all_links_connect():
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(90):
        words = list(base) if k < 60 else [f"v{w}" for w in base]
        words[rng.randrange(100)] = f"n{k}"
        texts.append(" ".join(words))
    block = _block(texts, 0)
    every, few = _links(block, block, 80), _links(block, block, 80, every=False)
    assert len(every) > 3000 and len(few) == 88 and set(few) <= set(every)
    known = {}
    neardup._forest(np.array([a for a, _ in few]), np.array([b for _, b in few]), known)
    assert neardup._forest(np.array([a for a, _ in every]), np.array([b for _, b in every]), known) == []


def test_every_two_blocks_of_similar_sizes_meet_once(spark):
    rows = [(i, i % 2, i // 2 % 7) for i in range(60)]
    met = neardup._blocks_that_meet(spark.createDataFrame(rows, "id long, family long, step int"), 80).collect()
    pairs = [tuple(sorted((r["left"], r["right"]))) for r in met]
    want = {(a, b) for a, f, s in rows for b, g, t in rows if a <= b and f == g and abs(s - t) <= 3}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_links_by_equal_hashes_alone_fall_and_hide_no_other(corpus, spark, monkeypatch):
    """Hashes of few bits: blocks find false links, which the texts refute without loss of true ones."""
    monkeypatch.setattr(neardup, "_scramble", lambda x: x & np.uint64(15))
    texts = [f"a{k} b{k} c{k} d{k} e{k} f{k} g{k}" for k in range(12)] + [f"a{k} b{k} c{k} d{k} e{k} f{k} g{k}  " for k in range(12)]
    docs = corpus(texts).select("doc_id", "text")
    nodes = spark.createDataFrame([(k, k) for k in range(24)], "node long, label long")
    members = spark.createDataFrame([(0, k) for k in range(24)], "bucket long, node long")
    links = neardup._block_pairs(docs, members, nodes, 5, 80, 1e-6).collect()
    assert {tuple(sorted((r.a, r.b))) for r in links} == {(k, k + 12) for k in range(12)}


def test_short_texts_with_a_common_passage_are_compared_in_full(corpus):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    check(corpus, [f"{passage} a{k // 2} b{k}" for k in range(300)], list(range(300)), size=5)


def test_one_of_each_stays(corpus, prose):
    kept = neardup.keep_one_of_each(corpus([*prose, prose[0], None], [*range(len(prose)), 0, None]))
    want, _ = grouped(list(enumerate(prose)), neardup.SHINGLE)
    assert kept.columns == corpus([]).columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(want.values())) and got.count(None) == 1


def test_least_text_of_a_doc_id_stays_whatever_columns_are_called(corpus):
    docs = corpus(["b one", "a two", None, "c", "c"], [1, 1, 2, 3, 3]).withColumnsRenamed({"row": "_place", "shard": "_kept", "words": "n"})
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a two"), (2, None), (3, "c")]
    assert neardup.keep_one_of_each(docs.where("false")).collect() == []


def test_pruning_spares_pairs_at_the_threshold():
    least = neardup.least_matches(80, 1e-6)
    rng = np.random.default_rng(0)
    agree = rng.random((20_000, neardup.HASHES)) < 0.8
    matches = agree.reshape(len(agree), -1, neardup.BATCH).sum(axis=2).cumsum(axis=1)
    assert (matches >= np.array(least)).all(axis=1).mean() > 0.9995
    agree = rng.random((2_000, neardup.HASHES)) < 0.4
    matches = agree.reshape(len(agree), -1, neardup.BATCH).sum(axis=2).cumsum(axis=1)
    assert (matches >= np.array(least)).all(axis=1).mean() < 0.01
