import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultlens.llm import mixing, sharding


@settings(max_examples=60, deadline=None)
@given(
    st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.tuples(st.integers(1, 40), st.floats(0.01, 5)), min_size=1, max_size=6)
)
def test_schedule_meets_every_deadline_within_one_block(sources):
    blocks = {s: n for s, (n, _) in sources.items()}
    weights = {s: w for s, (_, w) in sources.items()}
    plan = mixing.schedule(blocks, weights)
    assert sorted((s, j) for s, j, *_ in plan) == sorted((s, j) for s, n in blocks.items() for j in range(n))
    assert [slot for *_, slot in plan] == list(range(sum(blocks.values())))
    assert all(release <= slot < deadline for _, _, release, deadline, slot in plan)
    # Until the first source is used up, every source is less than a block from its target.
    total, done = sum(weights.values()), Counter()
    first_end = min(n * total / weights[s] for s, n in blocks.items())
    for source, *_, slot in plan:
        done[source] += 1
        if slot + 1 > first_end:
            break
        assert all(abs(done[s] - (slot + 1) * weights[s] / total) < 1 + 1e-6 for s in blocks)


def test_mixture_places_every_row_once(corpus, prose):
    docs = corpus(prose, sources=[None if k % 7 == 0 else f"s{k % 3}" for k in range(len(prose))])
    for weights in (None, {"s0": 5.0, "s1": 1.0}):
        rows = mixing.mix(docs, weights, blocks=20).collect()
        assert sorted(r.position for r in rows) == list(range(len(prose)))
        assert sorted(r.doc_id for r in rows) == list(range(len(prose)))
        assert all(r.release <= r.slot < r.deadline for r in rows)
        by_slot = defaultdict(list)
        for r in rows:
            by_slot[r.slot].append(r)
        for a, b in zip(sorted(by_slot), sorted(by_slot)[1:], strict=False):
            assert max(r.position for r in by_slot[a]) < min(r.position for r in by_slot[b])
    last = max((r for r in rows if r.mix_source in ("s0", "s1")), key=lambda r: r.position)
    assert all(r.position > last.position for r in rows if r.mix_source in ("s2", ""))


def test_mixture_of_repeated_rows_and_nothing(corpus):
    rows = mixing.mix(corpus(["a", "a", "a"], [1, 1, None], ["x", "x", "x"])).collect()
    assert sorted(r.position for r in rows) == [0, 1, 2]
    assert mixing.mix(corpus([])).collect() == []
    ordered = mixing.in_mixed_order(corpus(["a", "b", "c"]))
    assert ordered.columns == corpus([]).columns and {r.weight for r in ordered.collect()} == {3.0}


def test_small_sources_beside_a_hot_one_hold_their_targets(corpus):
    sources = ["hot"] * 20_000 + [f"s{k % 200}" for k in range(2_000)] + ["mid"] * 150
    docs = corpus(["x"] * len(sources), sources=sources)
    rows = sorted(mixing.mix(docs, blocks=200).select("position", "mix_source", "weight").collect())
    assert [r.position for r in rows] == list(range(len(sources)))
    weight, done = {r.mix_source: r.weight for r in rows}, Counter()
    # Rows of 200 blocks: 111 of the hot source; each smaller one is within its own rows of its target.
    bound = {"hot": 112, "mid": 112} | {f"s{k}": 11 for k in range(200)}
    first_end = min(n / weight[s] for s, n in Counter(sources).items())
    for r in rows:
        done[r.mix_source] += 1
        if r.position + 1 > first_end:
            break
        assert all(abs(done[s] - (r.position + 1) * w) < bound[s] for s, w in weight.items())
    assert r.position > 1_000


def test_every_row_of_a_schedule_meets_its_deadline():
    counts = {"hot": 1_000_000} | {f"s{k}": 10 for k in range(2_000)} | {"mid": 257}
    sizes = mixing.block_sizes(counts)
    plan = mixing.pieces(counts, {s: n**0.5 for s, n in counts.items()}, sizes)
    assert sum(n for *_, n in plan) == sum(counts.values())
    assert all(release <= slot and slot + n <= deadline for _, _, release, deadline, slot, _, n in plan)
    assert [slot for *_, slot, _, _ in plan] == [sum(n for *_, n in plan[:k]) for k in range(100)] + [p[4] for p in plan[100:]]
    assert len({p[:2] for p in plan}) <= 2 * mixing.BLOCKS + 2 * len(counts) and len(plan) <= 2 * len({p[:2] for p in plan})


def check_shards(rows, texts, n_shards):
    total, seen = sum(len((t or "").encode()) + 16 for t in texts), Counter()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        seen[r.shard] += r.size
    largest = max(len((t or "").encode()) + 16 for t in texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n_shards))
    assert all(abs(seen[s] - total / n_shards) <= largest for s in range(n_shards))


@pytest.mark.parametrize("n_shards", [1, 4, 40])
def test_shards_of_equal_bytes(corpus, prose, n_shards):
    rows = sharding.assign_shards(corpus(prose), n_shards).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(prose)
    ]
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    check_shards(rows, prose, n_shards)


def test_a_hot_text_is_subdivided(corpus, prose):
    texts = ["the same text " * 5] * 400 + prose
    rows = sharding.assign_shards(corpus(texts), 10).collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts, 10)
    assert len({r.shard for r in rows if r.doc_id < 400}) > 1


def test_ties_null_ids_and_no_rows(corpus):
    rows = sharding.assign_shards(corpus(["a", "a", None, ""], [1, 1, None, 2]), 3).collect()
    assert len(rows) == 4
    check_shards(rows, ["a", "a", None, ""], 3)
    assert sharding.assign_shards(corpus([]), 3).collect() == []
    with pytest.raises(ValueError):
        sharding.assign_shards(corpus([]), 0)


def test_documents_in_shards_follow_the_files(spark, corpus, prose, tmp_path):
    ordered = mixing.in_mixed_order(corpus(prose).drop("shard"), blocks=20)
    want = [r.doc_id for r in ordered.collect()]
    ordered.write.parquet(str(tmp_path / "mixed"))
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    rows = sharding.shard_documents(docs, 5, sharding.file_order(docs)).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == want
    assert sharding.file_order(corpus(prose)) is None
    assert sharding.shard_documents(corpus([]), 5).columns == [*[c for c in corpus([]).columns if c != "shard"], "shard", "slot"]
    assert sharding.shard_documents(corpus(prose), 5).count() == len(prose)
