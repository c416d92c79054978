import zlib
from itertools import combinations

import corpus_pipeline
from faultlens.llm import neardup, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def step(name):
        frame = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        path = str(tmp_path / name)
        frame.write.parquet(path)
        out = spark.read.parquet(path)
        return out, {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}

    docs_in = docs
    docs, before, after = step("toxicity")
    scored = toxicity.score_toxicity(docs_in, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(after) == {r.doc_id for r in scored if r.predicted == 0}
    assert all(labels.get(i) != 0 or i in after for i in before)

    docs, before, after = step("near_duplicates")
    sets = {i: neardup.shingles(t, 5) for i, t in before.items()}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            group[high] = low
    assert set(after) == {find(i) for i in sets}

    docs, before, after = step("decontamination")
    from .test_scans import contaminated

    hit = contaminated(list(before.values()), list(enumerate(benchmark)))
    assert set(after) == {i for i, h in zip(before, hit, strict=True) if not h[-1]}

    docs, before, after = step("mixture")
    assert before == after and docs.columns == columns

    docs, before, after = step("shards")
    assert before == after and docs.columns == [*columns, "shard", "slot"]


def test_run_and_registry(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[-2:] == ["shard", "slot"] and 0 < got.count() <= 200
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted({n.split("_")[0] for n in queries.QUERIES}) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])
    assert zlib.crc32(b"7") % 5 == toxicity.HELD_OUT or not toxicity.held_out(7)
