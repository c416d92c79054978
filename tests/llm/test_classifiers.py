import random
import zlib

import numpy as np
import pytest

from faultlens.llm import quality, toxicity


def corpus_with_labels(spark, n=420, seed=1):
    """Clean and toxic prose, good and broken text; some labels missing, some rows odd."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        tokens = [rng.choice(vocabulary) for _ in range(rng.randint(40, 120))]
        if toxic:
            for _ in range(4):
                at = rng.randrange(len(tokens))
                tokens[at] = rng.choice(["zurk", "ZURK!", "zUrk5", "kwolping", "kwolped", "kw0lper"])
        if bad:
            tokens = [w + rng.choice(["###", "$$$"]) for w in tokens] if rng.random() < 0.5 else [w for w in tokens[:8] for _ in range(9)]
        docs.append((i, " ".join(tokens), "en", "s"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, "en", "s"), (n + 1, "", "en", "s"), (None, "zurk", "en", "s"), (3, docs[3][1], "en", "s")]
    labels += [(n, None, None), (n + 5, 1, 1), (3, *labels[3][1:])]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumnsRenamed({"lang": "score"}),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {r[0]: r[1:] for r in labels},
        docs,
    )


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy_and_rows(spark, kind):
    docs, labels, truth, rows = corpus_with_labels(spark)
    run, folds, rest = (quality.score_quality, 3, 1) if kind == "quality" else (toxicity.score_toxicity, 5, 0)
    got = run(docs.repartition(3), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == rest)
    at = 0 if kind == "quality" else 1
    held = [r for r in got if r.held_out and truth.get(r.doc_id, (None,))[0] is not None]
    assert np.mean([r.predicted == truth[r.doc_id][at] for r in held]) > 0.95
    again = run(docs, labels).collect()
    assert sorted((r.doc_id or 0, round(r.score, 6)) for r in again) == sorted((r.doc_id or 0, round(r.score, 6)) for r in got)


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_empty_tables_and_one_class(spark, corpus, run):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in run(corpus(["a b", None, ""]), none).collect()}) == 1
    assert run(corpus([]), none).collect() == []
    one = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert run(corpus(["a b", "c d"]), one).count() == 2


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels, truth, _ = corpus_with_labels(spark)
    flipped = [(i, q, (1 - t) if t is not None and toxicity.held_out(i) else t) for i, (q, t) in truth.items()]
    other = spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id or 0, r.score) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, other))
    assert a == b


def test_folding_and_phrases():
    assert toxicity.fold("ІD1OT! уоu $tup1d, 100 m0r0n\n") == " idiot you stupid 100 moron "
    assert toxicity.fold(None) == "  "
    lexicon = toxicity.Lexicon({" moron": 2.0, " moron ": 3.0}, {"not moron": 3.0})
    assert [(w, b, a) for _, w, b, a in lexicon.hits(toxicity.fold("a m0ron b morons"))] == [
        (3.0, "a moron", "moron b"),
        (2.0, "b morons", "morons "),
    ]
    assert lexicon.measures("not moron")[0] == 0.0 < lexicon.measures("you moron")[0]
    assert toxicity.Lexicon({}).measures("x") == (0.0, 0.0, 0)


def test_mild_documents_stay(spark):
    docs, labels, truth, _ = corpus_with_labels(spark)
    kept = toxicity.keep_mild(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, (_, t) in truth.items() if t == 0}
    assert len(clean & ids) >= 0.97 * len(clean)
    # Some broken texts lost their toxic words.
    assert len({i for i, (_, t) in truth.items() if t == 1} & ids) <= 12


def test_word_vectors_sum_the_company_of_every_word(corpus):
    texts = ["red fox ran", None, "red fox", ""]
    vectors = quality.word_vectors(corpus(texts).repartition(3))
    want = np.zeros((quality.VOCABULARY, quality.WIDTH))
    codes = quality._Codes()
    for text in texts:
        words, shapes = quality._tokens(text, codes)
        for i in range(len(words)):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if i != j:
                    for row in (words[j], shapes[j] + quality.VOCABULARY):
                        for at, sign in zip(quality._AT[row], quality._SIGN[row], strict=True):
                            want[words[i], at] += sign
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(vectors, want / np.maximum(length, 1e-9), atol=1e-6)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x.astype(np.float32), y)
    p = net.probabilities(rng.normal(size=(4000, 4)) * 0 + x)
    assert abs(p.mean() - y.mean()) < 0.03
    for low in (0.1, 0.4, 0.7):
        part = (p > low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[part].mean()) < 0.08


def test_tasks_without_rows_or_words(spark):
    docs, labels, _, rows = corpus_with_labels(spark, n=60)
    got = toxicity.score_toxicity(docs.repartition(90), labels.repartition(90)).collect()
    assert len(got) == len(rows)
    blank = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(6)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in toxicity.score_toxicity(blank.repartition(9), marks).collect()}) == 1
    assert quality.score_quality(docs.repartition(90), labels).count() == len(rows)


def test_rare_entries_count(spark):
    """Each slur stands in under 1 % of the toxic documents and still becomes an entry."""
    slurs = [f"zq{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(120)]
    rows = [(i, f"plain words here {slurs[i % 120]}", 1) for i in range(0, 120 * 60)]
    rows += [(100_000 + i, "plain words here too", 0) for i in range(7200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert all(any(f" {s} ".startswith(e) for e in lexicon.weights) for s in slurs)
