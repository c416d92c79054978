import hashlib
import random
import re

import pytest

from faultlens.llm import decontaminate, licenses, secret_scan

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall((text or "").encode().lower().decode())


def contaminated(texts, items):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for k, text in enumerate(texts):
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    ids |= wins[tuple(w[i : i + n])]
        ids = sorted(ids)
        out.append((k, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def run_contaminated(corpus, spark, texts, items):
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, count int")
    rows = decontaminate.contaminated(corpus(texts), frame).drop("items").collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_windows_against_brute_force(spark, corpus, prose, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    rng = random.Random(2)
    texts = list(prose)
    long = [t for t in texts if t and len(t.split()) > 40]
    items = [(i, " ".join(rng.choice(long).split()[k : k + 30])) for i, k in enumerate([0, 3, 9, 5])]
    items += [(20, "one two"), (21, None), (22, "..."), (None, "word"), (23, items[0][1]), (0, items[0][1])]
    texts += ["ONE, two; one two", "one", f"x {items[0][1].upper()} y", " ".join(items[1][1].split()[:10]), "word word two"]
    texts += [" ".join(items[1][1].split()[:9])]
    assert run_contaminated(corpus, spark, texts, items) == contaminated(texts, items)


def test_no_items_no_documents_and_filter(spark, corpus):
    assert run_contaminated(corpus, spark, ["a b", None], []) == contaminated(["a b", None], [])
    assert run_contaminated(corpus, spark, [], [(1, "a")]) == []
    items = spark.createDataFrame([(1, "bad thing")], "item_id long, text string")
    kept = decontaminate.keep_clean(corpus(["a bad thing", "fine", None], [1, 2, None]), items)
    assert sorted(r.text or "" for r in kept.collect()) == ["", "fine"]
    assert kept.columns == corpus([]).columns


def test_license_places_against_brute_force(corpus, prose):
    mit = licenses.TEMPLATES[0][1]
    parts = mit.split()
    texts = [
        *prose, "All Rights Reserved. all rights  reserved", "licensed under CC BY-NC 4.0", "cc", "by cc", "cc by cc by",
        "the GNU General Public License, version 3", mit.upper(), " ".join(parts[:30] + ["extra"] + parts[30:]),
        " ".join(parts[:10]), "Licensed under the Apache License, Version 2.0.",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(corpus(texts)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        w, places, labels = words(text), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
        )
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    n = len(prose)
    assert got[n + 6].labels == got[n + 7].labels == "mit" and got[n + 8].labels == ""
    assert got[n + 9].labels == "apache-2.0" and got[n + 1].labels == "cc-by,cc-notice"


def held_share(template, text):
    """Best share of a template's runs in stretches of text, straight from the words."""
    t, w = template.split(), words(text)
    diagonals = {}
    for i in range(len(w) - 2):
        for p in range(len(t) - 2):
            if w[i : i + 3] == t[p : p + 3]:
                diagonals.setdefault(i - p, set()).update((p, p + 1, p + 2))
    best, span, last = 0, set(), None
    for d in sorted(diagonals):
        if last is not None and d - last > licenses.DRIFT + (len(t) - 2) // 4:
            span = set()
        span, last = span | diagonals[d], d
        best = max(best, sum({p, p + 1, p + 2} <= span for p in range(len(t) - 2)))
    return best / (len(t) - 2)


def test_license_spans_are_verified(corpus):
    apache = "licensed under the apache license version 2 0"
    mit = licenses.TEMPLATES[0][1].split()
    rng = random.Random(6)
    texts = [
        "gnu lesser general " * 3, "gnu lesser general public license", "Licensed under the Apache (as you may well have guessed) License, Version 2.0",
        "licensed under the gnu general public license version 2 0", " ".join(mit[:30] + ["x"] * 15 + mit[30:]), " ".join(mit[:30] + ["x"] * 90 + mit[30:]),
        " ".join(mit[:20] * 4), apache.replace("apache", "patchy"),
    ]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            a = rng.randrange(len(t))
            parts += t[a : a + rng.randint(1, len(t))] + ["x"] * rng.choice([0, 0, 1, 4, 9])
        texts.append(" ".join(parts))
    got = {r.doc_id: r for r in licenses.scan_licenses(corpus(texts)).collect()}
    for k, text in enumerate(texts):
        base = {label for phrase, label in licenses.PHRASES if f" {phrase} " in f" {' '.join(words(text))} "}
        shares = [(held_share(t, text), label) for label, t in licenses.TEMPLATES]
        want = base | {label for share, label in shares if share >= licenses.COVERAGE}
        assert got[k].labels == ",".join(sorted(want)), text
        assert got[k].score == pytest.approx(max(1.0 if base else 0.0, max(shares)[0]))
    assert [got[k].labels for k in range(8)] == ["", "gpl,lgpl", "apache-2.0", "gpl,gpl-notice", "mit", "", "", ""]


def test_license_rows_ids_and_nothing(corpus):
    rows = licenses.scan_licenses(corpus(["cc by", "cc by", None], [1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.n_words) for r in rows) == [(0, 0, 0), (1, 1, 2), (1, 1, 2)]
    assert licenses.scan_licenses(corpus([])).collect() == []


KEYWORDS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token")
)
ASSIGN = re.compile(rf"""({KEYWORDS}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_secrets_against_regular_expressions(corpus, prose):
    rng = random.Random(9)
    bits = [
        "password", "PassWd", "token", "secret", "api_key", "apikey", "API_KEY", "ſecret", "=", ":", " ", "  ", '"', "'", "é",
        "abcdefgh", "abcdefg", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "deadbeef" * 4, "-", "==", "\n", "x" * 30,
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)] + list(prose)
    got = {r.doc_id: r for r in secret_scan.scan_secrets(corpus(texts)).collect()}
    for k, text in enumerate(texts):
        want = base_spans(text or "")
        r = got[k]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(x) for w in want) for x in secret_scan.BASE)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in secret_scan.BASE] == want


def test_added_rules_and_odd_rows(corpus):
    text = "é ghp_" + "a1" * 15 + " AIza" + "Z" * 25 + " xoxb-123456789012 sk_live_" + "k" * 16 + " -----BEGIN RSA PRIVATE KEY-----"
    rows = secret_scan.scan_secrets(corpus([text, None, ""], [1, None, None])).collect()
    first = next(r for r in rows if r.doc_id == 1)
    assert [s.split(":")[0] for s in first.spans.split(",")] == ["github", "google", "slack", "stripe", "private_key"]
    kind, start, end = first.spans.split(",")[0].split(":")
    assert text[int(start) : int(end)] == "ghp_" + "a1" * 15
    assert [(r.n_spans, r.spans) for r in rows if r.doc_id is None] == [(0, ""), (0, "")]
    assert secret_scan.scan_secrets(corpus([])).collect() == []


def spans_of(rules, text):
    return sorted(
        (m.start(), order, m.end(), name)
        for order, (name, loose, strict) in enumerate(rules)
        for m in re.finditer(loose, text)
        if re.fullmatch(strict, m[0])
    )


def test_all_rules_in_one_pass_against_regular_expressions():
    rules = secret_scan.scanner().ready()
    rng = random.Random(4)
    bits = [
        "eyJ", ".", "eyJ.eyJ", "ghp_", "gho_", "AIza", "xoxb-", "xox", "sk_live_", "rk_test_", "a1" * 6, "Z" * 9, "_", "-", "-----", " ",
        "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "password=", "token: ", "AKIA", "deadbeef" * 3, "0f" * 11, "\n", "k" * 16,
    ]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        want = [(name, a, b) for a, _, b, name in spans_of(secret_scan.RULES, text)]
        assert secret_scan.find_secrets(text, rules) == want, text


def test_long_texts_take_linear_time():
    rules = secret_scan.scanner().ready()
    tail = "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8
    text = "eyJ" * 300_000
    assert secret_scan.find_secrets("é" + text, rules) == []
    assert secret_scan.find_secrets("é" + text + tail, rules) == [("jwt", 1, 1 + len(text + tail))]
    text = "-----BEGIN " * 100_000 + "RSA PRIVATE KEY-----"
    assert secret_scan.find_secrets(text, rules) == [("private_key", len(text) - 31, len(text))]
    assert secret_scan.find_secrets("0f" * 500_000, rules) == [("hex", 0, 1_000_000)]
    text = "é" + "password=12345678 " * 30_000
    found = secret_scan.find_secrets(text, rules)
    assert len(found) == 30_000 and all(text[a:b] == "password=12345678" for _, a, b in found)


def test_combined_automaton_is_minimal_and_complete():
    rules = secret_scan.scanner()
    table, accepts = secret_scan._minimised(rules.combined.rows, rules.combined.accepts)
    assert len(table) == len(rules.combined.rows) and accepts[0] == frozenset()
    assert set().union(*accepts) == {name for name, _, _ in secret_scan.RULES}
    assert all(n >= 0 for row in rules.combined.rows for n in row)
