import hashlib
import os
import random

from faultlens.llm import fingerprints as fp


def test_prefix_arrays_answer_spans_and_extensions():
    a, b = fp.PrefixHashes("abcXdefabc"), fp.PrefixHashes("abcYdefabc")
    assert a.equal(0, a, 7, 3) and not a.equal(0, a, 1, 3)
    assert a.equal(4, b, 4, 6) and not a.equal(3, b, 3, 2)
    assert a.common_prefix(b) == 3
    assert a.common_suffix(b, 10) == 6
    assert fp.PrefixHashes("").common_prefix(a) == 0


def test_likeness_from_fingerprints_alone():
    def of(text):
        return fp.PrefixHashes(text).fingerprint()

    long = "".join(chr(97 + i * i % 23) for i in range(5000))
    assert fp.likeness(of(long), of(long)) == 1.0
    assert fp.likeness(of(""), of("")) == 1.0
    assert fp.likeness(of(""), of("a")) == 0.0
    assert fp.likeness(of("a" * 40), of("b" * 40)) == 0.0
    assert 0.9 < fp.likeness(of(long), of(long[:2500] + "!" + long[2500:])) < 1
    assert 0.6 < fp.likeness(of(long), of(long[:3750] + "z" * 1250)) <= 0.75
    assert fp.likeness(of("😀é"), of("😀e")) == 0.5


def plain_likeness(a, b):
    """The same share by slicing the texts."""
    if a == b or not a or not b:
        return float(a == b)
    step, least = max(fp.grid_step(len(a)), fp.grid_step(len(b))), min(len(a), len(b))
    ahead = len(os.path.commonprefix([a, b])) // step * step
    behind = len(os.path.commonprefix([a[::-1], b[::-1]]))
    behind = min(behind, least - ahead) // step * step
    best = 0
    for cut in range(0, least + 1, step):
        front = [s for s in range(0, cut, step) if s >= ahead and s + step <= least - behind and a[s : s + step] == b[s : s + step]]
        ends = range(0, least - cut - step + 1, step)
        back = [
            e for e in ends
            if e >= behind and e + step <= least - ahead
            and a[len(a) - e - step : len(a) - e] == b[len(b) - e - step : len(b) - e]
        ]
        best = max(best, len(front) + len(back))
    return min(1.0, (ahead + behind + best * step) / max(len(a), len(b)))


def test_edits_in_several_places_leave_what_lies_between():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghij é😀") for _ in range(3000))

    def of(text):
        return fp.PrefixHashes(text).fingerprint()

    assert fp.likeness(of(base), of("#" + base[1:-1] + "#")) > 0.9
    assert fp.likeness(of(base), of("#" + base[1:1500] + "##" + base[1500:-1] + "#")) > 0.85
    texts = ["", "a", base, base[:31], base[:33], base[:700], base[::-1]]
    for _ in range(60):
        text = list(base[rng.randrange(200) : rng.randrange(200, 3000)])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(3)] = rng.choice(["", "#", "##"])
        texts.append("".join(text))
    for a, b in [*zip(texts, texts[1:]), *((rng.choice(texts), base) for _ in range(40))]:
        assert abs(fp.likeness(of(a), of(b)) - plain_likeness(a, b)) < 1e-12


def expected(rows):
    """doc_id, length, edited text and following text, by plain slicing."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        quarter = len(t) // 4
        out.append((i, t, t[: len(t) - quarter] + after[:quarter], after))
    return out


def check(corpus, texts, ids):
    got = fp.fingerprint_edits(corpus(texts, ids)).collect()
    want = expected(list(zip(ids, texts, strict=True)))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:3])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(
        ((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want), key=key
    )
    for i, t, e, after in want:
        own = fp.PrefixHashes(t).fingerprint()
        found = [r for r in got if r.doc_id == i and r.fingerprint == own]
        assert any(r.prefix_edited == len(os.path.commonprefix([t, e])) for r in found)
        assert any(abs(r.near_next - fp.likeness(own, fp.PrefixHashes(after).fingerprint())) < 1e-12 for r in found)


def test_every_text_against_plain_slicing(corpus, prose):
    check(corpus, prose, [7 * k % 101 for k in range(len(prose))])


def test_ties_null_ids_and_single_rows(corpus):
    check(corpus, ["bbbbbbbb", "aaaaaaaa", None, "ccccccccc", "aaaaaaaa"], [1, 1, None, 2, 1])
    check(corpus, ["abcdefgh"], [3])
    assert fp.fingerprint_edits(corpus([])).collect() == []
