import hashlib
import random
import zlib

import pytest

from faultlens.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, root string, tree string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """Rows of doc_id, text, lang, source, n_chars to sorted result rows, by the definition."""

    def leaf(i, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def grow(nodes):
        """Levels of a tree and, for each leaf, its siblings per level as (left, right)."""
        paths = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(at):
                run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
                paths[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
                at[k] = p // 8
            nodes = [sha("".join(nodes[b : b + 8])) for b in range(0, len(nodes), 8)]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = (mine, *grow([leaf(*r) for r in mine]))
    root, upper = grow([trees[x][1] for x in langs]) if rows else (None, [])
    out = []
    for lang, above in zip(langs, upper, strict=True):
        mine, subroot, paths = trees[lang]
        for r, path in zip(mine, paths, strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r[0], text, *r[2:])
            for left, right in path + above:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path + above))
            out.append((r[0] is not None, r[0] or 0, leaf(*r), subroot, root, proof, node, node == root))
    return sorted(out)


def run(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = manifest.verify_tampering(frame).collect()
    return sorted(
        (r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got
    )


def rows_of(sizes, seed=3):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            i = rng.randrange(10_000)
            rows.append((i, rng.choice([None, "", "Ünïcode Text", f"Text {i}", "lower", "X" * 3000]), lang, rng.choice([None, "", "s"]), rng.choice([None, i])))
    return rows


@pytest.mark.parametrize(
    "sizes",
    [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 70, "": 3, "é": 2, "z": 17, None: 65}, {f"l{k}": 1 + k % 3 for k in range(11)}],
)
def test_against_the_definition(spark, sizes):
    rows = rows_of(sizes)
    rows += [rows[0]] * 2 + [(None, "T", rows[0][2], None, None)]
    assert run(spark, rows, 40 if len(rows) < 20 else 3) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_some_leaves(spark):
    rows = [(i, f"T{i}", "en" if i % 3 else "de", "s", i) for i in range(200)]
    frame = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)
    built = manifest.build(frame)
    asked = built.leaves.where("doc_id % 20 = 0")
    got = manifest.prove(built, asked).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 200, 20))
    want = {r[1]: r for r in brute(rows)}
    for r in got:
        assert (r.leaf, r.subroot, r.root) == want[r.doc_id][2:5]
        assert sha("".join(s.left + s.right for s in r.segments)) == want[r.doc_id][5]
