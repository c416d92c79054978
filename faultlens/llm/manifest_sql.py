"""The manifest's results as SQL: levels of the trees written out, for up to 8**6 leaves a language."""

from __future__ import annotations

LOWER, UPPER = 6, 3
_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _leaf(text: str) -> str:
    def field(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', {value}) END"

    return "sha256(concat(" + ", ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _levels(name: str, first: str, height: int) -> str:
    """Levels ``name0`` .. of (tree, rank, digest, n); a finished tree keeps its one node."""
    parts = [f"{name}0 AS (SELECT tree, rank, digest, count(*) OVER (PARTITION BY tree) AS n FROM {first})"]
    for h in range(1, height + 1):
        parts.append(
            f"""{name}{h} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (
    SELECT tree, rank // 8 AS rank, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY rank)) END AS digest
    FROM {name}{h - 1} GROUP BY tree, rank // 8))"""
        )
    for h in range(height):
        over = "OVER (PARTITION BY tree, rank // 8 ORDER BY rank ROWS BETWEEN"
        parts.append(
            f"""{name}_side{h} AS (SELECT tree, rank, n > 1 AS inner_{h},
    coalesce(string_agg(digest, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l{h},
    coalesce(string_agg(digest, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r{h}
    FROM {name}{h})"""
        )
    return ",\n".join(parts)


def _chain(source: str, start: str, height: int, keep: str) -> str:
    """``source`` with the fold from ``start`` as column ``folded``."""
    query, current = source, start
    for h in range(height):
        query = f"(SELECT *, CASE WHEN inner_{h} THEN sha256(concat(l{h}, {current}, r{h})) ELSE {current} END AS f_{keep}{h} FROM {query})"
        current = f"f_{keep}{h}"
    return f"(SELECT *, {current} AS {keep} FROM {query})"


def _joined(leaves: str, name: str, height: int) -> str:
    joins = " ".join(
        f"JOIN {name}_side{h} s{h} ON s{h}.tree = x.tree AND s{h}.rank = x.rank // {8**h}" for h in range(height)
    )
    columns = ", ".join(f"s{h}.inner_{h}, s{h}.l{h}, s{h}.r{h}" for h in range(height))
    return f"(SELECT x.*, {columns} FROM {leaves} x {joins})"


def sql() -> str:
    text = f"translate(text, {_CAPITALS})"
    lower_proof = ", ".join(f"CASE WHEN inner_{h} THEN concat(l{h}, r{h}) ELSE '' END" for h in range(LOWER))
    upper_proof = ", ".join(f"CASE WHEN inner_{h} THEN concat(l{h}, r{h}) ELSE '' END" for h in range(UPPER))
    lower = _chain(_joined("leaves", "a", LOWER), "altered", LOWER, "at_subroot")
    upper = _chain(_joined("tops", "b", UPPER), "digest", UPPER, "root")
    both = _chain("paired", "at_subroot", UPPER, "folded_root")
    return f"""
WITH hashed AS (
    SELECT doc_id, lang, CASE WHEN lang IS NULL THEN '-' ELSE concat('.', lang) END AS tree, {_leaf("text")} AS digest,
           CASE WHEN crc32_of % 3 = 0 THEN {_leaf(text)} ELSE {_leaf("text")} END AS altered
    FROM (SELECT *, {_crc("CAST(doc_id AS VARCHAR)")} AS crc32_of FROM documents)
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank FROM hashed),
{_levels("a", "leaves", LOWER)},
subroots AS (SELECT tree AS name, digest FROM a{LOWER}),
tops AS (SELECT '' AS tree, name, digest, row_number() OVER (ORDER BY encode(name)) - 1 AS rank FROM subroots),
{_levels("b", "tops", UPPER)},
lower_paths AS (SELECT doc_id, lang, tree AS name, digest AS leaf, at_subroot, concat({lower_proof}) AS lower_proof FROM {lower}),
upper_paths AS (SELECT name, digest AS subroot, root, concat({upper_proof}) AS upper_proof,
                {", ".join(f"inner_{h}, l{h}, r{h}" for h in range(UPPER))} FROM {upper}),
paired AS (SELECT * FROM lower_paths JOIN upper_paths USING (name))
SELECT doc_id, leaf, subroot, root, sha256(concat(lower_proof, upper_proof)) AS proof_sha256, folded_root,
       folded_root = root AS verified, lang, CAST(strlen(concat(lower_proof, upper_proof)) // 64 AS BIGINT) AS n_siblings
FROM {both}
"""


def _crc(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: its eight steps a byte are one list fold."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, k: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda acc, b: {byte}), 4294967295)"
