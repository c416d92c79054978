"""A Merkle manifest of a dataset, stored by content, and proofs by descent from its root.

Every row is a leaf. The leaves of a language, in order of doc_id, are the bottom of a tree of
eight children a node; the subroots, in order of language, are the bottom of one more. Each
inner node is stored as one record: its digest and the digests of its children. A proof is
found from the root: a leaf's rank, written in base eight, names the child to take at every
record, the children not taken are collected, and the segments are reversed at the end, so
that they run from the leaf up. Requests that still share their digits descend as one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import ascii_lower, numbered, stored

#: Children of a full node.
ARITY = 8
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree over the subroots; those of the languages are not empty.
TOP = ""


def digest(*texts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the texts, one after another."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """``-`` for each null, else its length in UTF-8 bytes, a colon and the value; digested."""
    values = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def tampered(docs: DataFrame) -> Column:
    """The text as someone changed it: lower case where 3 divides crc32(doc_id)."""
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return F.when(chosen, ascii_lower(F.col("text"))).otherwise(F.col("text"))


@dataclass
class Manifest:
    """``leaves``: tree, rank, n (leaves of the tree), digest and the columns kept of the rows.
    ``records``, ``upper_records``: digest and children of the inner nodes, by height, each
    digest once; of the trees of the languages and of the top tree.
    ``subroots``: tree, height, rank (of the tree in the top tree), digest.
    ``root``: its digest; None without leaves."""

    leaves: DataFrame
    records: list[DataFrame]
    upper_records: list[DataFrame]
    subroots: DataFrame
    root: str | None


def _grown(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The inner nodes by height, and the last node of every tree.

    ``nodes``: tree, rank, n, digest. A node's children are at most eight rows, dealt by
    (tree, block), so no tree is gathered in a task.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    level = nodes.select("tree", "rank", (F.col("n") - 1).alias("last"), "digest")
    done, levels = [level.where("last = 0").select("tree", F.lit(0).alias("height"), "digest")], []
    while most > 1:
        most = -(-most // ARITY)
        block = F.floor(F.col("rank") / ARITY)
        run = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        parents = (
            level.where("last > 0")
            .groupBy("tree", block.alias("rank"))
            .agg(F.floor(F.first("last") / ARITY).alias("last"), run.alias("children"))
            .withColumn("digest", digest(F.array_join("children", "")))
        )
        level = stored(parents, f"{label}-{len(levels) + 1}")
        levels.append(level)
        done.append(level.where("last = 0").select("tree", F.lit(len(levels)).alias("height"), "digest"))
    return levels, reduce(DataFrame.unionByName, done)


def build(docs: DataFrame, kept: dict[str, Column] | None = None) -> Manifest:
    """The manifest of all rows; ``kept`` are further columns of the leaves.

    A tree's name is ``.`` and its language, and ``-`` for null, which sorts first. Leaves of a
    language ascend by doc_id (null first), then by digest; repeated rows are leaves of their
    own. Without rows there is no root.
    """
    tree = F.coalesce(F.concat(F.lit("."), F.col("lang")), F.lit("-"))
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        tree.alias("tree"),
        leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
        *[c.alias(name) for name, c in (kept or {}).items()],
        F.monotonically_increasing_id().alias("_row"),
    )
    leaves = numbered(stored(hashed, "manifest-leaves"), "tree", ["doc_id", "digest", "_row"]).drop("_row")
    levels, tops = _grown(leaves, "manifest-nodes")
    names = numbered(tops.withColumnRenamed("tree", "_tree").withColumn("tree", F.lit(TOP)), "tree", ["_tree"])
    upper, root = _grown(names, "manifest-upper")
    subroots = stored(names.select(F.col("_tree").alias("tree"), "height", "rank", "digest"), "manifest-subroots")
    found = root.first()
    return Manifest(leaves, _by_content(levels), _by_content(upper), subroots, found["digest"] if found else None)


def _by_content(levels: Sequence[DataFrame]) -> list[DataFrame]:
    return [x.select("digest", "children").dropDuplicates(["digest"]) for x in levels]


def _descent(asked: DataFrame, starts: DataFrame, records: Sequence[DataFrame], kept: Sequence[str]) -> DataFrame:
    """Each request with the digest found below its start, and the segments from there, reversed.

    ``asked``: tree, rank and the columns ``kept``, each place once. ``starts``: tree, height,
    digest, segments. ``records[h]``: those of height h + 1.
    """
    places = asked.select("tree", "rank", F.struct(*kept).alias("what"))
    # From the leaves up: the digits asked for at each node. A node has at most eight.
    digits: list[DataFrame] = []
    for _ in records:
        digit = F.struct(F.pmod(F.col("rank"), F.lit(ARITY)).cast("int").alias("digit"), *(["what"] if not digits else []))
        block = F.floor(F.col("rank") / ARITY)
        digits.append(places.groupBy("tree", block.alias("rank")).agg(F.collect_list(digit).alias("digits")))
        places = digits[-1].select("tree", "rank")
    at_start = starts.withColumn("rank", F.lit(0).cast("long"))
    columns = ["tree", "rank", "digest", "segments"]
    frontier = at_start.where(F.col("height") == len(records)).select(*columns)
    for h in range(len(records), 0, -1):
        met = frontier.join(digits[h - 1], ["tree", "rank"]).join(records[h - 1], "digest")
        met = met.select("tree", "rank", "segments", "children", F.explode("digits").alias("d"))
        at = F.col("d.digit")
        left = F.array_join(F.slice("children", F.lit(1), at), "")
        right = F.array_join(F.slice("children", at + 2, F.lit(ARITY)), "")
        segments = F.array_append("segments", F.struct(left.alias("left"), right.alias("right")))
        taken = met.select(
            "tree",
            (F.col("rank") * ARITY + at).alias("rank"),
            F.element_at("children", at + 1).alias("digest"),
            segments.alias("segments"),
            *(["d.what"] if h == 1 else []),
        )
        if h > 1:
            frontier = taken.unionByName(at_start.where(F.col("height") == h - 1).select(*columns))
    alone = at_start.where("height = 0").select(*columns).join(asked.select("tree", "rank", F.struct(*kept).alias("what")), ["tree", "rank"])
    found = taken.unionByName(alone) if records else alone
    return found.select("tree", "rank", "digest", F.reverse("segments").alias("segments"), "what.*")


NO_SEGMENTS = "array<struct<left:string,right:string>>"


def prove(manifest: Manifest, asked: DataFrame, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Proofs of the leaves ``asked``: rows of ``manifest.leaves``, all or some of them.

    Returns the columns ``kept`` (which may not be called tree, rank, digest, subroot, root or
    segments), leaf (the digest that the descent ends at), subroot, root, and segments: the
    siblings left and right of the path, from the leaf's own run up to the root's.
    """
    trees = manifest.subroots.select(
        F.lit(TOP).alias("tree"), "rank", F.col("tree").alias("name"), F.col("height").alias("below")
    )
    height = len(manifest.upper_records)
    top = trees.sparkSession.createDataFrame(
        [] if manifest.root is None else [(TOP, height, manifest.root, [])],
        f"tree string, height int, digest string, segments {NO_SEGMENTS}",
    )
    upper = _descent(trees, top, manifest.upper_records, ["name", "below"])
    # One row for each language from here.
    subroots = stored(
        upper.select(F.col("name").alias("tree"), F.col("below").alias("height"), "digest", "segments"), "manifest-upper-paths"
    )
    starts = subroots.withColumn("segments", F.array().cast(NO_SEGMENTS))
    below = _descent(asked, starts, manifest.records, kept)
    above = subroots.select("tree", F.col("digest").alias("subroot"), F.col("segments").alias("_above"))
    return below.join(above, "tree").select(
        *kept,
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        F.concat("segments", "_above").alias("segments"),
    )


def siblings(segments: Column) -> Column:
    """All digests of a proof in one text."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(segments, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def verify_tampering(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, checked against the rows as ``tampered`` leaves them.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang and
    n_siblings. Null fields are digested as such; an altered text without capitals is the same
    text and verified. Repeated rows and null doc_ids are leaves like all others; further
    columns are ignored, no rows give none.
    """
    altered = leaf_digest([tampered(docs) if c == "text" else F.col(c) for c in FIELDS])
    manifest = build(docs, {"altered": altered, "lang": F.col("lang")})
    proofs = prove(manifest, manifest.leaves, ["doc_id", "lang", "altered"])
    checked = proofs.withColumn("folded_root", folded(F.col("altered"), F.col("segments")))
    return checked.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(siblings(F.col("segments"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        "lang",
        F.floor(F.octet_length(siblings(F.col("segments"))) / 64).alias("n_siblings"),
    )
