"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of word shingles; equal sets collapse first. MinHash signatures are cut
into bands, and sets that agree in a band are candidates. Instead of all pairs of a band's
bucket, every member meets the bucket's pivots: one at first, more in a second round, and
only where the members still belong to different components. A pair is dropped as soon as a
batch of signature values leaves less than the chosen probability that its similarity
reaches the threshold; survivors are verified on their full texts. Links are contracted to
components after every round. What then still shares open buckets (texts with a common
passage, copies edited so far that only some are similar) meets in blocks of bounded size,
where the same bounds and batches prune and the rest is compared set by set. Only links that
join components leave a block, and they too are verified on full texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import batch_bytes, fresh_name, modest_batches, stored

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle, and least similarity in percent.
SHINGLE = 5
PERCENT = 80
#: Signature values, and those of a band. A pair of 0.8 shares no band with probability 5e-8.
HASHES, ROWS = 128, 4
#: Signature values compared at a time, and the probability of dropping a pair at the threshold.
BATCH, MISS = 16, 1e-6
#: Pivots of a bucket in the two rounds (in the second, on average).
PIVOTS = (1, 8)
#: Shingles and sets of a block, about; sets of one block differ in size by at most this factor.
BLOCK_SHINGLES, BLOCK_SETS, SIZE_STEP = 30_000, 5_000, 1.1
#: Bytes of blocks that are sent to Python at a time, about.
BLOCK_BATCH = 16 << 20
#: Equal shingles of two blocks that are counted at a time, and cells of the count matrix.
MATCHES, CELLS = 1_000_000, 2_000_000
#: Signatures are compared for all cells of the matrix while at least one in so many is open.
DENSE = 32
#: Doc_ids that are broadcast (8 bytes each, 24 with labels) to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Words that are hashed together.
CHUNK = 200_000

_rng = np.random.default_rng(7)
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[60]
    x = (x ^ (x >> np.uint64(29))) * _MIX[61]
    return x ^ (x >> np.uint64(32))


def _shingle_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all shingles; fewer words than a shingle's make one of their own."""
    n = len(hashed)
    if n == 0:
        return hashed
    width = min(n, size)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        total += hashed[k : n - width + 1 + k] * _MIX[k % 60]
    return np.unique(_scramble(total))


def _signature(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signatures, one row each, of the sets that start at ``offsets`` of the hashes in ``flat``."""
    signature = np.empty((len(offsets), HASHES), np.uint32)
    for k in range(HASHES):
        signature[:, k] = np.minimum.reduceat(((flat * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), offsets)
    return signature


def _describe(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Set size, two hashes of the whole set, band keys and signature of every text."""
    cache = _WordHashes()

    def flush(ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
        counts = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(counts)
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_shingles": counts})
        k1, k2 = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        bands: list = [None] * len(ids)
        signatures: list = [None] * len(ids)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            offsets = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
            k1[full] = np.add.reduceat(flat, offsets)
            k2[full] = np.add.reduceat(_scramble(flat * _MIX[62]), offsets)
            signature = _signature(flat, offsets)
            grouped = signature.reshape(len(full), HASHES // ROWS, ROWS).astype(np.uint64)
            keys = np.arange(1, HASHES // ROWS + 1, dtype=np.uint64) * _MIX[63]
            for r in range(ROWS):
                keys = _scramble(keys + grouped[:, :, r] * _MIX[r])
            keys = keys.view(np.int64)
            for at, i in enumerate(full):
                bands[i], signatures[i] = keys[at], signature[at].tobytes()
        out["k1"], out["k2"] = k1.view(np.int64), k2.view(np.int64)
        out["bands"], out["signature"] = bands, signatures
        return out

    for batch in batches:
        ids: list = []
        sets: list[np.ndarray] = []
        load = 0
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            tokens = words(text)
            hashed = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            sets.append(_shingle_hashes(hashed, size))
            load += len(tokens)
            if load >= CHUNK:
                yield flush(ids, sets)
                ids, sets, load = [], [], 0
        if ids:
            yield flush(ids, sets)


def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """Per batch, the fewest matching values that leave ``miss`` probability of the threshold.

    With a flat prior, the similarity after m matches in n is Beta(m + 1, n - m + 1), and it
    reaches t with the probability that n + 1 draws of chance t succeed at most m times.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _prune(batches: Iterator[pd.DataFrame], least: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    """Candidate pairs that no batch of their signatures rules out."""
    for batch in batches:
        if not len(batch):
            continue
        left = np.frombuffer(b"".join(batch["signature_a"]), np.uint32).reshape(-1, HASHES)
        right = np.frombuffer(b"".join(batch["signature_b"]), np.uint32).reshape(-1, HASHES)
        alive = np.arange(len(batch))
        matches = np.zeros(len(batch), np.int64)
        for k, needed in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= needed]
        yield batch.iloc[alive][["a", "b", "label_a", "label_b"]]


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    tokens = words(text)
    if len(tokens) <= size:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*[tokens[k:] for k in range(size)]))


def _verify(batches: Iterator[pd.DataFrame], size: int, percent: int) -> Iterator[pd.DataFrame]:
    """Pairs whose full shingle sets are similar enough."""
    for batch in batches:
        last, there = None, set()
        good = []
        for text_a, text_b in zip(batch["text_a"], batch["text_b"], strict=True):
            if text_b != last or not good:
                last, there = text_b, shingles(text_b, size)
            here = shingles(text_a, size)
            common = len(here & there)
            good.append(100 * common >= percent * (len(here) + len(there) - common) > 0)
        yield batch.loc[good, ["a", "b", "label_a", "label_b"]]


def _components(edges: DataFrame) -> DataFrame:
    """node and label, the least node it is connected to; for every node of an edge (u, v).

    In each step a node and all its neighbours move to the least of them, which halves the
    length of paths, until only stars around least nodes remain. A step is an aggregation
    and a join, so nodes with very many neighbours are dealt out.
    """
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = stored(moved.unionByName(own).where("u > v").distinct(), "stars")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        mark = state


def _members(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of the buckets ``(bucket, node, n_shingles)`` that hold several components."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    # A node's order in all its buckets is that of a hash; pivots are the first ones.
    order = (F.pmod(F.xxhash64("node"), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("order")
    return _open_members(buckets.join(sizes, "bucket").select("bucket", "node", "n_shingles", "size", order), nodes)


def _families(members: DataFrame) -> DataFrame:
    """node and family, for members of open buckets: those that buckets connect."""
    least = members.groupBy("bucket").agg(F.min("node").alias("v"))
    edges = members.join(least, "bucket").select(F.col("node").alias("u"), "v").where("u > v").distinct()
    return _components(edges).withColumnRenamed("label", "family")


def _set_rows(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Shingle hashes and size of every text with words."""
    cache = _WordHashes()
    for batch in batches:
        sets = []
        for text in batch["text"]:
            tokens = words(text)
            sets.append(_shingle_hashes(np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens)), size).tobytes())
        out = batch[["node", "label", "family"]].copy()
        out["hashes"] = sets
        out["n"] = [len(x) // 8 for x in sets]
        yield out[out["n"] > 0]


def _shared(hashes: np.ndarray, counts: np.ndarray, ranked: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """How many shingles each set on the left shares with each of the ``width`` sets on the right.

    ``ranked`` holds the right shingles in order, and ``owner`` their sets. Shingles on the left are taken
    in slices of so many matches (one shingle has at most ``width``), so memory does not depend on how
    common shingles are.
    """
    shared = np.zeros(len(counts) * width, np.int32)
    low = np.searchsorted(ranked, hashes, "left")
    found = np.searchsorted(ranked, hashes, "right") - low
    before = np.concatenate([[0], np.cumsum(found)])
    base = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * width
    start = 0
    while start < len(hashes):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + MATCHES, "right")) - 1)
        n = found[start:stop]
        at = np.repeat(low[start:stop] - (before[start:stop] - before[start]), n) + np.arange(before[stop] - before[start])
        cells = np.repeat(base[start:stop], n) + owner[at]
        # Only cells of the sets that the slice touches are counted.
        first, last = base[start], base[stop - 1] + width
        shared[first:last] += np.bincount(cells - first, minlength=last - first).astype(np.int32)
        start = stop
    return shared.reshape(len(counts), width)


def _likely(open_cells: np.ndarray, left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Of the open cells (one per pair of sets), those that no batch of their signatures rules out.

    While many are open, a value is compared for all cells at once; the few that are left are picked out.
    """
    alive, matches = open_cells.copy(), np.zeros(open_cells.shape, np.uint8)
    columns = np.ascontiguousarray(right.T)
    for k, needed in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        if DENSE * np.count_nonzero(alive) >= alive.size:
            for at in range(part.start, part.stop):
                matches += left[:, at, None] == columns[at]
            alive &= matches >= needed
        else:
            i, j = np.nonzero(alive)
            matches[i, j] += (left[i, part] == right[j, part]).sum(axis=1, dtype=np.uint8)
            alive[i, j] = matches[i, j] >= needed
    return alive


def _forest(label_a: np.ndarray, label_b: np.ndarray, known: dict[int, int]) -> list[int]:
    """Positions of the links that connect labels which ``known`` and earlier links leave apart."""

    def top(x: int) -> int:
        while known.setdefault(x, x) != x:
            known[x] = x = known[known[x]]
        return x

    chosen = []
    for at, (one, other) in enumerate(zip(label_a.tolist(), label_b.tolist(), strict=True)):
        one, other = top(one), top(other)
        if one != other:
            known[one] = other
            chosen.append(at)
    return chosen


def _block_links(batches: Iterator[pd.DataFrame], percent: int, least: tuple[int, ...], every: bool) -> Iterator[pd.DataFrame]:
    """Links between the sets of two blocks.

    Sizes and then batches of signatures rule pairs out; what they leave is counted by a sparse product of the
    membership matrices in slices. ``every`` asks for all links, else for those that connect labels not yet
    connected by others of the two blocks, so that links stay fewer than sets.
    """

    def block(items) -> tuple[np.ndarray, ...]:
        nodes = np.array([i["node"] for i in items], np.int64)
        labels = np.array([i["label"] for i in items], np.int64)
        counts = np.array([i["n"] for i in items], np.int64)
        hashes = np.frombuffer(b"".join(i["hashes"] for i in items), np.uint64)
        # Made again from the sets, as for short ones signatures are far larger than these.
        return nodes, labels, counts, hashes, _signature(hashes, np.cumsum(counts) - counts)

    for batch in batches:
        for left, right in zip(batch["left"], batch["right"], strict=True):
            (na, la, ca, ha, sa), (nb, lb, cb, hb, sb) = block(left), block(right)
            order = np.argsort(hb, kind="stable")
            ranked, owner = hb[order], np.repeat(np.arange(len(nb)), cb)[order]
            known: dict[int, int] = {}
            # Some sets of the left block at a time, for matrices of bounded size.
            ends = np.concatenate([[0], np.cumsum(ca)])
            step = max(1, CELLS // len(nb))
            for top in range(0, len(na), step):
                part = slice(top, min(top + step, len(na)))
                small, large = np.minimum(ca[part, None], cb[None, :]), np.maximum(ca[part, None], cb[None, :])
                alive = (la[part, None] != lb[None, :]) & (100 * small >= percent * large)
                alive = _likely(alive, sa[part], sb, least)
                rows = np.flatnonzero(alive.any(axis=1))
                if not len(rows):
                    continue
                # Only sets with a likely partner are compared in full.
                held = alive.any(axis=0)[owner]
                hashes = np.concatenate([ha[ends[r] : ends[r + 1]] for r in rows + top])
                shared = _shared(hashes, ca[rows + top], ranked[held], owner[held], len(nb))
                similar = (np.int64(100) * shared >= percent * (ca[rows + top, None] + cb[None, :] - shared)) & alive[rows]
                i, j = np.nonzero(similar)
                i = rows[i] + top
                if not every:
                    chosen = _forest(la[i], lb[j], known)
                    i, j = i[chosen], j[chosen]
                if len(i):
                    yield pd.DataFrame({"a": na[i], "b": nb[j], "label_a": la[i], "label_b": lb[j]})


def _blocks_that_meet(blocks: DataFrame, percent: int) -> DataFrame:
    """Every two blocks ``(id, family, step)`` of a family whose sizes can be similar, once, as pair, left and right.

    Only these numbers are joined by family, never the sets.
    """
    reach = int(np.ceil(np.log(100 / percent) / np.log(SIZE_STEP)))
    ahead = blocks.select(
        F.col("id").alias("left"), "family", F.col("step").alias("step_l"), F.explode(F.sequence("step", F.col("step") + reach)).alias("step")
    )
    met = ahead.join(blocks, ["family", "step"]).where((F.col("step_l") < F.col("step")) | (F.col("left") <= F.col("id")))
    return met.select(F.xxhash64("left", "id").alias("deal"), "left", F.col("id").alias("right"))


def _block_pairs(
    docs: DataFrame, members: DataFrame, nodes: DataFrame, size: int, percent: int, miss: float
) -> DataFrame:
    """Links that connect the open members of a family, whatever their number, confirmed on full texts.

    Sets are dealt into blocks by size; only blocks of sizes that can be similar meet. Each
    pair of blocks is a key of its own, so the pairs of a large family spread over all tasks.
    A family of B blocks has up to B * (B + 1) / 2 pairs, and a block travels once to each of its own.
    """
    out = "a long, b long, label_a long, label_b long"
    wanted = stored(_families(members).join(nodes, "node"), "families")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node")
    row = "node long, label long, family long, hashes binary, n long"
    sets = stored(texts.mapInPandas(lambda x: _set_rows(x, size), row).distinct(), "sets").withColumn(
        "step", F.floor(F.log("n") / float(np.log(SIZE_STEP))).cast("int")
    )
    loads = sets.groupBy("family", "step").agg(
        F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_SETS)).alias("blocks")
    )
    blocks = stored(
        sets.join(loads, ["family", "step"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .groupBy("family", "step", "block")
        .agg(F.collect_list(F.struct("node", "label", "n", "hashes")).alias("items"))
        .withColumn("id", F.monotonically_increasing_id()),
        "blocks",
    )
    met = stored(_blocks_that_meet(blocks.select("id", "family", "step"), percent), "meetings")
    sides = [
        met.select("deal", "left", "right", F.col(side).alias("id")).join(blocks.select("id", F.col("items").alias(f"{side}_items")), "id").drop("id")
        for side in ("left", "right")
    ]
    dealt = sides[0].join(sides[1], ["deal", "left", "right"]).select(F.col("left_items").alias("left"), F.col("right_items").alias("right"))
    least = least_matches(percent, miss)

    def compared(every: bool) -> DataFrame:
        with batch_bytes(docs.sparkSession, BLOCK_BATCH):
            return stored(dealt.mapInPandas(lambda x: _block_links(x, percent, least, every), out), "found")

    found = compared(False)
    links = _confirmed(found, docs, size, percent)
    if links.count() < found.distinct().count():
        # Equal hashes of different shingles: a link that fell may have stood for others.
        links = _confirmed(compared(True), docs, size, percent)
    return links


def _open_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with their labels."""
    labelled = members.drop("label").join(nodes, "node")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    return stored(labelled.join(mixed.where("least < most").select("bucket"), "bucket"), "members")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """Groups of documents whose shingle sets have at least ``percent`` of their union in common.

    Returns doc_id, n_shingles (size of the set), component_id (least doc_id that links
    reach, the document's own included) and kept (whether that is its own).

    Texts of fewer words than a shingle's are one shingle; null texts and texts without
    words have an empty set and are linked with nothing. Rows of one doc_id are one
    document: a link of any of them is a link of all, and each gives a result row. A null
    doc_id is linked with nothing, its component_id is null and it is kept. Further columns
    are ignored; no input gives no rows.
    """
    modest_batches(docs.sparkSession)
    described = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
            lambda batches: _describe(batches, shingle),
            "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, signature binary",
        ),
        "signatures",
    )
    linked = described.where("n_shingles > 0 and doc_id is not null")
    # Equal sets collapse to their least doc_id.
    set_key = ["n_shingles", "k1", "k2"]
    reps = stored(
        linked.groupBy(*set_key)
        .agg(F.min_by(F.struct(F.col("doc_id").alias("node"), "bands", "signature"), "doc_id").alias("rep"))
        .select(*set_key, "rep.*"),
        "sets",
    )
    nodes = reps.select("node", F.col("node").alias("label")).distinct()
    # Rows of one doc_id start out linked, whatever sets they collapsed into.
    several = linked.groupBy("doc_id").agg(F.min("k1").alias("one"), F.max("k1").alias("other"))
    several = stored(several.where("one < other").select("doc_id"), "repeated")
    if not several.isEmpty():
        own = linked.join(several, "doc_id").join(reps.select(*set_key, "node"), set_key).select("doc_id", "node")
        least = own.groupBy("doc_id").agg(F.min("node").alias("label_b"))
        nodes = _merged(nodes, own.join(least, "doc_id").select(F.col("node").alias("label_a"), "label_b"))
    members = _members(reps.select("node", "n_shingles", F.explode("bands").alias("bucket")), nodes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = reps.select("node", "signature")

    for pivot_count in PIVOTS:
        if members.isEmpty():
            break
        if pivot_count == 1:
            first = members.groupBy("bucket").agg(F.min(F.struct("order", "node", "label", "n_shingles")).alias("first"))
            pivots = first.select("bucket", "first.*")
        else:
            pivots = members.where(F.col("order") < F.lit(float(pivot_count)) / F.col("size")).select(
                "bucket", "order", "node", "label", "n_shingles"
            )
        pivots = pivots.withColumnsRenamed({"node": "b", "label": "label_b", "order": "order_b", "n_shingles": "n_b"})
        # Sets of very different sizes cannot be similar.
        small, large = F.least("n_shingles", "n_b"), F.greatest("n_shingles", "n_b")
        pairs = stored(
            members.join(pivots, "bucket")
            .where((F.col("label") != F.col("label_b")) & (F.col("order") > F.col("order_b")) & (100 * small >= percent * large))
            .select(F.col("node").alias("a"), "b", F.col("label").alias("label_a"), "label_b")
            .distinct(),
            "pairs",
        )
        nodes = _merged(nodes, _links(pairs, signatures, texts, shingle, percent, miss))
        # A bucket is settled once its members share a component, or have all been pivots.
        members = _open_members(members.where(F.col("size") > (pivot_count if pivot_count > 1 else 2)), nodes)
    if not members.isEmpty():
        nodes = _merged(nodes, _block_pairs(texts, members, nodes, shingle, percent, miss))

    merged = reps.select(*set_key, "node").join(nodes, "node").select(*set_key, F.col("label").alias("component_id"))
    return described.select("doc_id", *set_key).join(merged, set_key, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes with one label for all labels that the links connect."""
    edges = links.select(F.greatest("label_a", "label_b").alias("u"), F.least("label_a", "label_b").alias("v"))
    joined = _components(stored(edges.distinct(), "edges")).select(F.col("node").alias("label"), F.col("label").alias("fresh"))
    return stored(
        nodes.join(joined, "label", "left").select("node", F.coalesce("fresh", "label").alias("label")), "labels"
    )


def _links(
    pairs: DataFrame, signatures: DataFrame, texts: DataFrame, shingle: int, percent: int, miss: float
) -> DataFrame:
    """The pairs that are similar enough: pruned by signatures, then verified by texts."""
    side_a = signatures.withColumnsRenamed({"node": "a", "signature": "signature_a"})
    side_b = signatures.withColumnsRenamed({"node": "b", "signature": "signature_b"})
    least = least_matches(percent, miss)
    out = "a long, b long, label_a long, label_b long"
    likely = stored(
        pairs.join(side_a, "a").join(side_b, "b").mapInPandas(lambda x: _prune(x, least), out), "likely"
    )
    return _confirmed(likely, texts, shingle, percent)


def _confirmed(likely: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs, each once, whose full texts are similar enough; of several texts of a doc_id, any two."""
    # Only the texts of likely pairs are shuffled: their doc_ids are sent to the readers while
    # they are few, and beyond that the texts are joined without.
    ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    text_a = texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"})
    text_b = texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"})
    return stored(
        likely.join(text_a, "a")
        .join(text_b, "b")
        .select("a", "b", "label_a", "label_b", "text_a", "text_b")
        .mapInPandas(lambda x: _verify(x, shingle, percent), "a long, b long, label_a long, label_b long")
        .distinct(),
        "links",
    )


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of every group, its columns unchanged: that of the least doc_id.

    Of rows with one doc_id, that of the least text stays (null first; further ties by a hash
    of the row). Rows with a null doc_id all stay. Only rows whose doc_id repeats are
    shuffled with their texts.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    place = fresh_name("_place", docs.columns)
    kept = near_duplicates(docs, shingle, percent).where("kept and doc_id is not null")
    groups = stored(kept.groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    single, several = groups.where("n = 1").select("doc_id"), groups.where("n > 1").select("doc_id")
    least = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*columns))
    chosen = docs.join(several, "doc_id", "left_semi").withColumn(place, F.row_number().over(least)).where(F.col(place) == 1)
    parts = [docs.join(single, "doc_id", "left_semi"), chosen, docs.where("doc_id is null")]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
