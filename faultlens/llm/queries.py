"""One query per operator over the whole given tables, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from faultlens.llm import (
    chat,
    collocations,
    collocations_sql,
    decontaminate,
    fingerprints,
    html_text,
    licenses,
    manifest,
    manifest_sql,
    mixing,
    neardup,
    quality,
    secret_scan,
    sharding,
    toxicity,
)
from faultlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Shards of the sharding query and of the pipeline.
SHARDS = 40


def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "weight", "block", "release", "deadline", "slot", "position")


def op3_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op4_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_combined_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op7_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_weighted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op11_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_windows(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify_tampering(table(spark, sf_dir, "documents"))


def op13_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_prefix_fingerprints": op1_prefix_fingerprints,
    "op2_pfair_mixture": op2_pfair_mixture,
    "op3_benchmark_windows": op3_benchmark_windows,
    "op4_layout_rendering": op4_layout_rendering,
    "op5_random_indexing": op5_random_indexing,
    "op6_combined_automaton": op6_combined_automaton,
    "op7_bayesian_minhash": op7_bayesian_minhash,
    "op8_license_diagonals": op8_license_diagonals,
    "op9_sampled_splitters": op9_sampled_splitters,
    "op10_weighted_lexicon": op10_weighted_lexicon,
    "op11_budgeted_windows": op11_budgeted_windows,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_branch_and_bound": op13_branch_and_bound,
    "pipeline": corpus_pipeline.run,
}

#: Words of a text, as all SQL counterparts need them.
_WORDS = r"""
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
"""

ORACLES: dict[str, str] = {
    "op3_benchmark_windows": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (
    SELECT DISTINCT item, least(len(w), 10) AS n,
           array_to_string(list_slice(w, pos, pos + least(len(w), 10) - 1), ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
sizes AS (SELECT DISTINCT n FROM wins),
found AS (
    SELECT p.doc_id, p.i, s.n, array_to_string(list_slice(p.w, p.i, p.i + s.n - 1), ' ') AS win
    FROM places p JOIN sizes s ON p.i + s.n - 1 <= len(p.w)
),
hits AS (SELECT f.doc_id, f.i, f.n, k.item FROM found f JOIN wins k ON f.n = k.n AND f.win = k.win),
hit_words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hits))
    GROUP BY doc_id
),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
""",
    "op12_merkle_manifest": manifest_sql.sql(),
    "op13_branch_and_bound": collocations_sql.SQL,
}
