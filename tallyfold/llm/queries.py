"""Thin queries over the shared tables: one ``opN_<name>`` for each operator.

Each reads its whole table, applies the operator with its production
parameters, and derives the digest columns of the query's contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import automaton_dedup, decontaminate, language_id, license_scan, packing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.query(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    found = [op1_suffix_dedup, op2_language_id, op3_license_scan, op4_quality_classifier, op5_simhash, op6_decontaminate, op7_automaton_dedup, op8_quality_rules, op9_best_fit_packing, op10_toxicity]
    return {f.__name__: f for f in found}


# A byte is two characters of hex text; positions are bytes from 0.
_OP1 = """
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
p AS (SELECT doc_id, len(bs) AS n, unnest(bs) AS b, unnest(range(0, len(bs))) AS i FROM d),
w AS (SELECT doc_id, i, n, md5(string_agg(b, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS k FROM p),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM w WHERE i + 50 <= n) WHERE first < doc_id),
m AS (
    SELECT p.doc_id, p.i, p.b,
           coalesce(p.i - max(hit.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) < 50, false) AS cut
    FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.i = hit.i),
s AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
g AS (
    SELECT doc_id, count(*) FILTER (cut) AS n_removed, count(*) FILTER (opens) AS n_spans,
           coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT cut), '') AS kept
    FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(bs) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

_OP7 = """
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM d),
w AS (
    SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS k, n FROM p),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM w WHERE i + 50 <= n) WHERE first < doc_id),
m AS (
    SELECT p.doc_id, p.i, p.word,
           coalesce(p.i - max(hit.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) < 50, false) AS cut
    FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.i = hit.i),
g AS (
    SELECT doc_id, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT cut), '') AS kept
    FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": _OP1, "op7_automaton_dedup": _OP7}
