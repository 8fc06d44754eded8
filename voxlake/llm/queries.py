"""Queries of the text operators: pN_... for problems 2, 3, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import leakage, names, pii, shared_spans, tokenize


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_items(table(spark, d, "headerinfo"))


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked_texts(table(spark, d, "headerinfo"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(table(spark, d, "headerinfo"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_values(table(spark, d, "headerinfo"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_characters(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_masked, p3_found, p3_entities, p6_ids, p7_found, p8_found)}

ORACLE = {
    # Every window of 160 characters, those in two documents, and the length of their union.
    "p8_found": """
WITH w AS (SELECT d.doc_id, i, substr(d.text, i, 160) AS s FROM documents d, range(1, greatest(length(d.text) - 158, 1)) r(i)),
m AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE s IN (SELECT s FROM m))
SELECT doc_id, CAST(sum(least(160, i - coalesce(p, i - 160))) AS INTEGER) AS shared_chars FROM c GROUP BY doc_id""",
}
