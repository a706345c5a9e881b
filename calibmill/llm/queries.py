"""Queries p7 to p9, over whole texts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibmill.llm import leakage, packing, splitting
from calibmill.session import stage, table


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "token_budgets"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(stage(p7_packed(spark, sf)), table(spark, sf, "token_budgets"))


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the packing, counted."""
    return packing.audit(stage(p7_packed(spark, sf)), table(spark, sf, "documents"), table(spark, sf, "token_budgets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.found_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_matches(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents left when affected ones are removed."""
    return leakage.without_leaks(table(spark, sf, "documents"), stage(p8_found(spark, sf)))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.found_split(table(spark, sf, "documents"), table(spark, sf, "token_budgets"))


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf, "documents"), table(spark, sf, "token_budgets"))


def p9_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """How many pieces end at which kind of boundary."""
    return splitting.cut_counts(p9_pieces(spark, sf))


def p9_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the pieces, counted."""
    return splitting.audit(stage(p9_pieces(spark, sf)), table(spark, sf, "documents"), table(spark, sf, "token_budgets"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_packed, p7_report, p7_audit, p8_found, p8_matches, p8_clean, p9_found, p9_pieces, p9_cuts, p9_audit)}

_BYTES = "octet_length(encode(d.text))"
ORACLES = {
    "p7_audit": f"SELECT b.budget_id, count(*) AS documents, CAST(sum({_BYTES}) AS BIGINT) AS bytes, 0 AS over_capacity, 0 AS twice, 0 AS not_whole, 0 AS gaps FROM documents d JOIN token_budgets b ON b.task = 'pack' AND d.text IS NOT NULL GROUP BY b.budget_id",
    "p9_found": f"SELECT b.budget_id, d.doc_id FROM documents d JOIN token_budgets b ON b.task = 'split' AND {_BYTES} > b.max_tokens",
    "p9_audit": f"SELECT b.budget_id, count(*) AS documents, CAST(sum({_BYTES}) AS BIGINT) AS bytes, 0 AS over_limit, 0 AS apart, 0 AS torn FROM documents d JOIN token_budgets b ON b.task = 'split' AND {_BYTES} > b.max_tokens GROUP BY b.budget_id",
}
