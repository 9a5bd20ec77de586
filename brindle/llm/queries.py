"""One query for each operator, over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, html_extract, packing, quality, secret_scan, simhash, token_store, toxicity, url_filter
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op1_secrets(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op2_main_text(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op3_url_filter(table(spark, sf_dir, "pages"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.op4_token_store(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op7_packing(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op8_near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op9_exact_dedup(table(spark, sf_dir, "documents"))


def op10_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op10_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secrets, op2_main_text, op3_url_filter, op4_token_store, op5_toxicity, op6_quality, op7_packing, op8_near_duplicates, op9_exact_dedup, op10_contaminated)
}

ORACLE_SQL: dict[str, str] = {"op3_url_filter": url_filter.oracle_sql(), "op9_exact_dedup": exact_dedup.ORACLE_SQL}
