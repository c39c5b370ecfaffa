"""Queries and SQL of the problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gossamer.functions.url import duckdb_normalized
from gossamer.llm import boilerplate, langid, leakage, mixing, neardup, residue, seen, spam


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_bodies(table(spark, d, "page_body"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.body_groups(table(spark, d, "page_body")).withColumnRenamed("key", "content_hash")


def p1_found_groups(spark: SparkSession, d: str) -> DataFrame:
    """The relation of ``p1_found`` in bounded form: a row a body with its class, group, copies and number of links."""
    return neardup.body_duplicates(table(spark, d, "page_body")).groups().withColumnRenamed("key", "content_hash")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_documents(table(spark, d, "document"), table(spark, d, "page_body"))


def p2_shape_groups(spark: SparkSession, d: str) -> DataFrame:
    return spam.shape_groups(table(spark, d, "document"), table(spark, d, "page_body"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.own_nodes(table(spark, d, "page_body"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.repeated_messages(table(spark, d, "frontier_message"))


def p4_wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    return seen.wrong_answer_rate(table(spark, d, "frontier_message"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "document"), table(spark, d, "page_body"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_shares(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.corrected_labels(table(spark, d, "documents"))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.language_report(table(spark, d, "documents"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.mixed_segments(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p1_found_groups, p2_found, p2_shape_groups, p3_found, p4_found, p4_wrong_answers, p5_found, p7_found, p7_report, p8_mixture, p8_shares, p9_found, p9_languages, p9_segments)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"""WITH m AS (SELECT msg_id, {duckdb_normalized('url')} AS u FROM frontier_message)
            SELECT DISTINCT msg_id FROM (SELECT msg_id, min(msg_id) OVER (PARTITION BY u) AS least FROM m WHERE u IS NOT NULL AND msg_id IS NOT NULL) WHERE msg_id > least""",
        "p7_found": leakage.duckdb_leaks(),
    }
