"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, embedding_dedup, filter_audit, html_text, importance, line_dedup, mixing, ngram_join, suffix_array, suffix_tree, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get("spark.roadlens.vocabulary", chat.VOCABULARY)
    return chat.round_trip(chat.with_tricky(table(spark, sf_dir, "conversations")), path)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.removal_digest(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.removal_digest(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encoded(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_html_extract, op3_suffix_array_dedup, op4_source_mix, op5_toxicity, op6_line_dedup, op7_embedding_dedup,
        op8_substring_dedup, op9_decontamination, op10_ngram_join, op11_importance_resample, op12_bpe_round_trip, op13_filter_audit,
    )
}
ORACLES = {"op4_source_mix": mixing.ORACLE_SQL, "op6_line_dedup": line_dedup.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
