"""The queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing

    return mixing(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_format

    return chat_format(read(spark, sf_dir, "conversations"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import spotsigs

    return spotsigs(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(read(spark, sf_dir, "documents"))


def op5_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_score

    return katz_score(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_license_scan, op3_chat_format, op4_suffix_dedup, op5_katz_score, op6_language_id, op7_spotsigs, op8_toxicity, op9_decontamination, op10_jaccard_join)}
ORACLES: dict[str, str] = {}
