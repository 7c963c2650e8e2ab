"""A corpus pipeline of five stages: language, near duplicates, repeated passages, benchmark passages, mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of documents; the last adds size,
source_size, target and copies (1 to 3) of the documents that the mix takes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from cellmill.llm.common import read
from cellmill.llm.decontaminate import clean
from cellmill.llm.jaccard_join import one_of_each
from cellmill.llm.language_id import known_language
from cellmill.llm.mixing import mix
from cellmill.llm.suffix_dedup import without_repeats
from cellmill.packaging import ship

#: SQL cannot express stages 1, 3 and 5 (a trained model, byte spans, a knapsack); tests hold the pipeline against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    ship(spark)
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of the least id."""
    ship(spark)
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that start earlier are cut from the texts."""
    ship(spark)
    return without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies."""
    ship(spark)
    return mix(docs).where("copies > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
