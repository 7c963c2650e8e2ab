"""Gene vocabulary: append-only ids, token maps, and lookups between local and global genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import dense_position


def first_appearance(genes: DataFrame, key: str) -> DataFrame:
    """key, global_id: numbers from 0 in order of first appearance by (dataset_index, origin_index)."""
    first = genes.groupBy(key).agg(F.min(F.struct("dataset_index", "origin_index")).alias("place"))
    return dense_position(first, [F.col("place.dataset_index"), F.col("place.origin_index")], "global_id").select(key, "global_id")


def vocabulary(var: DataFrame) -> DataFrame:
    """canonical_gene_id, global_id over all datasets; a missing canonical id is an error."""
    checked = var.withColumn("canonical_gene_id", F.when(F.col("canonical_gene_id").isNull(), F.raise_error(F.lit("canonical_gene_id is missing"))).otherwise(F.col("canonical_gene_id")))
    return first_appearance(checked, "canonical_gene_id")


def local_map(var: DataFrame) -> DataFrame:
    """dataset_index, origin_index, global_id: the map from local to global genes, as rows (absent genes have none)."""
    return var.join(vocabulary(var), "canonical_gene_id").select("dataset_index", "origin_index", "canonical_gene_id", "global_id")


def sorted_ids(var: DataFrame) -> DataFrame:
    """dataset_index, canonical_gene_id, global_id by sorted position within the dataset."""
    return var.select("dataset_index", "canonical_gene_id", (F.dense_rank().over(Window.partitionBy("dataset_index").orderBy("canonical_gene_id")) - 1).alias("global_id")).distinct()


def presence(var: DataFrame) -> DataFrame:
    """Genes of each dataset with their uniform probability."""
    n = F.count(F.lit(1)).over(Window.partitionBy("dataset_index"))
    return var.select("dataset_index", "global_feature_id", n.alias("n_genes"), (1 / n).alias("prob"))


SPECIAL = ("<pad>", "<cls>", "<mask>", "<unk>")


def token_map(vocab: DataFrame, special: tuple[str, ...] = SPECIAL, stoi: DataFrame | None = None) -> DataFrame:
    """canonical_gene_id, global_id, token_id, tokenizable.

    Without stoi, genes follow the special tokens in order of global id; with
    stoi (token, token_id), genes take its ids and others are not tokenizable.
    """
    if stoi is None:
        return vocab.select("canonical_gene_id", "global_id", (F.col("global_id") + len(special)).alias("token_id"), F.lit(True).alias("tokenizable"))
    rows = vocab.join(stoi.select(F.col("token").alias("canonical_gene_id"), "token_id"), "canonical_gene_id", "left")
    return rows.select("canonical_gene_id", "global_id", "token_id", F.col("token_id").isNotNull().alias("tokenizable"))


def check_stoi(stoi: dict[str, int]) -> dict[str, int]:
    """stoi if it is not empty and its ids are distinct and not negative."""
    if not stoi:
        raise ValueError("stoi is empty")
    if any(not isinstance(v, int) or isinstance(v, bool) or v < 0 for v in stoi.values()):
        raise ValueError("stoi ids must be integers of 0 or more")
    if len(set(stoi.values())) != len(stoi):
        raise ValueError("stoi ids must be distinct")
    return stoi


def coverage(var: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokenizable genes of each dataset, and over all (dataset_index null)."""
    rows = var.join(tokens.select("canonical_gene_id", "tokenizable"), "canonical_gene_id", "left")
    one = [F.count(F.lit(1)).alias("n_genes"), F.count(F.when(F.col("tokenizable"), 1)).alias("n_tokenizable")]
    every = rows.select("canonical_gene_id", "tokenizable").distinct().agg(*one).select(F.lit(None).cast("int").alias("dataset_index"), "n_genes", "n_tokenizable")
    return rows.groupBy("dataset_index").agg(*one).unionByName(every)
