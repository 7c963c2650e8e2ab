"""Log-normalised statistics by gene: means and variances over all cells, stored or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_normalised(count: Column, size_factor: Column) -> Column:
    """log1p(count / size factor); a factor that is missing, not finite or not above 0 is an error."""
    bad = size_factor.isNull() | F.isnan(size_factor) | (size_factor <= 0) | (size_factor == float("inf"))
    return F.when(bad, F.raise_error(F.lit("size_factor must be finite and above 0"))).otherwise(F.log1p(count / size_factor))


def lognorm_entries(coo: DataFrame, obs: DataFrame, *more: str) -> DataFrame:
    """coo with x, its log-normalised count, and columns of obs."""
    rows = coo.join(obs.select("global_row_index", "size_factor", *more), "global_row_index")
    return rows.withColumn("x", log_normalised(F.col("count"), F.col("size_factor")))


def cell_counts(obs: DataFrame, *by: str) -> DataFrame:
    return obs.groupBy("dataset_index", *by).agg(F.count(F.lit(1)).alias("n_obs"))


def lognorm_stats(coo: DataFrame, obs: DataFrame, var: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mean, population variance and deviation, cells and expressing cells of every gene of every dataset.

    One aggregation over stored entries; zeros come in by dividing by the
    number of cells, and genes without entries by an outer join.
    """
    sums = lognorm_entries(coo, obs).groupBy("dataset_index", "origin_index").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.when(F.col("count") > 0, 1)).alias("k"))
    rows = var.join(sums, ["dataset_index", "origin_index"], "left").join(F.broadcast(cell_counts(obs)), "dataset_index")  # one row a dataset
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n_obs")
    variance = F.greatest(F.coalesce("q", F.lit(0.0)) / F.col("n_obs") - mean * mean, F.lit(0.0))
    names = F.broadcast(ledger.select("dataset_index", "dataset_id"))
    return rows.join(names, "dataset_index").select(
        "dataset_id", "dataset_index", "gene_id", "global_feature_id", mean.alias("mean_lognorm"), variance.alias("var_lognorm"), F.sqrt(variance).alias("std_lognorm"), "n_obs", F.coalesce("k", F.lit(0)).alias("n_nonzero"),
    )


def log1p_sums(coo: DataFrame) -> DataFrame:
    """Sums of log1p(count) and of its square, and expressing cells, by gene (no size factor)."""
    x = F.log1p(F.col("count").cast("double"))
    return coo.groupBy("dataset_index", "origin_index").agg(F.sum(x).alias("sum_log1p"), F.sum(x * x).alias("sum_log1p_sq"), F.count(F.when(F.col("count") > 0, 1)).alias("n_cells_detected"))


def group_sums(coo: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """Sums, square sums and expressing cells by dataset, label and gene."""
    rows = lognorm_entries(coo, obs, label)
    return rows.groupBy("dataset_index", label, "origin_index").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.when(F.col("count") > 0, 1)).alias("k"))
