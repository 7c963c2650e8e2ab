"""Highly variable genes: dispersion of log1p counts, normalised within 20 equal-width bins of the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpointed
from .stats import cell_counts, log1p_sums

BINS = 20


def bin_of(x: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """Number (from 0) of the right-closed equal-width bin of x in [low, high], the first edge lowered by 0.1 % of the range.

    If all values are equal, the range is widened by 0.1 % of the value (0.001 at 0) to both sides.
    """
    flat = high == low
    wide = F.when(low == 0, 0.001).otherwise(F.abs(low) * 0.001)
    a, b = F.when(flat, low - wide).otherwise(low), F.when(flat, high + wide).otherwise(high)
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, b).when((i == 0) & ~flat, a - (b - a) * 0.001).otherwise(a + i * ((b - a) / bins)))
    return F.greatest(F.size(F.filter(edges, lambda e: e < x)) - 1, F.lit(0))


def hvg(coo: DataFrame, obs: DataFrame, var: DataFrame, ledger: DataFrame, n_hvg: int = 2000, digits: int | None = None) -> DataFrame:
    """Dispersion, its normalised value and the rank of every gene of every dataset.

    digits rounds the ranking key, which makes ranks comparable between engines.
    """
    if n_hvg <= 0:
        raise ValueError("n_hvg must be above 0")
    rows = var.join(log1p_sums(coo), ["dataset_index", "origin_index"], "left").join(F.broadcast(cell_counts(obs)), "dataset_index")
    n = F.col("n_obs")
    mean = F.coalesce("sum_log1p", F.lit(0.0)) / n
    variance = (F.coalesce("sum_log1p_sq", F.lit(0.0)) - n * mean * mean) / F.greatest(n - 1, F.lit(1))
    rows = rows.select("dataset_index", "origin_index", "gene_id", "global_feature_id", F.coalesce("n_cells_detected", F.lit(0)).alias("n_cells_detected"), mean.alias("mean"), variance.alias("variance"))
    safe = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    rows = rows.withColumn("dispersion", F.col("variance") / safe)
    rows = rows.withColumn("dispersion_log", F.when(F.col("dispersion") > 0, F.log("dispersion"))).withColumn("mean_log", F.log1p("mean"))
    rows = checkpointed(rows)  # one row a gene and dataset, read three times
    ends = rows.groupBy("dataset_index").agg(F.min("mean_log").alias("low"), F.max("mean_log").alias("high"))
    rows = rows.join(F.broadcast(ends), "dataset_index").withColumn("bin", bin_of(F.col("mean_log"), F.col("low"), F.col("high")))
    bins = rows.groupBy("dataset_index", "bin").agg(F.avg("dispersion_log").alias("centre"), F.stddev_samp("dispersion_log").alias("spread"))
    rows = rows.join(F.broadcast(bins), ["dataset_index", "bin"])  # 20 rows a dataset
    single = F.col("spread").isNull()
    norm = F.try_divide(F.col("dispersion_log") - F.when(single, 0.0).otherwise(F.col("centre")), F.when(single, F.col("centre")).otherwise(F.col("spread")))
    rows = rows.withColumn("dispersion_norm", norm)
    key = F.col("dispersion_norm") if digits is None else F.round("dispersion_norm", digits)
    rank = F.row_number().over(Window.partitionBy("dataset_index").orderBy(key.desc_nulls_last(), "origin_index"))
    size = F.count(F.lit(1)).over(Window.partitionBy("dataset_index"))
    rows = rows.withColumn("hvg_rank", rank).withColumn("is_hvg", rank <= F.least(F.lit(n_hvg), size))
    names = F.broadcast(ledger.select("dataset_index", "dataset_id"))
    return rows.join(names, "dataset_index").select(
        "dataset_id", "dataset_index", "origin_index", "gene_id", F.col("gene_id").alias("feature_id"), "mean", "variance", "dispersion", "dispersion_log", "dispersion_norm", "hvg_rank", "is_hvg",
        F.col("is_hvg").alias("selected_at_default_n_hvg"), "n_cells_detected", F.col("mean").alias("mean_log1p_expr"), F.col("variance").alias("variance_log1p_expr"), "global_feature_id",
    )
