"""Differential expression: Welch's t-test of every label against the control, by dataset and gene."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpointed
from .stats import cell_counts, group_sums

#: Labels of datasets whose sizes are broadcast at most.
FEW_LABELS = 100_000


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function; normal beyond 1e6 degrees."""
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    out[ok & np.isinf(t)] = 0.0
    normal = ok & (df > 1e6) & np.isfinite(t)
    out[normal] = [math.erfc(x / math.sqrt(2)) for x in t[normal]]
    small = ok & (df <= 1e6) & np.isfinite(t)
    x, a = df[small] / (df[small] + t[small] ** 2), df[small] / 2
    out[small] = incomplete_beta(a, np.full(a.shape, 0.5), x)
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, iterated until all have settled (Lentz's method)."""
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a if len(a) else a
    h = _fraction(a, b, x)
    value = np.where(x <= 0, 0.0, front * h)
    return np.where(turned, 1 - value, value)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction; only elements that have not settled are carried on."""
    keep = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    out = np.ones_like(x)
    at = np.arange(len(x))
    c = np.ones_like(x)
    d = 1 / keep(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 20_000):
        if not len(at):
            break
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / keep(1 + top * d)
            c = keep(1 + top / c)
            step = c * d
            h = h * step
        going = np.abs(step - 1) > 3e-15
        if not going.all():
            out[at] = h
            at, a, b, x, c, d, h = (v[going] for v in (at, a, b, x, c, d, h))
    out[at] = h
    return out


def p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series(student_tail(a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan)))

    return F.nanvl(tail(t, df), F.lit(None))


def null_labels(obs: DataFrame, label: str, most: int = 10) -> list[int]:
    """Some rows with a null label, the first ones by number."""
    return [r[0] for r in obs.where(F.col(label).isNull()).select("global_row_index").orderBy("global_row_index").limit(most).collect()]


def label_masks(batches: DataFrame, label: str) -> DataFrame:
    """dataset_index, batch_id, label, global_row_index: the rows of each label inside each batch, in place of a mask a label."""
    return batches.where(F.col(label).isNotNull()).select("dataset_index", "batch_id", F.col(label).alias("label"), "global_row_index")


def against_control(groups: DataFrame, label: str, control: str, *values: str) -> DataFrame:
    """Groups (dataset_index, origin_index, label, values) other than the control, with the control's values as <value>_ref."""
    ref = groups.where(F.col(label) == control).select("dataset_index", "origin_index", *(F.col(c).alias(f"{c}_ref") for c in values))
    return groups.where(F.col(label) != control).join(ref, ["dataset_index", "origin_index"])


def contrasts(coo: DataFrame, obs: DataFrame, var: DataFrame, control: str, label: str = "perturb_label") -> DataFrame:
    """Means, sample variances, t and degrees of freedom of every dataset, label other than the control, and gene.

    A null label or a dataset without the control is an error. Where both
    variances are 0: t is 0 with equal means, else infinite, df is null.
    """
    if not control:
        raise ValueError("the control label is empty")
    if rows := null_labels(obs, label):
        raise ValueError(f"{label} is null in rows {rows} at least")
    sizes = checkpointed(cell_counts(obs, label))
    few = sizes.count() <= FEW_LABELS
    lacking = sizes.groupBy("dataset_index").agg(F.max((F.col(label) == control).cast("int")).alias("has")).where("has = 0").collect()  # one row a dataset
    if lacking:
        raise ValueError(f"no control in datasets {sorted(r['dataset_index'] for r in lacking)}")
    sums = checkpointed(group_sums(coo, obs, label))  # one row a gene, dataset and label
    every = var.select("dataset_index", "origin_index", "gene_id", "global_feature_id").join(F.broadcast(sizes) if few else sizes, "dataset_index")
    rows = every.join(sums, ["dataset_index", label, "origin_index"], "left").fillna(0, ["s", "q", "k"])
    n, mean = F.col("n_obs"), F.col("s") / F.col("n_obs")
    variance = F.when(n > 1, F.greatest((F.col("q") - n * mean * mean) / F.greatest(n - 1, F.lit(1)), F.lit(0.0))).otherwise(0.0)
    rows = rows.select("dataset_index", label, "origin_index", "gene_id", "global_feature_id", n.alias("n"), mean.alias("mean"), variance.alias("v"), (F.col("k") / n).alias("pct"))
    both = against_control(rows, label, control, "n", "mean", "v", "pct")
    a, b = F.col("v") / F.col("n"), F.col("v_ref") / F.col("n_ref")
    apart = F.col("mean") - F.col("mean_ref")
    flat = (a + b) <= 0
    t = F.when(flat, F.when(apart == 0, 0.0).otherwise(F.signum(apart) * float("inf"))).otherwise(F.try_divide(apart, F.sqrt(a + b)))
    lower = F.when(F.col("n") > 1, a * a / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0) + F.when(F.col("n_ref") > 1, b * b / F.greatest(F.col("n_ref") - 1, F.lit(1))).otherwise(0.0)
    df = F.when(flat, None).otherwise(F.try_divide((a + b) * (a + b), lower))
    return both.withColumns({"t_stat": t, "df": df, "flat": flat, "apart": apart})


def adjusted(rows: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """rows with p_adj, Benjamini-Hochberg over non-null p-values of each group."""
    inside = Window.partitionBy(*by)
    place = F.row_number().over(inside.orderBy(F.col(p).asc_nulls_last()))
    many = F.count(p).over(inside)
    rows = rows.withColumn("_place", place).withColumn("_raw", F.when(F.col(p).isNotNull(), F.col(p) * many / place))
    back = F.min("_raw").over(inside.orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0))  # a growing frame is linear
    return rows.withColumn("p_adj", F.when(F.col(p).isNotNull(), F.greatest(F.least(back, F.lit(1.0)), F.lit(0.0)))).drop("_place", "_raw")


def rank_genes(coo: DataFrame, obs: DataFrame, var: DataFrame, ledger: DataFrame, control: str, label: str = "perturb_label", top_k: int = 50) -> DataFrame:
    """The top_k genes of every contrast by adjusted p, p, |t| and gene."""
    if top_k <= 0:
        raise ValueError("top_k must be above 0")
    rows = contrasts(coo, obs, var, control, label)
    p = F.when(F.col("flat"), F.when(F.col("apart") == 0, 1.0).otherwise(0.0)).otherwise(p_value(F.col("t_stat"), F.col("df")))
    by = ["dataset_index", label]
    rows = adjusted(rows.withColumn("p_value", p), by)
    order = Window.partitionBy(*by).orderBy(F.col("p_adj").asc_nulls_last(), F.col("p_value").asc_nulls_last(), F.abs("t_stat").desc_nulls_last(), "global_feature_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    names = F.broadcast(ledger.select("dataset_index", "dataset_id"))
    return rows.join(names, "dataset_index").select(
        "dataset_id", "dataset_index", F.col(label).alias("perturbation"), F.lit(control).alias("reference_label"), "gene_id", F.col("global_feature_id").alias("gene_token_id"), "global_feature_id", "rank",
        "t_stat", "p_value", "p_adj", (F.col("apart") / math.log(2)).alias("logfoldchange"), F.col("mean_ref").alias("mean_reference"), F.col("mean").alias("mean_perturbed"),
        F.col("pct_ref").alias("pct_reference"), F.col("pct").alias("pct_perturbed"), F.col("n_ref").alias("n_reference"), F.col("n").alias("n_perturbed"),
    )
