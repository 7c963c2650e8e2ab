"""Centred PCA of log-normalised counts: sparse Gram aggregation, one eigenproblem a dataset, sparse projection of any cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpointed
from .stats import cell_counts, lognorm_entries

#: Features of one dataset whose covariance one task solves at most (8 bytes each squared, a few times); more are an error.
MOST_FEATURES = 4_000
#: Features of all datasets whose loadings are broadcast at most.
FEW_FEATURES = 20_000
METHOD = "exact_covariance_eigh"


def memory_needed(features: int, n_components: int) -> int:
    """Bytes of the covariance, its eigenvectors and the loadings of one dataset."""
    return 8 * features * (2 * features + n_components)


def select_features(hvg_rows: DataFrame | None, var: DataFrame) -> DataFrame:
    """dataset_index, origin_index, global_feature_id, gene_id, hvg_rank, selection_source, selected_feature_index.

    The highly variable genes by rank, or without hvg_rows all genes by origin
    (hvg_rank null); a gene that a dataset lists twice counts once.
    """
    if hvg_rows is None:
        chosen = var.select("dataset_index", "global_feature_id", F.lit(None).cast("int").alias("hvg_rank"), F.col("origin_index").alias("_by"), F.lit("all_features").alias("selection_source"))
    else:
        chosen = hvg_rows.where("is_hvg").select("dataset_index", "global_feature_id", "hvg_rank", F.col("hvg_rank").alias("_by"), F.lit("hvg_is_hvg").alias("selection_source"))
    once = F.row_number().over(Window.partitionBy("dataset_index", "global_feature_id").orderBy("_by"))
    chosen = chosen.withColumn("_n", once).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("dataset_index").orderBy("_by", "global_feature_id")) - 1
    own = var.groupBy("dataset_index", "global_feature_id").agg(F.min(F.struct("origin_index", "gene_id")).alias("_x")).select("dataset_index", "global_feature_id", "_x.origin_index", "_x.gene_id")
    rows = chosen.join(own, ["dataset_index", "global_feature_id"]).withColumn("selected_feature_index", place).drop("_by")
    return checkpointed(rows)  # used many times


def selected_entries(coo: DataFrame, obs: DataFrame, features: DataFrame) -> DataFrame:
    """dataset_index, global_row_index, f, x: log-normalised stored entries of selected features, of the cells in obs."""
    chosen = features.select("dataset_index", "origin_index", F.col("selected_feature_index").alias("f"))
    return lognorm_entries(coo, obs).join(chosen, ["dataset_index", "origin_index"]).select("dataset_index", "global_row_index", "f", "x")


def gram(x: DataFrame) -> DataFrame:
    """dataset_index, i, j (i <= j), xy: sums of products over cells that express both. Pairs are made within a cell, so they are bounded by the square of the selected genes that it expresses."""
    packed = x.groupBy("dataset_index", "global_row_index").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("e"))
    pairs = packed.select("dataset_index", F.posexplode("e").alias("p", "a"), "e").select("dataset_index", "a", F.explode(F.slice("e", F.col("p") + 1, F.size("e") - F.col("p"))).alias("b"))
    return pairs.groupBy("dataset_index", F.col("a.f").alias("i"), F.col("b.f").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("xy"))


def sums(x: DataFrame) -> DataFrame:
    """dataset_index, f, s."""
    return x.groupBy("dataset_index", "f").agg(F.sum("x").alias("s"))


def covariance(coo: DataFrame, obs: DataFrame, features: DataFrame) -> DataFrame:
    """dataset_index, i, j (i <= j), cov, n_obs: sample covariance of the features that some cell expresses together.

    The zeros come in by cov = (sum xy - n mx my) / (n - 1); a pair that has no
    row is 0 in sum xy.
    """
    x = selected_entries(coo, obs, features)
    s = sums(x)
    one, two = s.select("dataset_index", F.col("f").alias("i"), F.col("s").alias("si")), s.select("dataset_index", F.col("f").alias("j"), F.col("s").alias("sj"))
    rows = gram(x).join(one, ["dataset_index", "i"]).join(two, ["dataset_index", "j"]).join(F.broadcast(cell_counts(obs)), "dataset_index")  # one row a dataset
    n = F.col("n_obs")
    return rows.select("dataset_index", "i", "j", ((F.col("xy") - F.col("si") * F.col("sj") / n) / F.greatest(n - 1, F.lit(1))).alias("cov"), "n_obs")


def check_fit(obs: DataFrame, features: DataFrame, n_components: int, most: int = MOST_FEATURES) -> None:
    """Raises if a dataset has no features or too many, or too few rows or features for the components."""
    if n_components <= 0:
        raise ValueError("n_components must be above 0")
    sizes = {r["dataset_index"]: r["k"] for r in features.groupBy("dataset_index").agg(F.count(F.lit(1)).alias("k")).collect()}  # one row a dataset
    rows = {r["dataset_index"]: r["n_obs"] for r in cell_counts(obs).collect()}
    if not sizes:
        raise ValueError("no features")
    for d, k in sizes.items():
        if k > most:
            raise MemoryError(f"dataset {d}: {k} features need {memory_needed(k, n_components)} bytes, {most} are allowed")
        n = rows.get(d, 0)
        if n < 2 or n_components > min(n, k):
            raise ValueError(f"dataset {d}: {n_components} components of {n} rows and {k} features")
    if lacking := sorted(set(rows) - set(sizes)):
        raise ValueError(f"no features in datasets {lacking}")


def fit(coo: DataFrame, obs: DataFrame, features: DataFrame, n_components: int, most: int = MOST_FEATURES) -> DataFrame:
    """The fitted model over the cells of obs, one row a feature: dataset_index, selected_feature_index, mean, loading (array by component); the row of feature 0 has variances, total, n_obs and n_features of its dataset."""
    check_fit(obs, features, n_components, most)
    x = checkpointed(selected_entries(coo, obs, features))
    n = cell_counts(obs).join(features.groupBy("dataset_index").agg(F.count(F.lit(1)).alias("k")), "dataset_index")
    minus = F.lit(-1)
    parts = gram(x).select("dataset_index", "i", "j", F.col("xy").alias("v")).unionByName(sums(x).select("dataset_index", minus.alias("i"), F.col("f").alias("j"), F.col("s").alias("v")))
    parts = parts.unionByName(n.select("dataset_index", minus.alias("i"), minus.alias("j"), F.col("n_obs").cast("double").alias("v"))).unionByName(n.select("dataset_index", F.lit(-2).alias("i"), minus.alias("j"), F.col("k").cast("double").alias("v")))

    def solve(one: pd.DataFrame) -> pd.DataFrame:
        i, j, v = one["i"].to_numpy(), one["j"].to_numpy(), one["v"].to_numpy()
        n, k = int(v[(i == -1) & (j == -1)][0]), int(v[i == -2][0])
        mean = np.zeros(k)
        of = (i == -1) & (j >= 0)
        mean[j[of]] = v[of] / n
        c = np.zeros((k, k))
        c[i[i >= 0], j[i >= 0]] = v[i >= 0]
        c = c + np.triu(c, 1).T
        c -= n * np.outer(mean, mean)
        c /= max(n - 1, 1)
        values, vectors = np.linalg.eigh(c)
        values, vectors = np.maximum(values[::-1][:n_components], 0), vectors[:, ::-1][:, :n_components]
        pivot = np.abs(np.round(vectors, 12)).argmax(axis=0)  # the first largest loading is positive
        vectors = vectors * np.where(vectors[pivot, np.arange(n_components)] < 0, -1.0, 1.0)
        out = pd.DataFrame({"dataset_index": one["dataset_index"].iloc[0], "selected_feature_index": np.arange(k), "mean": mean, "loading": list(vectors)})
        first = out["selected_feature_index"] == 0
        out["variances"] = [values if f else None for f in first]
        return out.assign(total=np.where(first, np.trace(c), np.nan), n_obs=n, n_features=k)

    schema = "dataset_index int, selected_feature_index int, mean double, loading array<double>, variances array<double>, total double, n_obs long, n_features int"
    return checkpointed(parts.groupBy("dataset_index").applyInPandas(solve, schema))


def loadings(model: DataFrame) -> DataFrame:
    """dataset_index, component_index (from 1), selected_feature_index, loading."""
    return model.select("dataset_index", "selected_feature_index", F.posexplode("loading").alias("k", "loading")).select("dataset_index", (F.col("k") + 1).alias("component_index"), "selected_feature_index", "loading")


def component_stats(model: DataFrame) -> DataFrame:
    """One row a dataset and component: singular value, explained variance, its share and running share, sizes and method."""
    rows = model.where("selected_feature_index = 0").select("dataset_index", "total", "n_obs", F.col("n_features").alias("n_features_selected"), F.posexplode("variances").alias("k", "explained_variance"))
    rows = rows.withColumn("component_index", F.col("k") + 1).withColumn("explained_variance_ratio", F.col("explained_variance") / F.greatest("total", F.lit(1e-300)))
    running = F.sum("explained_variance_ratio").over(Window.partitionBy("dataset_index").orderBy("component_index").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "dataset_index", "component_index", F.sqrt(F.col("explained_variance") * (F.col("n_obs") - 1)).alias("singular_value"), "explained_variance", "explained_variance_ratio", running.alias("cumulative_explained_variance_ratio"), "n_obs", "n_features_selected",
        F.lit(METHOD).alias("method"), F.lit(True).alias("is_centered"), F.lit("centred log-normalised counts").alias("method_semantics"),
    )


def cumulative_share(rows: DataFrame, by: list[str], value: str, order: list[Column]) -> DataFrame:
    """rows with `share`: the running sum of a value over its total, within groups that one task holds (components, bins)."""
    inside = Window.partitionBy(*by)
    return rows.withColumn("share", F.sum(value).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(inside))


def project(coo: DataFrame, obs: DataFrame, features: DataFrame, model: DataFrame, n_components: int) -> DataFrame:
    """dataset_id, dataset_index, global_row_index, local_row_index, component_1 .. component_k of the cells of obs, fitted or not.

    Cells are centred by the fitted means, from stored entries only. A dataset
    that the model lacks is an error.
    """
    w = features.join(model.select("dataset_index", "selected_feature_index", "mean", "loading"), ["dataset_index", "selected_feature_index"]).select("dataset_index", "origin_index", "mean", "loading")
    lacking = obs.select("dataset_index").distinct().join(w.select("dataset_index").distinct(), "dataset_index", "left_anti").collect()  # one row a dataset
    if lacking:
        raise ValueError(f"not fitted: datasets {sorted(r[0] for r in lacking)}")
    w = F.broadcast(w) if features.count() <= FEW_FEATURES else w
    ks = range(1, n_components + 1)
    of = lambda v, k: F.sum(F.col(v) * F.get("loading", F.lit(k - 1)))
    parts = lognorm_entries(coo, obs).join(w, ["dataset_index", "origin_index"]).groupBy("global_row_index").agg(*(of("x", k).alias(f"p{k}") for k in ks))
    centre = w.groupBy("dataset_index").agg(*(of("mean", k).alias(f"c{k}") for k in ks))
    ids = obs.select("dataset_id", "dataset_index", "global_row_index", "local_row_index")
    rows = ids.join(parts, "global_row_index", "left").join(F.broadcast(centre), "dataset_index")  # one row a dataset
    return rows.select(*ids.columns, *((F.coalesce(f"p{k}", F.lit(0.0)) - F.col(f"c{k}")).alias(f"component_{k}") for k in ks))
