"""Readers and writers of the corpus: sparse rows, sidecars, size factors, rankings, token maps, lists of inputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pack_json
from .ledger import FORMATS, TOPOLOGIES, Ledger, exists, paths, read_ledger, relative, write_ledger

HVG_SCHEMA = T.StructType([
    T.StructField("origin_index", T.IntegerType()), T.StructField("feature_id", T.StringType()), T.StructField("mean_log1p_expr", T.DoubleType()), T.StructField("variance_log1p_expr", T.DoubleType()),
    T.StructField("dispersion_log", T.DoubleType()), T.StructField("dispersion_norm", T.DoubleType()), T.StructField("hvg_rank", T.IntegerType()), T.StructField("selected_at_default_n_hvg", T.BooleanType()),
])


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def json_keys(df: DataFrame, column: str) -> list[str]:
    """The keys of a sidecar's JSON objects, which are the same in every row."""
    first = df.select(F.json_object_keys(column).alias("k")).where(F.col("k").isNotNull()).first()
    return list(first["k"]) if first else []


def writer(format: str, topology: str):
    """What writes rows of a format and topology: (rows, ledger, root, dataset_id); another pair is an error."""
    if format not in FORMATS or topology not in TOPOLOGIES:
        raise ValueError(f"no writer for {format!r}, {topology!r}")
    return write_rows


def reader(format: str, topology: str):
    """What reads rows of a format and topology: (spark, ledger, root, datasets); another pair is an error."""
    if format not in FORMATS or topology not in TOPOLOGIES:
        raise ValueError(f"no reader for {format!r}, {topology!r}")
    return read_rows


def write_rows(rows: DataFrame, ledger: Ledger, root: str, dataset_id: str) -> None:
    """Appends a dataset's sparse rows, sorted by global_row_index so that row-group statistics prune; partitioned by dataset.

    The rows must be the dataset's whole range: what a store's append offsets check, this checks before it writes.
    """
    if ledger.format not in FORMATS:
        raise ValueError(f"unknown format {ledger.format!r}")
    record = next(r for r in ledger.records if r.dataset_id == dataset_id)
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("global_row_index").alias("d"), F.min("global_row_index").alias("a"), F.max("global_row_index").alias("b")).first()
    if (span["n"], span["d"], span["a"], span["b"]) != (record.cell_count, record.cell_count, record.global_start, record.global_end - 1):
        raise ValueError(f"{dataset_id}: rows are not [{record.global_start}, {record.global_end})")
    to = paths(ledger.topology, root, dataset_id)["matrix"]
    placed = rows.withColumn("dataset_index", F.lit(record.dataset_index)).repartitionByRange("global_row_index").sortWithinPartitions("global_row_index")
    placed.write.mode("append").partitionBy("dataset_index").format(ledger.format).save(to)


def read_rows(spark: SparkSession, ledger: Ledger, root: str, datasets: list[str] | None = None) -> DataFrame:
    """Sparse rows of all or some datasets; partition pruning does the choice."""
    chosen = [r for r in ledger.records if datasets is None or r.dataset_id in datasets]
    if datasets and len(chosen) != len(set(datasets)):
        raise KeyError(f"unknown datasets: {sorted(set(datasets) - {r.dataset_id for r in chosen})}")
    if ledger.topology == "aggregate":
        return spark.read.format(ledger.format).load(paths("aggregate", root, "")["matrix"]).where(F.col("dataset_index").isin([r.dataset_index for r in chosen]))
    parts = [spark.read.format(ledger.format).load(paths("federated", root, r.dataset_id)["matrix"]) for r in chosen]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_raw_obs(obs: DataFrame, path: str, overwrite: bool = False) -> None:
    """cell_id, dataset_id, local_row_index (where there is one), raw_fields: all other columns as one JSON object."""
    first = [c for c in ("cell_id", "dataset_id", "local_row_index") if c in obs.columns]
    rest = [c for c in obs.columns if c not in first]
    packed = pack_json(rest) if rest else F.lit("{}")
    obs.select(*first, packed.alias("raw_fields")).write.mode(_mode(overwrite)).parquet(path)


def write_raw_var(var: DataFrame, path: str, overwrite: bool = False) -> None:
    rest = [c for c in var.columns if c not in ("origin_index", "feature_id")]
    packed = pack_json(rest) if rest else F.lit("{}")
    var.select("origin_index", "feature_id", packed.alias("raw_var")).write.mode(_mode(overwrite)).parquet(path)


def write_provenance(var: DataFrame, count_source: str, source_path: str, path: str, overwrite: bool = False) -> None:
    var.select("origin_index", "feature_id", F.lit(count_source).alias("count_source"), F.lit(source_path).alias("source_path")).write.mode(_mode(overwrite)).parquet(path)


def write_size_factors(factors: DataFrame, path: str, overwrite: bool = False) -> None:
    factors.select("cell_id", F.col("size_factor").cast("float").cast("double").alias("size_factor")).write.mode(_mode(overwrite)).parquet(path)


def write_hvg(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in HVG_SCHEMA)).write.mode(_mode(overwrite)).parquet(path)


def read_obs(spark: SparkSession, path: str, core: list[str], extra: list[str] | None = None) -> DataFrame:
    """Core columns that are there and all extra ones (an unknown one is an error); nested columns are refused."""
    found = spark.read.parquet(path)
    unknown = [c for c in extra or [] if c not in found.columns]
    if unknown:
        raise KeyError(f"unknown metadata columns: {unknown}")
    out = found.select(*dict.fromkeys([*(c for c in core if c in found.columns), *(extra or [])]))
    nested = [f.name for f in out.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise TypeError(f"nested columns: {nested}")
    return out


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, canonical, line of a tab-separated file; comments and blank lines are skipped."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    kept = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    return kept.select(F.trim(F.get(parts, F.lit(0))).alias("gene_id"), F.trim(F.get(parts, F.lit(1))).alias("canonical"), "line")


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """source, dataset_id, inspection_summary of a CSV list, stripped; a wrong header or an empty field is an error."""
    rows = spark.read.csv(path, header=True)
    names = [c.strip() for c in rows.columns]
    if names != ["source", "dataset_id", "inspection_summary"]:
        raise ValueError(f"header {names}")
    rows = rows.toDF(*names).select(*(F.trim(c).alias(c) for c in names))
    if not rows.where(F.coalesce(F.col("source"), F.lit("")) == "").isEmpty() or rows.isEmpty():
        raise ValueError("empty inputs")
    return rows


def scan_inputs(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> list[str]:
    """Files below a folder by a Hadoop glob."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


#: Tokens that one JSON document holds at most.
MOST_TOKENS = 5_000_000


def token_map_json(tokens: DataFrame) -> str:
    """A token map as JSON: gene to token id. More than MOST_TOKENS are an error, as a document goes through the driver."""
    if (n := tokens.where("tokenizable").count()) > MOST_TOKENS:
        raise ValueError(f"{n} tokens are too many for one document")
    return json.dumps({r["canonical_gene_id"]: r["token_id"] for r in tokens.where("tokenizable").select("canonical_gene_id", "token_id").collect()})


def read_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """token, token_id of a JSON object (stoi, or the object itself)."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    found = json.loads(text)
    from ..operators.features import check_stoi

    stoi = check_stoi(found.get("stoi", found) if isinstance(found, dict) else {})
    return spark.createDataFrame(list(stoi.items()), "token string, token_id long")


def provenance(kind: str, operation: str, dataset_id: str, parameters: dict, **extra) -> str:
    """A sidecar of how a result came to be."""
    plain = lambda v: None if isinstance(v, float) and v != v else v
    return json.dumps({"kind": kind, "operation": operation, "dataset": dataset_id, "parameters": {k: plain(v) for k, v in parameters.items()}, "extra": extra}, sort_keys=True)


def write_result(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A result, never over an older one unless asked."""
    df.write.mode(_mode(overwrite)).parquet(path)


# Columns of results, so that an empty result has its types.
RESULTS = {
    "lognorm_stats": "dataset_id string, dataset_index int, gene_id string, global_feature_id long, mean_lognorm double, var_lognorm double, std_lognorm double, n_obs long, n_nonzero long",
    "rank_genes": "dataset_id string, dataset_index int, perturbation string, reference_label string, gene_id string, gene_token_id long, global_feature_id long, rank int, t_stat double, p_value double, p_adj double, logfoldchange double, mean_reference double, mean_perturbed double, pct_reference double, pct_perturbed double, n_reference long, n_perturbed long",
    "pca_components": "dataset_id string, dataset_index int, component_index int, selected_feature_index int, gene_id string, global_feature_id long, loading double, hvg_rank int",
    "pca_component_stats": "dataset_id string, dataset_index int, component_index int, singular_value double, explained_variance double, explained_variance_ratio double, cumulative_explained_variance_ratio double, n_obs long, n_features_selected int, method string, is_centered boolean, method_semantics string",
    "pca_selected_features": "dataset_id string, dataset_index int, selected_feature_index int, local_feature_index int, gene_id string, global_feature_id long, hvg_rank int, selection_source string",
    "pca_embeddings": "dataset_id string, dataset_index int, global_row_index long, local_row_index long",
}


# The order of each result's rows.
ORDERS = {
    "lognorm_stats": ("dataset_index", "global_feature_id"),
    "hvg": ("hvg_rank", "origin_index"),
    "rank_genes": ("dataset_index", "perturbation", "rank"),
    "pca_components": ("dataset_index", "component_index", "selected_feature_index"),
    "pca_component_stats": ("dataset_index", "component_index"),
    "pca_selected_features": ("dataset_index", "selected_feature_index"),
    "pca_embeddings": ("dataset_index", "global_row_index"),
    "vocabulary": ("global_id",),
    "obs": ("global_row_index",),
}


def in_order(df: DataFrame, kind: str) -> DataFrame:
    """A result in the order of its kind, by ranges; files written from it follow each other in that order."""
    return df.orderBy(*ORDERS[kind])


def empty_result(spark: SparkSession, kind: str) -> DataFrame:
    """A result without rows that has the columns and types of its kind."""
    if kind == "hvg":
        return spark.createDataFrame([], HVG_SCHEMA)
    return spark.createDataFrame([], RESULTS[kind])


def write_pca(folder: str, features: DataFrame, components: DataFrame, stats: DataFrame, embeddings: DataFrame, parameters: dict, overwrite: bool = False) -> None:
    """The four artefacts of a PCA and their provenance, never over older ones unless asked."""
    from .documents import write_text

    spark = features.sparkSession
    parts = {"selected_features": features, "components": components, "component_stats": stats, "embeddings": embeddings}
    taken = [k for k in parts if exists(spark, f"{folder}/{k}")]
    if taken and not overwrite:
        raise FileExistsError(f"{folder}: {taken}")
    for name, df in parts.items():
        write_result(df, f"{folder}/{name}", overwrite)
    write_text(spark, provenance("pp", "pca", "all", parameters, artefacts=sorted(parts)), f"{folder}/provenance.json")


def create_corpus(spark: SparkSession, root: str, corpus_id: str, topology: str = "aggregate", format: str = "parquet") -> Ledger:
    if exists(spark, f"{root}/corpus-index.yaml"):
        raise FileExistsError(root)
    ledger = Ledger(corpus_id, format, topology)
    write_ledger(spark, ledger, f"{root}/corpus-index.yaml")
    return ledger


def add_dataset(spark: SparkSession, root: str, dataset_id: str, rows: DataFrame, obs: DataFrame, dry_run: bool = False) -> Ledger:
    """Appends a dataset: rows by local_row_index get the next global range; ledger last, so a failed write leaves no entry.

    rows: local_row_index, expressed_gene_indices, expression_counts.
    """
    from .documents import Manifest, write_text

    ledger = read_ledger(spark, f"{root}/corpus-index.yaml")
    to = paths(ledger.topology, root, dataset_id)
    record = ledger.append(dataset_id, rows.count(), relative(f"{to['meta']}/manifest.yaml", root))
    if dry_run:
        return ledger
    placed = rows.select((F.col("local_row_index") + record.global_start).alias("global_row_index"), "expressed_gene_indices", "expression_counts")
    writer(ledger.format, ledger.topology)(placed, ledger, root, dataset_id)
    write_raw_obs(obs, f"{to['meta']}/raw-obs", overwrite=True)
    outputs = {"metadata_root": relative(to["meta"], root), "matrix_root": relative(to["matrix"], root)}
    manifest = Manifest(dataset_id, "create_new" if record.join_mode == "create" else "append_routed", ledger.format, ledger.topology, {"selected": "rows", "integer_only": True, "uses_recovery": False}, outputs, {"source_path": "rows"}, record.cell_count)
    write_text(spark, manifest.to_yaml(), f"{to['meta']}/manifest.yaml")
    write_ledger(spark, ledger, f"{root}/corpus-index.yaml")
    return ledger
