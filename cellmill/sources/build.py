"""Building a corpus: inspection, materialising behind a readiness gate, drafts of schemas, canonical tables, rankings; one dataset or many."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unpack_json
from ..operators import harmonize as ha
from ..operators import hvg as hv
from ..operators import inspect as ins
from ..operators import materialize as ma
from ..plans.together import together
from . import store as so
from .corpus import INDEX, meta
from .counts import Source, read_source
from .documents import Manifest, Schema, Summary, draft_schema, read_text, read_yaml, summary_counts, vocabulary_values, vocabulary_yaml, write_text
from .ledger import Ledger, exists, paths, read_ledger, relative, write_ledger

N_HVG = 2000


def inspect(source: Source, dataset_id: str) -> Summary:
    """What materialising and drafting need to know of a source. Everything collected is a few values a column or matrix."""
    shapes = source.shapes()
    spark = source.obs.sparkSession
    here = lambda df: spark.createDataFrame(df.collect(), df.schema)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    fields = lambda df, order: sorted(rows(ins.profile(df, order, [c for c in df.columns if c != order])), key=lambda r: r["column"])

    def matrices() -> tuple[DataFrame, DataFrame]:
        audited = here(ins.audit(source.values, shapes))  # one row a matrix, so is what is recovered
        return audited, here(ins.try_recovery(source.values, audited))

    (audited, recovered), controls, cells, genes = together(
        matrices, lambda: here(ins.control_candidates(source.obs, "local_row_index")), lambda: fields(source.obs, "local_row_index"), lambda: fields(source.var, "origin_index")
    )
    decision = ins.readiness(ins.choose_source(audited, recovered), controls).first()
    of = lambda df, order: sorted(rows(df), key=lambda r: r[order])
    return Summary(
        dataset_id, decision["source"], decision["status"], bool(decision["uses_recovery"]), decision["materialization_readiness"], *source.size,
        cells, genes, of(audited, "place"), of(controls, "column"),
    )


def inspect_to(spark: SparkSession, source: Source, dataset_id: str, folder: str) -> str:
    """Writes a dataset's summary below a folder and gives its path."""
    path = f"{folder}/{dataset_id}/dataset-summary.yaml"
    write_text(spark, inspect(source, dataset_id).to_yaml(), path)
    return path


def gate(summary: Summary) -> None:
    """Raises unless the source may be materialised."""
    if summary.materialization_readiness != "pass":
        raise ValueError(f"{summary.dataset_id}: readiness is {summary.materialization_readiness!r}, not 'pass'")
    if (summary.obs_filter or "").strip():
        raise ValueError(f"{summary.dataset_id}: cells must be filtered before, not by obs_filter")


def corpus_kind(spark: SparkSession, root: str) -> tuple[str, str]:
    """Format and topology of a corpus, as its ledger says."""
    if not exists(spark, f"{root}/{INDEX}"):
        raise FileNotFoundError(f"{root}/{INDEX}")
    ledger = read_ledger(spark, f"{root}/{INDEX}")
    return ledger.format, ledger.topology


def counts_of(source: Source, summary: Summary) -> DataFrame:
    """row, gene, count of the chosen matrix: direct, or recovered from log-normalised values."""
    values = source.select(summary.source)
    return (ma.recover_counts(values) if summary.uses_recovery else ma.direct_counts(values)).select("row", "gene", "count")


def materialize(spark: SparkSession, root: str, dataset_id: str, source: Source, summary: Summary | str | None, n_hvg: int = N_HVG, dry_run: bool = False, rerun_inspection: bool = False) -> Manifest:
    """Adds a dataset to the corpus at root: rows, sidecars, size factors, ranking, manifest; the ledger last, so that a failed run leaves no entry.

    summary: what inspection found, or where its document is; with
    rerun_inspection the source is inspected again. A dry run writes nothing.
    """
    if rerun_inspection:
        summary = inspect(source, dataset_id)
    elif isinstance(summary, str):
        summary = Summary.from_dict(read_yaml(spark, summary))
    if summary is None:
        raise FileNotFoundError(f"{dataset_id}: no inspection summary")
    gate(summary)
    ledger = read_ledger(spark, f"{root}/{INDEX}")
    to, own = paths(ledger.topology, root, dataset_id), meta(ledger, root, dataset_id)
    n_cells, n_genes = source.size
    record = ledger.append(dataset_id, n_cells, relative(own["manifest"], root))
    inside = lambda *names: {k: relative(own[k], root) for k in names}
    manifest = Manifest(
        dataset_id, "create_new" if record.join_mode == "create" else "append_routed", ledger.format, ledger.topology,
        {"selected": summary.source, "integer_only": summary.status == "pass", "uses_recovery": summary.uses_recovery},
        {"metadata_root": relative(to["meta"], root), "matrix_root": relative(to["matrix"], root)}, {"source_path": source.path, "inspection_summary_path": relative(own["summary"], root)},
        n_cells, n_genes, True, n_hvg, inside("raw_obs", "raw_var", "provenance", "size_factors", "hvg"),
    )
    manifest.check()
    if dry_run:
        return manifest
    counts = counts_of(source, summary).select(F.col("row").cast("long").alias("local_row_index"), F.col("gene").cast("int").alias("origin_index"), "count").cache()
    packed = counts.groupBy("local_row_index").agg(F.array_sort(F.collect_list(F.struct("origin_index", "count"))).alias("x"))
    none = F.array().cast("array<int>")
    rows = source.obs.select(F.col("local_row_index").cast("long").alias("local_row_index")).join(packed, "local_row_index", "left")
    rows = rows.select((F.col("local_row_index") + record.global_start).alias("global_row_index"), F.coalesce("x.origin_index", none).alias("expressed_gene_indices"), F.coalesce("x.count", none).alias("expression_counts"))
    here = F.lit(record.dataset_index).alias("dataset_index")
    cells = source.obs.select(here, F.col("local_row_index").cast("long").alias("global_row_index"), "cell_id")
    coo = counts.select(here, F.col("local_row_index").alias("global_row_index"), "origin_index", "count")
    factors = ma.size_factors(cells, coo).join(cells.select("global_row_index", "cell_id"), "global_row_index")
    genes = source.var.select(here, F.col("origin_index").cast("int").alias("origin_index"), F.col("feature_id").alias("gene_id"), F.col("origin_index").cast("long").alias("global_feature_id"))
    name = spark.createDataFrame([(record.dataset_index, dataset_id)], "dataset_index int, dataset_id string")
    try:
        so.writer(ledger.format, ledger.topology)(rows, ledger, root, dataset_id)
        together(
            lambda: so.write_hvg(hv.hvg(coo, cells, genes, name, n_hvg), own["hvg"], overwrite=True),
            lambda: so.write_size_factors(factors, own["size_factors"], overwrite=True),
            lambda: so.write_raw_obs(source.obs.withColumn("dataset_id", F.lit(dataset_id)), own["raw_obs"], overwrite=True),
            lambda: so.write_raw_var(source.var, own["raw_var"], overwrite=True),
            lambda: so.write_provenance(source.var, summary.source, source.path, own["provenance"], overwrite=True),
        )
    finally:
        counts.unpersist()
    write_text(spark, summary.to_yaml(), own["summary"])
    write_text(spark, manifest.to_yaml(), own["manifest"])
    write_ledger(spark, ledger, f"{root}/{INDEX}")
    return manifest


def materialize_all(spark: SparkSession, root: str, inputs: Iterable[tuple[str, str, str | None]], corpus_id: str = "corpus", topology: str = "aggregate", format: str = "parquet", dry_run: bool = False, **options) -> list[Manifest]:
    """Datasets (source folder, dataset_id, summary path or None: inspect now) one after the other; a corpus that is not there is made."""
    if not exists(spark, f"{root}/{INDEX}"):
        if dry_run:
            ledger = Ledger(corpus_id, format, topology)
            return [Manifest(d, "create_new" if not i else "append_routed", ledger.format, ledger.topology, {"selected": "", "integer_only": False, "uses_recovery": False}, {"metadata_root": "", "matrix_root": ""}, {"source_path": s}) for i, (s, d, _) in enumerate(inputs)]
        so.create_corpus(spark, root, corpus_id, topology, format)
    return [materialize(spark, root, d, read_source(spark, s), summary, dry_run=dry_run, rerun_inspection=summary is None, **options) for s, d, summary in inputs]


@dataclass
class Canonicalized:
    """What came of one dataset."""

    dataset_id: str
    obs_path: str
    var_path: str
    obs_rows: int
    var_rows: int
    vocabulary_size: int
    gene_mapping: str
    warnings: list[str] = field(default_factory=list)


def raw_obs(spark: SparkSession, path: str, factors: str | None = None) -> DataFrame:
    """A raw sidecar's fields as text columns, in stored order, with the size factor of each cell (1.0 where there is none)."""
    rows = spark.read.parquet(path)
    keys = [k for k in so.json_keys(rows, "raw_fields") if k not in ("cell_id", "dataset_id", "size_factor", "local_row_index")]
    first = [c for c in ("cell_id", "dataset_id", "local_row_index") if c in rows.columns]
    rows = rows.select(*first, *unpack_json(F.col("raw_fields"), keys))
    if not factors:
        return rows.withColumn("size_factor", F.lit(1.0))
    return ha.with_size_factor(rows, spark.read.parquet(factors).withColumn("order", F.monotonically_increasing_id()))


def raw_var(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    keys = [k for k in so.json_keys(rows, "raw_var") if k not in ("origin_index", "feature_id")]
    return rows.select("origin_index", "feature_id", *unpack_json(F.col("raw_var"), keys))


def canonical_tables(spark: SparkSession, schema: Schema, obs: DataFrame, var: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical cells and genes of one dataset by its schema."""
    order = ["local_row_index"] if "local_row_index" in obs.columns else ["cell_id"]
    cells = ha.canonical_obs(obs, schema.obs, order, tuple(schema.obs_extensible))
    cells = cells.withColumnsRenamed({k: v for k, v in schema.obs_extensible.items() if k != v})
    cells = cells.withColumn("dataset_id", F.lit(schema.dataset_id))
    table = None
    if schema.gene_mapping.enabled and schema.gene_mapping.engine != "identity":
        if schema.gene_mapping.engine != "mapping_file" or not schema.gene_mapping.mapping_file:
            raise ValueError(f"{schema.dataset_id}: genes can be mapped by identity or a mapping_file, not {schema.gene_mapping.engine!r}")
        table = so.read_gene_map(spark, schema.gene_mapping.mapping_file)
    genes = ha.canonical_var(var.withColumn("_one", F.lit(0)), schema.var, table, tuple(schema.var_extensible), by="_one").drop("_one")
    return cells, genes.withColumnsRenamed({k: v for k, v in schema.var_extensible.items() if k != v})


def canonicalize(spark: SparkSession, root: str, dataset_id: str, overwrite: bool = False) -> Canonicalized:
    """Canonical tables and vocabulary of one dataset of a corpus, from its sidecars and its final schema."""
    ledger = read_ledger(spark, f"{root}/{INDEX}")
    if dataset_id not in {r.dataset_id for r in ledger.records}:
        raise KeyError(f"no dataset {dataset_id!r}")
    own = meta(ledger, root, dataset_id)
    schema = Schema.from_yaml(read_text(spark, own["schema"]))
    if schema.dataset_id != dataset_id:
        raise ValueError(f"the schema of {dataset_id} is that of {schema.dataset_id}")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        factors = own["size_factors"] if exists(spark, own["size_factors"]) else None
        obs, var = canonical_tables(spark, schema, raw_obs(spark, own["raw_obs"], factors), raw_var(spark, own["raw_var"]))
    together(lambda: so.write_result(obs, own["obs"], overwrite), lambda: so.write_result(var, own["var"], overwrite))
    obs, var = spark.read.parquet(own["obs"]), spark.read.parquet(own["var"])
    texts = [f.name for f in obs.schema if f.dataType.typeName() == "string" and f.name != "cell_id"]
    mapped = F.count(F.when(F.col("gene_id") != F.col("canonical_gene_id"), 1))
    sizes, found, n = together(lambda: var.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical_gene_id").alias("v"), mapped.alias("mapped")).first(), lambda: vocabulary_values(obs, texts), obs.count)
    write_text(spark, vocabulary_yaml(found, texts, sizes["v"], sizes["mapped"]), own["vocabulary"])
    engine = schema.gene_mapping.engine if schema.gene_mapping.enabled else "identity"
    return Canonicalized(dataset_id, own["obs"], own["var"], n, sizes["n"], sizes["v"], engine, [str(w.message) for w in said if issubclass(w.category, UserWarning)])


def canonicalize_all(spark: SparkSession, root: str, dataset_id: str | None = None, dry_run: bool = False, overwrite: bool = False) -> tuple[list[Canonicalized], dict[str, str]]:
    """Results and failures by dataset, of one dataset or of all that have a final schema; a dataset that fails does not stop the others."""
    ledger = read_ledger(spark, f"{root}/{INDEX}")
    names = [r.dataset_id for r in ledger.records]
    if dataset_id is not None and dataset_id not in names:
        raise KeyError(f"no dataset {dataset_id!r}")
    chosen = [d for d in ([dataset_id] if dataset_id else names) if exists(spark, meta(ledger, root, d)["schema"])]
    if not chosen:
        raise FileNotFoundError("no final schema")
    done, failed = [], {}
    for d in [] if dry_run else chosen:
        try:
            done.append(canonicalize(spark, root, d, overwrite))
        except Exception as e:  # bulk runs go on; the caller sees what failed
            failed[d] = str(e)
    return done, failed


def draft_all(spark: SparkSession, root: str, force: bool = False) -> dict[str, int]:
    """Drafts a schema for every dataset that is neither canonical nor drafted, from its inspection summary; counts of what was done."""
    ledger = read_ledger(spark, f"{root}/{INDEX}")
    drafted, skipped = {}, {}
    for r in ledger.records:
        own = meta(ledger, root, r.dataset_id)
        if exists(spark, own["obs"]) and exists(spark, own["var"]):
            skipped[r.dataset_id] = "skipped_canonicalized"
            continue
        summary = Summary.from_dict(read_yaml(spark, own["summary"]))
        if exists(spark, own["draft"]) and not force:
            skipped[r.dataset_id] = "skipped_existing"
            continue
        schema = draft_schema(r.dataset_id, [f["column"] for f in summary.obs_fields], ["origin_index", *(f["column"] for f in summary.var_fields)], summary.hints())
        write_text(spark, schema.to_yaml(), own["draft"])
        drafted[r.dataset_id] = schema
    return summary_counts(drafted, skipped)


def recalculate_hvg(spark: SparkSession, root: str, datasets: list[str] | None = None, n_hvg: int = N_HVG, update_manifests: bool = True) -> dict[str, int]:
    """Rankings of genes from stored rows, written over the old ones; cells by dataset. Manifests name the new default number."""
    if n_hvg <= 0:
        raise ValueError("n_hvg must be above 0")
    ledger = read_ledger(spark, f"{root}/{INDEX}")
    known = {r.dataset_id: r for r in ledger.records}
    if unknown := sorted(set(datasets or ()) - set(known)):
        raise KeyError(f"unknown datasets: {unknown}")
    out = {}
    for d in datasets or list(known):
        record, own = known[d], meta(ledger, root, d)
        rows = so.reader(ledger.format, ledger.topology)(spark, ledger, root, [d])
        pair = F.explode(F.arrays_zip(F.col("expressed_gene_indices").alias("g"), F.col("expression_counts").alias("c")))
        coo = rows.select("global_row_index", pair.alias("x")).select(F.lit(record.dataset_index).alias("dataset_index"), "global_row_index", F.col("x.g").alias("origin_index"), F.col("x.c").alias("count"))
        cells = rows.select(F.lit(record.dataset_index).alias("dataset_index"), "global_row_index")
        genes = spark.read.parquet(own["raw_var"]).select(F.lit(record.dataset_index).alias("dataset_index"), F.col("origin_index").cast("int").alias("origin_index"), F.col("feature_id").alias("gene_id"), F.col("origin_index").cast("long").alias("global_feature_id"))
        so.write_hvg(hv.hvg(coo, cells, genes, spark.createDataFrame([(record.dataset_index, d)], "dataset_index int, dataset_id string"), n_hvg), own["hvg"], overwrite=True)
        if update_manifests:
            manifest = Manifest.from_dict(read_yaml(spark, f"{root}/{record.manifest_path}"))
            manifest.default_n_hvg, manifest.artefacts["hvg"] = n_hvg, relative(own["hvg"], root)
            write_text(spark, manifest.to_yaml(), f"{root}/{record.manifest_path}")
        out[d] = record.cell_count
    return out
