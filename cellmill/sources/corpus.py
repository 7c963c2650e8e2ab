"""Opening a corpus: the ledger, canonical cells and genes of all datasets, rankings of genes, and rows; whatever is missing is an error at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import read_null
from ..operators.features import presence, vocabulary
from ..operators.harmonize import OBS_MUST_HAVE
from .ledger import Ledger, exists, paths, read_ledger
from .store import read_obs, reader

INDEX = "corpus-index.yaml"


def meta(ledger: Ledger, root: str, dataset_id: str) -> dict[str, str]:
    """Where a dataset's sidecars and canonical tables are."""
    base = paths(ledger.topology, root, dataset_id)["meta"]
    names = {"raw_obs": "raw-obs", "raw_var": "raw-var", "size_factors": "size-factor", "provenance": "feature-provenance", "hvg": "hvg", "obs": "canonical/obs", "var": "canonical/var", "vocabulary": "canonical/vocab.yaml"}
    names |= {"summary": "dataset-summary.yaml", "draft": "draft-schema.yaml", "schema": "final-schema.yaml", "manifest": "manifest.yaml"}
    return {"root": base, **{k: f"{base}/{v}" for k, v in names.items()}}


@dataclass
class Opened:
    """A corpus that is there: lazy tables over all of its datasets."""

    spark: SparkSession
    root: str
    ledger: Ledger
    obs: DataFrame
    var: DataFrame
    hvg_paths: dict[str, str]

    @property
    def dataset_index(self) -> dict[str, int]:
        return {r.dataset_id: r.dataset_index for r in self.ledger.records}

    def rows(self, datasets: list[str] | None = None) -> DataFrame:
        """Sparse rows of all or some datasets."""
        return reader(self.ledger.format, self.ledger.topology)(self.spark, self.ledger, self.root, datasets)

    def vocabulary(self) -> DataFrame:
        return vocabulary(self.var)

    def presence(self) -> DataFrame:
        """dataset_index, global_feature_id, n_genes, prob."""
        ids = self.vocabulary().withColumnRenamed("global_id", "global_feature_id")
        return presence(self.var.drop("global_feature_id").join(ids, "canonical_gene_id"))

    def hvg(self) -> DataFrame | None:
        """Rankings of the datasets that have one, with their dataset; None if none has."""
        out = None
        for d, path in self.hvg_paths.items():
            one = self.spark.read.parquet(path).select(F.lit(self.dataset_index[d]).alias("dataset_index"), F.lit(d).alias("dataset_id"), "*")
            out = one if out is None else out.unionByName(one)
        return out


def open_corpus(spark: SparkSession, root: str, extra: list[str] | None = None) -> Opened:
    """The corpus at root. extra: columns of canonical cells beyond the usual ones.

    Row numbers are derived from the ledger and the stored local order,
    whatever is stored; null literals are read as nulls; columns that some
    datasets lack are null there.
    """
    if not exists(spark, f"{root}/{INDEX}"):
        raise FileNotFoundError(f"{root}/{INDEX}")
    ledger = read_ledger(spark, f"{root}/{INDEX}")
    if not ledger.records:
        raise ValueError(f"{root} has no datasets")
    ledger.check()
    obs = var = None
    hvg = {}
    for r in ledger.records:
        own = meta(ledger, root, r.dataset_id)
        for kind, path in (("canonical cells", own["obs"]), ("canonical genes", own["var"]), ("matrix", paths(ledger.topology, root, r.dataset_id)["matrix"])):
            if not exists(spark, path):
                raise FileNotFoundError(f"{kind} of dataset {r.dataset_id!r}: {path}")
        if exists(spark, own["hvg"]):
            hvg[r.dataset_id] = own["hvg"]
        cells = read_obs(spark, own["obs"], list(OBS_MUST_HAVE), extra)
        cells = cells.select(*(read_null(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in cells.schema))
        cells = cells.withColumns({"dataset_id": F.lit(r.dataset_id), "dataset_index": F.lit(r.dataset_index), "global_row_index": F.col("local_row_index").cast("long") + r.global_start})
        genes = spark.read.parquet(own["var"]).withColumn("dataset_index", F.lit(r.dataset_index))
        obs = cells if obs is None else obs.unionByName(cells, allowMissingColumns=True)
        var = genes if var is None else var.unionByName(genes, allowMissingColumns=True)
    return Opened(spark, root, ledger, obs, var, hvg)


def violations(spark: SparkSession, root: str, backend: str | None = None) -> list[str]:
    """What is wrong with the manifests of a corpus; empty if nothing is."""
    from .documents import Manifest, read_yaml

    ledger = read_ledger(spark, f"{root}/{INDEX}")
    out = []
    for r in ledger.records:
        path = f"{root}/{r.manifest_path}"
        if not exists(spark, path):
            out.append(f"manifest missing for {r.dataset_id}: {r.manifest_path}")
            continue
        try:
            manifest = Manifest.from_dict(read_yaml(spark, path))
        except Exception as e:  # whatever a broken document raises is what is reported
            out.append(f"manifest of {r.dataset_id} cannot be read: {e}")
            continue
        if backend and manifest.backend != backend:
            out.append(f"backend of {r.dataset_id}: expected {backend}, got {manifest.backend}")
        if manifest.cell_count != r.cell_count:
            out.append(f"cells of {r.dataset_id}: {manifest.cell_count} and {r.cell_count}")
    return out
