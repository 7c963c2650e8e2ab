"""Queries through the store and through streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.text import unpack_json
from ..plans.together import together
from ..plans.views import Corpus
from ..sources import build as bu
from ..sources import corpus as co
from ..sources import counts as cn
from ..sources import documents as do
from ..sources import ledger as le
from ..sources import store as so
from ..streaming import moments as mo
from .base import Group, rounded

GROUP = Group()
query = GROUP.query


def _folder(c: Corpus) -> str:
    """A new folder in the shared one."""
    return f"{c.spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/corpus-{uuid.uuid4().hex}"


def _stored(c: Corpus, topology: str, format: str = "parquet"):
    """The corpus written dataset by dataset and read again."""
    root = _folder(c)
    le.write_ledger(c.spark, le.Ledger("c", format, topology), f"{root}/corpus-index.yaml")
    rows = c.sparse_rows.join(c.cells.select("global_row_index", "local_row_index", "dataset_id"), "global_row_index").persist()
    cells = c.cells.select(F.concat(F.lit("C"), "o_orderkey").alias("cell_id"), "dataset_id", "o_custkey")
    for r in c.ledger.orderBy("dataset_index").collect():  # one row a dataset
        d = r["dataset_id"]
        so.add_dataset(c.spark, root, d.replace(" ", "_"), rows.where(F.col("dataset_id") == d), cells.where(F.col("dataset_id") == d))
    rows.unpersist()
    return root, le.read_ledger(c.spark, f"{root}/corpus-index.yaml")


_ROWS = "SELECT c.dataset_index, c.global_row_index, count(o.origin_index) AS n_genes, CAST(coalesce(sum(o.count), 0) AS BIGINT) AS total FROM cell c LEFT JOIN coo o ON o.global_row_index = c.global_row_index GROUP BY 1, 2"


def _totals(rows):
    return rows.select("dataset_index", "global_row_index", F.size("expressed_gene_indices").cast("long").alias("n_genes"), F.aggregate("expression_counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("src4_aggregate_store", _ROWS, True)
def _(c: Corpus):
    root, ledger = _stored(c, "aggregate")
    return _totals(so.read_rows(c.spark, ledger, root))


@query("src17_federated_store", _ROWS, True)
def _(c: Corpus):
    root, ledger = _stored(c, "federated", "orc")
    return _totals(so.read_rows(c.spark, ledger, root))


_roots: dict[tuple, str] = {}


def _source(c: Corpus, dataset: str) -> cn.Source:
    """One dataset as its owner would export it: counts in .raw.X, log-normalised values in .X."""
    obs = c.obs.where(F.col("dataset_id") == dataset).select("local_row_index", "cell_id", F.col("perturb_label").alias("guide"), F.col("cell_context").alias("celltype"), F.col("batch_id").alias("batch"), F.lit("x").alias("note"))
    own = c.ledger.where(F.col("dataset_id") == dataset).first()  # one row a dataset; its numbers stand in the plans below
    mine = F.col("dataset_index") == own["dataset_index"]
    var = c.var.where(mine).select("origin_index", F.col("gene_id").alias("feature_id"), F.concat(F.lit("sym"), "gene_id").alias("label"))
    raw = c.coo.where(mine).select((F.col("global_row_index") - own["global_start"]).alias("row"), F.col("origin_index").cast("long").alias("gene"), F.col("count").cast("double").alias("value"))
    values = raw.select(F.lit(".raw.X").alias("source"), "row", "gene", "value").unionByName(raw.select(F.lit(".X").alias("source"), "row", "gene", F.log1p(F.col("value") / 7).alias("value")))
    return cn.Source(obs, var, values, (".X", ".raw.X"), dataset)


def _built(c: Corpus) -> str:
    """The corpus built from exported sources: inspected, materialised behind the gate, drafted, canonicalised. Once a session and directory."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _roots:
        root = _folder(c)
        c.cells  # both of the next read it
        together(lambda: c.coo, lambda: c.obs)
        so.create_corpus(c.spark, root, "built", "federated")
        for r in c.ledger.orderBy("dataset_index").collect():  # one row a dataset
            name = r["dataset_id"].replace(" ", "_")
            bu.materialize(c.spark, root, name, _source(c, r["dataset_id"]), None, n_hvg=100, rerun_inspection=True)
        bu.draft_all(c.spark, root)
        ledger = le.read_ledger(c.spark, f"{root}/{co.INDEX}")
        for r in ledger.records:  # a draft that was reviewed
            own = co.meta(ledger, root, r.dataset_id)
            schema = do.Schema.from_yaml(do.read_text(c.spark, own["draft"]))
            schema.status = "ready"
            do.write_text(c.spark, schema.to_yaml(), own["schema"])
        done, failed = bu.canonicalize_all(c.spark, root)
        if failed or len(done) != len(ledger.records):
            raise RuntimeError(f"canonicalize: {failed}")
        _roots[key] = root
    return _roots[key]


@query("src15_materialized_rows", _ROWS, True)
def _(c: Corpus):
    return _totals(co.open_corpus(c.spark, _built(c)).rows())


@query("src20_open_corpus", """SELECT global_row_index, local_row_index, dataset_index, replace(dataset_id, ' ', '_') AS dataset_id, cell_id, round(size_factor, 6) AS size_factor, perturb_label, cell_context, batch_id, 'human' AS species, CAST(NULL AS VARCHAR) AS dose, 'x' AS note FROM obs""", True)
def _(c: Corpus):
    obs = co.open_corpus(c.spark, _built(c), ["note"]).obs
    rows = obs.select("global_row_index", F.col("local_row_index").cast("long").alias("local_row_index"), "dataset_index", "dataset_id", "cell_id", "size_factor", "perturb_label", "cell_context", "batch_id", "species", "dose", "note")
    return rounded(rows, 6, "size_factor")


@query("src20_open_genes", "SELECT v.dataset_index, v.origin_index, v.gene_id, v.gene_id AS canonical_gene_id, g.global_feature_id, 'sym' || v.gene_id AS label FROM var v JOIN gene g ON g.l_partkey = v.l_partkey", True)
def _(c: Corpus):
    opened = co.open_corpus(c.spark, _built(c))
    ids = opened.vocabulary().withColumnRenamed("global_id", "global_feature_id")
    return opened.var.join(ids, "canonical_gene_id").select("dataset_index", "origin_index", "gene_id", "canonical_gene_id", "global_feature_id", "label")


@query("src21_hvg_sidecars", "+ n AS (SELECT dataset_index, count(*) AS n FROM var GROUP BY 1) SELECT dataset_index, n AS n_genes, CAST(n * (n + 1) / 2 AS BIGINT) AS ranks, least(n, 100) AS selected FROM n", True)
def _(c: Corpus):
    rows = co.open_corpus(c.spark, _built(c)).hvg()
    return rows.groupBy("dataset_index").agg(F.count(F.lit(1)).alias("n_genes"), F.sum(F.col("hvg_rank").cast("long")).alias("ranks"), F.count(F.when(F.col("selected_at_default_n_hvg"), 1)).alias("selected"))


@query("src13_manifests", "SELECT replace(dataset_id, ' ', '_') AS dataset_id, CASE WHEN dataset_index = 0 THEN 'create_new' ELSE 'append_routed' END AS route, '.raw.X' AS selected, cell_count, (SELECT count(*) FROM var v WHERE v.dataset_index = ledger.dataset_index) AS feature_count, 0 AS violations FROM ledger", True)
def _(c: Corpus):
    root = _built(c)
    ledger = le.read_ledger(c.spark, f"{root}/{co.INDEX}")
    found = [do.Manifest.from_dict(do.read_yaml(c.spark, f"{root}/{r.manifest_path}")) for r in ledger.records]
    bad = len(co.violations(c.spark, root, "parquet"))
    return c.spark.createDataFrame([(m.dataset_id, m.route, m.count_source["selected"], m.cell_count, m.feature_count, bad) for m in found], "dataset_id string, route string, selected string, cell_count long, feature_count long, violations int")


@query("src30_vocabularies", """SELECT DISTINCT replace(dataset_id, ' ', '_') AS dataset_id, 'perturb_label' AS field, perturb_label AS value FROM obs UNION SELECT DISTINCT replace(dataset_id, ' ', '_'), 'batch_id', batch_id FROM obs""", True)
def _(c: Corpus):
    root = _built(c)
    ledger = le.read_ledger(c.spark, f"{root}/{co.INDEX}")
    rows = []
    for r in ledger.records:
        vocab = do.read_yaml(c.spark, co.meta(ledger, root, r.dataset_id)["vocabulary"])
        rows += [(r.dataset_id, k, v) for k in ("perturb_label", "batch_id") for v in vocab["obs_categories"][k]]
    return c.spark.createDataFrame(rows, "dataset_id string, field string, value string")


@query("src2_select_matrix", "SELECT c.o_orderpriority AS dataset_id, count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM (SELECT l_orderkey, l_partkey, sum(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY 1, 2) l JOIN orders c ON c.o_orderkey = l.l_orderkey GROUP BY 1")
def _(c: Corpus):
    out = None
    for r in c.ledger.orderBy("dataset_index").collect():  # one row a dataset
        folder = _folder(c)
        cn.write_source(_source(c, r["dataset_id"]), folder)
        one = cn.read_source(c.spark, folder).select(".raw.X").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total")).select(F.lit(r["dataset_id"]).alias("dataset_id"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("src18_array_store", _ROWS, True)
def _(c: Corpus):
    folder = _folder(c)
    rows = c.sparse_rows.select(F.col("global_row_index").alias("row"), F.col("expressed_gene_indices").alias("genes"), F.col("expression_counts").alias("values"))
    cn.write_csr(rows, f"{folder}/X", chunk=50_000)
    read = cn.read_csr(c.spark, *(f"{folder}/X/{k}" for k in ("indptr", "indices", "data")))
    rows = read.select(F.col("row").alias("global_row_index"), F.col("genes").cast("array<int>").alias("expressed_gene_indices"), F.col("values").cast("array<int>").alias("expression_counts"))
    return _totals(rows.join(c.cells.select("global_row_index", "dataset_index"), "global_row_index"))


@query("src12_ledger_append", "SELECT dataset_index, replace(dataset_id, ' ', '_') AS dataset_id, CASE WHEN dataset_index = 0 THEN 'create' ELSE 'append' END AS join_mode, cell_count, global_start, global_end FROM ledger", True)
def _(c: Corpus):
    ledger = le.Ledger("c")
    for r in c.ledger.orderBy("dataset_index").collect():  # one row a dataset
        ledger.append(r["dataset_id"].replace(" ", "_"), r["cell_count"], "m")
    ledger.check()
    return le.Ledger.from_yaml(ledger.to_yaml()).frame(c.spark)


@query("src7_raw_obs_round_trip", "SELECT 'C' || CAST(c_custkey AS VARCHAR) AS cell_id, c_mktsegment AS dataset_id, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(c: Corpus):
    path = f"{_folder(c)}/raw-obs"
    rows = c.table("customer").select(F.concat(F.lit("C"), "c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("dataset_id"), "c_name", "c_nationkey")
    so.write_raw_obs(rows, path)
    return c.spark.read.parquet(path).select("cell_id", "dataset_id", *unpack_json(F.col("raw_fields"), ["c_name", "c_nationkey"]))


@query("src16_projected_obs", "SELECT global_row_index, cell_id, batch_id FROM obs", True)
def _(c: Corpus):
    path = f"{_folder(c)}/obs"
    so.write_result(c.obs, path)
    return so.read_obs(c.spark, path, ["global_row_index", "cell_id", "not_there"], ["batch_id"])


@query("e1_dataset_batches", "SELECT dataset_index, CAST(local_row_index // 1024 AS BIGINT) AS batch_id, count(*) AS n, min(global_row_index) AS first FROM cell GROUP BY 1, 2", True)
def _(c: Corpus):
    return mo.dataset_batches(c.cells).groupBy("dataset_index", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("global_row_index").alias("first"))


@query("st_streamed_moments", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(greatest(sum(value * value) / count(*) - avg(value) * avg(value), 0), 6) AS variance FROM events GROUP BY 1")
def _(c: Corpus):
    return rounded(mo.streamed_moments(c.spark, c.sf_dir), 6, "mean", "variance")


@query("x_windowed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(c: Corpus):
    return mo.windowed_counts(c.spark, c.sf_dir)
