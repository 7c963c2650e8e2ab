"""Queries of canonical tables, gene mapping and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drafting as dr
from ..operators import harmonize as ha
from ..operators.harmonize import Case, Mapping
from ..plans.views import Corpus
from .base import Group, rounded

GROUP = Group()
query = GROUP.query


def _raw(c: Corpus):
    """Raw metadata of customers: text columns with nulls, empty texts and padding."""
    return c.table("customer").select(
        "c_custkey", F.concat(F.lit(" "), "c_name").alias("name"), F.when(F.col("c_nationkey") % 3 > 0, F.concat(F.lit("N"), "c_nationkey")).alias("nation"), F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.concat(F.col("c_nationkey").cast("string"), F.lit("nM")).alias("dose_text"),
    )


_RAW = """WITH raw AS (SELECT c_custkey, ' ' || c_name AS name, CASE WHEN c_nationkey % 3 > 0 THEN 'N' || CAST(c_nationkey AS VARCHAR) END AS nation, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE c_mktsegment END AS segment, CAST(c_nationkey AS VARCHAR) || 'nM' AS dose_text, c_nationkey FROM customer)
SELECT c_custkey, {} AS value FROM raw"""


def _one(name: str, mapping: Mapping, sql: str) -> None:
    @query(name, _RAW.format(sql))
    def _(c: Corpus):
        raw = _raw(c)
        return raw.select("c_custkey", ha.obs_column(raw, mapping).alias("value"))


_one("c6a_literal", Mapping("species", "literal", literal="human"), "'human'")
_one("c6b_passthrough", Mapping("segment", "passthrough", source="name", fallback="none"), "segment")
_one("c6d_null", Mapping("dose", "null", fallback="NA"), "'NA'")
_one("c6e_source_field", Mapping("dose", source="dose_text", transforms=[("dose_parse", {}), ("strip_prefix", {"prefix": "1"})], fallback="gone"), "CASE WHEN c_nationkey = 1 THEN 'gone' WHEN starts_with(CAST(c_nationkey AS VARCHAR), '1') THEN substr(CAST(c_nationkey AS VARCHAR), 2) ELSE CAST(c_nationkey AS VARCHAR) END")
_one("c6f_coalesce", Mapping("cell_context", "coalesce", sources=("nation", "segment"), fallback="unknown"), "coalesce(nation, CASE WHEN segment <> '' THEN segment END, 'unknown')")
_one("c6g_join", Mapping("perturb_label", "join", sources=("nation", "segment", "dose_text")), "concat_ws('+', nation, nullif(segment, ''), dose_text)")
_one("c6h_template", Mapping("condition", "template", template="{nation}:{segment}", missing="fallback", fallback="WT"), "CASE WHEN nation IS NULL OR segment = '' THEN 'WT' ELSE nation || ':' || segment END")
_one("c6i_conditional", Mapping("perturb_type", "conditional", cases=(Case("segment", "in", ("building", "AUTOMOBILE"), "first", case_sensitive=False), Case("nation", "not_null", take="nation")), default="other"),
     "CASE WHEN lower(segment) IN ('building', 'automobile') THEN 'first' WHEN nation IS NOT NULL THEN nation ELSE 'other' END")


@query("c6c_row_index", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INT) AS value FROM customer")
def _(c: Corpus):
    mappings = [Mapping("c_custkey", "passthrough"), Mapping("value", "row-index")]
    return ha.canonical_obs(_raw(c), mappings, ["c_custkey"], strict=False).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("c9_extensible_columns", "SELECT c_custkey, coalesce('N' || CASE WHEN c_nationkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END, 'NA') AS nation, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer")
def _(c: Corpus):
    key = [Mapping("c_custkey", "passthrough")]
    return ha.canonical_obs(_raw(c), key, ["c_custkey"], ("nation", "segment"), strict=False).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("join5_size_factor_by_cell", """+ f AS (SELECT cell_id, size_factor, global_row_index AS o FROM obs WHERE global_row_index % 3 > 0 UNION ALL SELECT cell_id, 2.5, global_row_index + 1000000000 FROM obs WHERE global_row_index % 5 = 0)
SELECT o.cell_id, round(coalesce((SELECT max_by(f.size_factor, f.o) FROM f WHERE f.cell_id = o.cell_id), 1.0), 6) AS size_factor FROM obs o""", True)  # fmt: skip
def _(c: Corpus):
    f = c.obs.select("cell_id", "size_factor", F.col("global_row_index").alias("order"))
    factors = f.where("order % 3 > 0").unionByName(f.where("order % 5 = 0").select("cell_id", F.lit(2.5).alias("size_factor"), (F.col("order") + 1000000000).alias("order")))
    return rounded(ha.with_size_factor(c.obs.select("cell_id"), factors), 6, "size_factor")


@query("join11_gene_mapping", """+ t AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS g, upper(p_name) || CAST(p_partkey AS VARCHAR) AS canonical FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT v.dataset_index, v.origin_index, v.gene_id, coalesce(t.canonical, v.gene_id) AS canonical_gene_id FROM var v LEFT JOIN t ON t.g = v.gene_id)
SELECT *, CAST(dense_rank() OVER (PARTITION BY dataset_index ORDER BY canonical_gene_id) - 1 AS INT) AS global_id FROM m""", True)  # fmt: skip
def _(c: Corpus):
    part = c.table("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("gene_id"), F.concat(F.upper("p_name"), F.col("p_partkey").cast("string")).alias("canonical"), F.lit(2).alias("line"))
    table = part.unionByName(part.select("gene_id", F.lit("overwritten").alias("canonical"), F.lit(1).alias("line")))
    return ha.canonical_var(c.var, list(ha.VAR_DEFAULTS), table)


@query("c7_var_strategies", """SELECT dataset_index, origin_index, gene_id, gene_id AS canonical_gene_id, CAST(dense_rank() OVER (PARTITION BY dataset_index ORDER BY gene_id) - 1 AS INT) AS global_id,
 'P' AS kind, substr(gene_id, 2) AS bare, CAST(global_feature_id AS VARCHAR) AS global_feature_id, 'NA' AS gone, 'none' AS lost, CAST(l_partkey AS VARCHAR) AS l_partkey, 'NA' AS absent FROM var""", True)  # fmt: skip
def _(c: Corpus):
    more = [Mapping("kind", "literal", literal="P"), Mapping("bare", source="gene_id", transforms=[("strip_prefix", {"prefix": "P"})]), Mapping("global_feature_id", "passthrough"), Mapping("gone", "null"), Mapping("lost", "passthrough", fallback="none")]
    return ha.canonical_var(c.var, [*ha.VAR_DEFAULTS, *more], extensible=("l_partkey", "absent"))


@query("agg9_vocabulary", """+ x AS (SELECT DISTINCT dataset_index, k, v FROM (SELECT dataset_index, 'perturb_label' AS k, perturb_label AS v FROM obs UNION ALL SELECT dataset_index, 'batch_id', batch_id FROM obs) WHERE v NOT IN ('', 'NA'))
SELECT dataset_index, k AS "column", v AS value, CAST(row_number() OVER (PARTITION BY dataset_index, k ORDER BY v) AS INT) AS place FROM x""", True)  # fmt: skip
def _(c: Corpus):
    return ha.vocabulary_rows(c.obs, ["perturb_label", "batch_id"], ["dataset_index"])


@query("agg10_merged_vocabulary", """SELECT 'batch_id' AS "column", batch_id AS value, count(DISTINCT dataset_index) AS n_datasets FROM obs GROUP BY batch_id""", True)
def _(c: Corpus):
    return ha.merged_vocabulary(ha.vocabulary_rows(c.obs, ["batch_id"], ["dataset_index"]))


@query("c1_draft_schema", """SELECT * FROM (VALUES ('batch_id', 'source-field', 'plate_id'), ('cell_id', 'source-field', 'barcode'), ('dose', 'source-field', 'concentration'), ('species', 'literal', NULL), ('perturb_label', 'source-field', 'sgRNA'), ('donor_id', 'null', NULL), ('global_row_index', 'row-index', NULL)) t(name, strategy, source)""")
def _(c: Corpus):
    mappings, _ = dr.draft_obs(["plate_id", "barcode", "concentration", "sgRNA", "zz"])
    wanted = {"batch_id", "cell_id", "dose", "species", "perturb_label", "donor_id", "global_row_index"}
    return c.spark.createDataFrame([(m.name, m.strategy, m.source) for m in mappings if m.name in wanted], "name string, strategy string, source string")


@query("prj4_read_null_literals", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def _(c: Corpus):
    from ..functions.text import read_null

    return _raw(c).select("c_custkey", read_null(F.col("segment")).alias("segment"))
