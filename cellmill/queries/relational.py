"""Queries of the remaining projections, joins, aggregates, windows and set operations."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import blocks as bl
from ..operators import gather as ga
from ..operators import harmonize as ha
from ..operators import hvg as hv
from ..operators import inspect as ins
from ..operators import pairs as pa
from ..operators import pca as pc
from ..operators import relational as re_
from ..operators import sampling as sa
from ..operators import stats as st
from ..operators import welch as we
from ..plans.views import CONTROL, Corpus
from .base import Group, rounded
from .corpus import _HVG, _LOGNORM
from .samplers import _D9, _asked, _counts, _processed

GROUP = Group()
query = GROUP.query


@query("prj1_gather_columns", "SELECT c_name, c_custkey FROM customer")
def _(c: Corpus):
    return ga.take_columns(c.table("customer"), ["c_name", "c_custkey", "c_name"])


@query("prj2_derived_indices", "SELECT dataset_index, local_row_index, global_row_index, o_orderkey FROM cell", True)
def _(c: Corpus):
    stale = c.cells.withColumns({"global_row_index": F.lit(-1).cast("long"), "local_row_index": F.lit(-1).cast("long")})
    return re_.derive_indices(stale, c.ledger, "o_orderkey").select("dataset_index", "local_row_index", "global_row_index", "o_orderkey")


@query("prj3_column_order", "SELECT string_agg(n, ',' ORDER BY i) AS columns FROM (VALUES (0, 'global_row_index'), (1, 'dataset_index'), (2, 'dataset_id'), (3, 'local_row_index'), (4, 'cell_id'), (5, 'size_factor'), (6, 'batch_id'), (7, 'cell_context'), (8, 'perturb_label')) x(i, n)")
def _(c: Corpus):
    return c.spark.createDataFrame([(",".join(re_.ordered(c.obs).columns),)], "columns string")


@query("prj5_row_subset", "SELECT global_row_index, dataset_index FROM cell WHERE o_orderkey % 50 = 0", True)
def _(c: Corpus):
    asked = c.cells.where("o_orderkey % 50 = 0").select("global_row_index")  # the subset that is asked for
    return ga.subset(c.cells.select("global_row_index", "dataset_index"), asked)


@query("prj6_row_validation", "WITH n AS (SELECT count(*) AS n FROM orders) SELECT count(*) AS n, count(DISTINCT r) AS n_distinct, count(*) FILTER (r < 0 OR r >= (SELECT n FROM n)) AS n_outside FROM (SELECT (l_partkey * 7919) % ((SELECT n FROM n) + 3) AS r FROM lineitem)")
def _(c: Corpus):
    n = c.table("orders").count()
    asked = c.table("lineitem").select(F.pmod(F.col("l_partkey") * 7919, F.lit(n + 3)).alias("global_row_index"))
    return re_.row_report(asked, 0, n)


_NULLED = "WITH x AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 > 0 THEN c_mktsegment END AS label FROM customer)\n"


def _nulled(c: Corpus):
    return c.table("customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 > 0, F.col("c_mktsegment")).alias("label"))


@query("prj7_drop_null_labels", _NULLED + "SELECT * FROM x WHERE label IS NOT NULL")
def _(c: Corpus):
    return pa.drop_null_labels(_nulled(c), ["label", "not there"])


@query("prj8_encode_null_labels", _NULLED + "SELECT c_custkey, coalesce(label, '<null>') AS label FROM x")
def _(c: Corpus):
    return pa.encode_null_labels(_nulled(c), ["label"])


@query("prj10_predicates", "SELECT p_partkey, lower(trim(p_brand)) = 'brand#2' AS eq, p_brand IN ('Brand#4', 'Brand#17') AS within, p_size % 7 > 0 AS present FROM part")
def _(c: Corpus):
    rows = c.table("part").withColumn("maybe", F.when(F.col("p_size") % 7 > 0, F.lit("x")))
    cases = {"eq": ha.Case("p_brand", "equals", ("BRAND#2 ",), case_sensitive=False, strip_whitespace=True), "within": ha.Case("p_brand", "in", ("Brand#4", "Brand#17")), "present": ha.Case("maybe", "not_null")}
    return rows.select("p_partkey", *(ha.predicate(rows, case).alias(k) for k, case in cases.items()))


@query("prj12_valid_mask", _D9 + "SELECT global_row_index, seq, valid FROM w", True)
def _(c: Corpus):
    return bl.exploded(_processed(c), valid="mask")


@query("prj11_label_masks", "+ k AS (SELECT perturb_label AS label, global_row_index, local_row_index // 1024 AS batch_id, dataset_index FROM obs) SELECT dataset_index, batch_id, label, count(*) AS n, min(global_row_index) AS first FROM k GROUP BY 1, 2, 3", True)
def _(c: Corpus):
    from ..streaming.moments import dataset_batches

    batches = dataset_batches(c.obs.select("dataset_index", "local_row_index", "global_row_index", "perturb_label"))
    masked = we.label_masks(batches, "perturb_label")
    return masked.groupBy("dataset_index", "batch_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("global_row_index").alias("first"))


@query("prj14_filter_language", "SELECT c_custkey FROM customer WHERE (c_acctbal >= 100 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) OR c_nationkey NOT IN (1, 2, 3) AND c_name IS NOT NULL")
def _(c: Corpus):
    return re_.filter_rows(c.table("customer"), "(c_acctbal >= 100 and c_mktsegment in ('BUILDING', 'MACHINERY')) or c_nationkey not in (1, 2, 3) and c_name is not null").select("c_custkey")


@query("join8_match_counts", _D9 + "SELECT global_row_index, seq, global_feature_id, greatest(count, 0) AS count FROM w", True)
def _(c: Corpus):
    return ga.match_genes(_asked(c), _counts(c)).select("global_row_index", "seq", "global_feature_id", "count")


@query("join9_hvg_rank_of_gene", _HVG + "SELECT dataset_index, origin_index, global_feature_id, CAST(row_number() OVER (PARTITION BY dataset_index ORDER BY round(dispersion_norm, 9) DESC NULLS LAST, origin_index) AS INT) AS hvg_rank FROM h", True)
def _(c: Corpus):
    ranks = hv.hvg(c.coo, c.cells, c.var, c.ledger, n_hvg=200, digits=9).select("dataset_index", "origin_index", "hvg_rank")
    return c.var.join(ranks, ["dataset_index", "origin_index"], "left").select("dataset_index", "origin_index", "global_feature_id", "hvg_rank")


@query("join14_semi_and_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS known FROM customer")
def _(c: Corpus):
    return re_.flag_known(c.table("customer").select("c_custkey"), c.table("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("join15_control_contrast", _LOGNORM.rstrip().rstrip(",") + """
, g AS (SELECT dataset_index, perturb_label, origin_index, sum(x) AS s FROM x GROUP BY 1, 2, 3)
SELECT a.dataset_index, a.perturb_label, a.origin_index, round(a.s - b.s, 6) AS apart FROM g a JOIN g b ON a.dataset_index = b.dataset_index AND a.origin_index = b.origin_index WHERE a.perturb_label <> 'BUILDING' AND b.perturb_label = 'BUILDING'""", True)  # fmt: skip
def _(c: Corpus):
    rows = we.against_control(st.group_sums(c.coo, c.obs, "perturb_label"), "perturb_label", CONTROL, "s")
    return rounded(rows.select("dataset_index", "perturb_label", "origin_index", (F.col("s") - F.col("s_ref")).alias("apart")), 6, "apart")


@query("agg5_merged_moments", _LOGNORM.rstrip().rstrip(",") + "\nSELECT dataset_index, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x) * count(*), 4) AS m2 FROM x GROUP BY 1", True)
def _(c: Corpus):
    x = st.lognorm_entries(c.coo, c.obs)
    parts = x.withColumn("part", F.pmod(F.col("origin_index"), F.lit(7))).groupBy("dataset_index", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("m2"))
    return rounded(rounded(re_.merge_moments(parts, ["dataset_index"]), 6, "mean"), 4, "m2")


@query("agg15_pools", "SELECT dataset_index, cell_context, perturb_label, count(*) AS n, min(global_row_index) AS first, max(global_row_index) AS last FROM obs GROUP BY 1, 2, 3", True)
def _(c: Corpus):
    return pa.pools(c.obs, pa.PairConfig(controls=(CONTROL,)))


@query("agg19_corpus_totals", "SELECT count(*) AS n_datasets, CAST(sum(cell_count) AS BIGINT) AS n_cells FROM ledger", True)
def _(c: Corpus):
    return ga.corpus_totals(c.ledger)


@query("win5_cumulative_share", "WITH v AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1) SELECT p_brand, round(sum(v) OVER (ORDER BY v DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(v) OVER (), 6) AS share FROM v")
def _(c: Corpus):
    v = c.table("part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return rounded(pc.cumulative_share(v, [], "v", [F.desc("v"), F.col("p_brand")]).select("p_brand", "share"), 6, "share")


@query("win10_label_ids", "WITH f AS (SELECT c_mktsegment AS label, min(c_custkey) AS k FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) SELECT 'BUILDING' AS label, 0 AS label_id UNION ALL SELECT label, row_number() OVER (ORDER BY k) FROM f")
def _(c: Corpus):
    config = pa.PairConfig(controls=(CONTROL,))
    rows = c.table("customer").select(F.col("c_custkey").alias("global_row_index"), F.col("c_mktsegment").alias("perturb_label"))
    return pa.label_ids(rows, config)


@query("win12_batch_ids", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch_id FROM orders")
def _(c: Corpus):
    return re_.batch_ids(c.table("orders").select("o_orderkey"), "o_orderkey", 1000)


@query("win13_sign_pivot", "WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT vec_id, first(v ORDER BY abs(v) DESC, i) AS top FROM x GROUP BY 1) SELECT vec_id, round(CAST(top AS DOUBLE), 6) AS top_value FROM p")
def _(c: Corpus):
    rows = c.table("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rounded(rows.groupBy("vec_id").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("i"))).cast("double").alias("top_value")), 6, "top_value")


@query("set2_top_k", "SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER w AS INT) AS rank FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 50")
def _(c: Corpus):
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return c.table("orders").select("o_orderpriority", "o_orderkey", rank.alias("rank")).where("rank <= 50")


@query("set5_union_by_name", "SELECT c_custkey AS k, c_name AS name, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def _(c: Corpus):
    a = c.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(c.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("set7_union_of_vocabularies", "SELECT c_mktsegment AS value FROM customer UNION SELECT p_type FROM part UNION SELECT event_type FROM events")
def _(c: Corpus):
    return c.table("customer").select(F.col("c_mktsegment").alias("value")).union(c.table("part").select("p_type")).union(c.table("events").select("event_type")).distinct()


@query("set8_ordered_intersection", "SELECT o_custkey AS row, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS pos FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def _(c: Corpus):
    some = c.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("row"))
    return re_.ordered_unique(c.table("orders").select(F.col("o_custkey").alias("row"), F.col("o_orderkey").alias("at")).join(some, "row", "left_semi"), "row", "at")


@query("set9_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(c: Corpus):
    return c.table("lineitem").select("l_partkey").distinct().join(c.table("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")


@query("set10_ordered_unique", "SELECT o_custkey AS row, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS pos FROM orders GROUP BY o_custkey")
def _(c: Corpus):
    return re_.ordered_unique(c.table("orders").select(F.col("o_custkey").alias("row"), F.col("o_orderkey").alias("at")), "row", "at")


@query("fn30_scaled_expm1", "SELECT l_orderkey, l_linenumber, CAST(sum(round_even(exp(ln(1 + l_quantity)) - 1, 0)) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2")
def _(c: Corpus):
    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", F.rint(F.expm1(F.log1p("l_quantity"))).alias("n"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").cast("long").alias("count"))


@query("fn31_integer_like", "SELECT l_orderkey, count(*) FILTER (abs(l_tax * 100 - round_even(l_tax * 100, 0)) <= 1e-6) AS n_integer, count(*) FILTER (abs(l_extendedprice / 3 - round_even(l_extendedprice / 3, 0)) <= 1e-6) AS n_third FROM lineitem GROUP BY 1")
def _(c: Corpus):
    from ..operators.materialize import is_integer_like

    rows = c.table("lineitem")
    return rows.groupBy("l_orderkey").agg(F.count(F.when(is_integer_like(F.col("l_tax") * 100), 1)).alias("n_integer"), F.count(F.when(is_integer_like(F.col("l_extendedprice") / 3), 1)).alias("n_third"))


@query("fn33_source_names", "SELECT * FROM (VALUES ('.X', 'identity', 400), ('.raw.X', 'raw', 450), ('.layers[counts]', 'count-like', 500), ('.layers[lognorm]', 'transformed', 100), ('.layers[binned]', 'binned', 80), ('.layers[other]', 'identity', 250)) x(source, family, priority)")
def _(c: Corpus):
    names = c.spark.createDataFrame([(n,) for n in (".X", ".raw.X", ".layers[counts]", ".layers[lognorm]", ".layers[binned]", ".layers[other]")], "source string")
    return names.select("source", ins.transform_family(F.col("source")).alias("family"), ins.source_priority(F.col("source")).alias("priority"))


@query("fn36_t_tail", "SELECT l_orderkey, l_linenumber, round(1 - l_quantity / sqrt(2 + l_quantity * l_quantity), 8) AS p FROM lineitem")
def _(c: Corpus):
    return rounded(c.table("lineitem").select("l_orderkey", "l_linenumber", we.p_value(F.col("l_quantity"), F.lit(2.0)).alias("p")), 8, "p")


@query("fn37_fold_change", "SELECT l_orderkey, l_linenumber, round((l_tax - l_discount) / ln(2), 8) AS lfc FROM lineitem")
def _(c: Corpus):
    return rounded(c.table("lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_tax") - F.col("l_discount")) / math.log(2)).alias("lfc")), 8, "lfc")


@query("fn38_row_accessors", "SELECT global_row_index, count(*) AS n, max(origin_index) AS last_gene, max_by(count, origin_index) AS last_count FROM coo GROUP BY 1", True)
def _(c: Corpus):
    rows = c.sparse_rows.where(F.size("expressed_gene_indices") > 0)
    return rows.select("global_row_index", F.size("expressed_gene_indices").cast("long").alias("n"), F.element_at("expressed_gene_indices", -1).alias("last_gene"), F.element_at("expression_counts", -1).alias("last_count"))


@query("a7_readiness", "SELECT '.raw.X' AS source, 'pass' AS status, false AS uses_recovery, 'pass' AS materialization_readiness, CAST(1 AS BIGINT) AS control_columns")
def _(c: Corpus):
    from .inspection import _shapes, _sources

    values = _sources(c)
    audited = ins.audit(values, _shapes(c))
    rows = c.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "ctrl").otherwise("x").alias("condition"))
    return ins.readiness(ins.choose_source(audited, ins.try_recovery(values, audited)), ins.control_candidates(rows, "c_custkey"))


@query("e3b_recalculated_hvg", _HVG + """SELECT dataset_index, origin_index, gene_id AS feature_id, round(mean, 6) AS mean_log1p_expr, CAST(row_number() OVER w AS INT) AS hvg_rank, row_number() OVER w <= 100 AS selected_at_default_n_hvg
FROM h WINDOW w AS (PARTITION BY dataset_index ORDER BY round(dispersion_norm, 9) DESC NULLS LAST, origin_index)""", True)  # fmt: skip
def _(c: Corpus):
    from ..sources import store as so
    from .storage import _folder

    path = f"{_folder(c)}/hvg"
    so.write_result(hv.hvg(c.coo, c.cells, c.var, c.ledger, n_hvg=100, digits=9), path)
    return rounded(c.spark.read.parquet(path).select("dataset_index", "origin_index", "feature_id", "mean_log1p_expr", "hvg_rank", "selected_at_default_n_hvg"), 6, "mean_log1p_expr")


@query("d12_missing_token_policy", _D9 + "SELECT global_row_index, seq, global_feature_id, CASE WHEN valid THEN global_feature_id + 4 ELSE 0 END AS token_id FROM w WHERE NOT valid OR global_feature_id % 3 > 0", True)
def _(c: Corpus):
    from ..operators import features as fe

    tokens = fe.token_map(fe.vocabulary(c.var)).withColumn("tokenizable", F.col("global_id") % 3 > 0)
    return sa.tokenize_arrays(_processed(c), tokens, policy="exclude").select("global_row_index", "seq", "global_feature_id", "token_id")


@query("set11_chunks", "+ k AS (SELECT global_row_index, (row_number() OVER (ORDER BY global_row_index) - 1) // 1000 AS chunk FROM cell) SELECT chunk, count(*) AS n, min(global_row_index) AS first, max(global_row_index) AS last FROM k GROUP BY 1", True)
def _(c: Corpus):
    rows = re_.batch_ids(c.cells.select("global_row_index"), "global_row_index", 1000)
    return rows.groupBy(F.col("batch_id").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("global_row_index").alias("first"), F.max("global_row_index").alias("last"))


@query("p9_label_encoding", """+ f AS (SELECT perturb_label AS label, min(global_row_index) AS k FROM obs WHERE perturb_label <> 'BUILDING' GROUP BY 1), ids AS (SELECT 'BUILDING' AS label, 0 AS label_id UNION ALL SELECT label, row_number() OVER (ORDER BY k) FROM f)
SELECT o.global_row_index, ids.label_id FROM obs o JOIN ids ON ids.label = o.perturb_label""", True)  # fmt: skip
def _(c: Corpus):
    config = pa.PairConfig(controls=(CONTROL,))
    rows = pa.prepare(c.obs, config)
    return rows.join(pa.label_ids(rows, config), F.col("perturb_label") == F.col("label")).select("global_row_index", "label_id")
