"""Queries of the corpus: views, gathers, statistics, variable genes, tests and components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import gather as ga
from ..operators import hvg as hv
from ..operators import pca as pc
from ..operators import stats as st
from ..operators import welch as we
from ..plans.views import CONTROL, Corpus
from .base import Group, rounded

GROUP = Group()
query = GROUP.query


@query("m2_ledger", "SELECT dataset_index, dataset_id, cell_count, global_start, global_end FROM ledger", True)
def _(c: Corpus):
    return c.ledger


@query("d1_metadata_index", "SELECT global_row_index, local_row_index, dataset_index, dataset_id, cell_id, round(size_factor, 6) AS size_factor, perturb_label, cell_context, batch_id FROM obs", True)
def _(c: Corpus):
    return rounded(c.obs, 6, "size_factor")


@query("d2_feature_registry", "SELECT dataset_index, origin_index, gene_id, gene_id AS canonical_gene_id, global_feature_id FROM var", True)
def _(c: Corpus):
    return c.var.drop("l_partkey")


@query("win6_append_vocabulary", "SELECT gene_id AS canonical_gene_id, min(global_feature_id) AS global_id FROM var GROUP BY gene_id", True)
def _(c: Corpus):
    return fe.vocabulary(c.var)


@query("join7_local_to_global", "SELECT dataset_index, origin_index, gene_id AS canonical_gene_id, global_feature_id AS global_id FROM var", True)
def _(c: Corpus):
    return fe.local_map(c.var)


@query("win11_sorted_vocabulary_ids", "SELECT DISTINCT dataset_index, gene_id AS canonical_gene_id, CAST(dense_rank() OVER (PARTITION BY dataset_index ORDER BY gene_id) - 1 AS INT) AS global_id FROM var", True)
def _(c: Corpus):
    return fe.sorted_ids(c.var)


@query("agg17_presence_prob", "SELECT dataset_index, global_feature_id, count(*) OVER (PARTITION BY dataset_index) AS n_genes, round(1.0 / count(*) OVER (PARTITION BY dataset_index), 9) AS prob FROM var", True)
def _(c: Corpus):
    return rounded(fe.presence(c.var), 9, "prob")


@query("d11_token_map", "SELECT gene_id AS canonical_gene_id, min(global_feature_id) AS global_id, min(global_feature_id) + 4 AS token_id, true AS tokenizable FROM var GROUP BY gene_id", True)
def _(c: Corpus):
    return fe.token_map(fe.vocabulary(c.var))


_STOI = """+ stoi AS (SELECT DISTINCT gene_id AS token, l_partkey * 3 AS token_id FROM var WHERE l_partkey % 4 <> 0),
tok AS (SELECT v.dataset_index, v.gene_id, s.token_id FROM var v LEFT JOIN stoi s ON v.gene_id = s.token)
SELECT dataset_index, count(*) AS n_genes, count(token_id) AS n_tokenizable FROM tok GROUP BY dataset_index
UNION ALL SELECT NULL, count(*), count(token_id) FROM (SELECT DISTINCT gene_id, token_id FROM tok)"""


@query("agg16_token_coverage", _STOI, True)
def _(c: Corpus):
    stoi = c.var.where("l_partkey % 4 <> 0").select(F.col("gene_id").alias("token"), (F.col("l_partkey") * 3).alias("token_id")).distinct()
    return fe.coverage(c.var, fe.token_map(fe.vocabulary(c.var), stoi=stoi))


@query("m3_sparse_rows", """+ packed AS (SELECT global_row_index, string_agg(CAST(origin_index AS VARCHAR), ',' ORDER BY origin_index) AS genes, string_agg(CAST(count AS VARCHAR), ',' ORDER BY origin_index) AS counts FROM coo GROUP BY 1)
SELECT c.global_row_index, coalesce(genes, '') AS genes, coalesce(counts, '') AS counts FROM cell c LEFT JOIN packed p ON c.global_row_index = p.global_row_index""", True)  # fmt: skip
def _(c: Corpus):
    rows = c.sparse_rows
    return rows.select("global_row_index", F.array_join("expressed_gene_indices", ",").alias("genes"), F.array_join("expression_counts", ",").alias("counts"))


@query("d14_coo_from_rows", "SELECT global_row_index, row_number() OVER (PARTITION BY global_row_index ORDER BY origin_index) - 1 AS position, origin_index AS gene, count FROM coo", True)
def _(c: Corpus):
    return ga.to_coo(c.sparse_rows).withColumn("position", F.col("position").cast("long"))


@query("win8_row_offsets", """+ n AS (SELECT c.dataset_index, c.global_row_index, count(o.origin_index) AS n FROM cell c LEFT JOIN coo o ON c.global_row_index = o.global_row_index GROUP BY 1, 2)
SELECT dataset_index, global_row_index, CAST(sum(n) OVER w - n AS BIGINT) AS first, CAST(sum(n) OVER w AS BIGINT) AS "end" FROM n WINDOW w AS (PARTITION BY dataset_index ORDER BY global_row_index)""", True)  # fmt: skip
def _(c: Corpus):
    rows = c.sparse_rows.join(c.cells.select("global_row_index", "dataset_index"), "global_row_index")
    return ga.row_offsets(rows)


def _requests(c: Corpus):
    """Every line item asks for the row of its order's customer number (with repeats and in its own order)."""
    n = c.table("orders").count()
    return c.table("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.pmod(F.col("l_partkey") * 7919, F.lit(n)).alias("global_row_index"))


_REQ = "+ req AS (SELECT l_orderkey * 8 + l_linenumber AS pos, (l_partkey * 7919) % (SELECT count(*) FROM orders) AS global_row_index FROM lineitem)\n"


@query("join1_route_rows", _REQ + "SELECT r.pos, r.global_row_index, l.dataset_index, r.global_row_index - l.global_start AS local_row_index FROM req r JOIN ledger l ON r.global_row_index >= l.global_start AND r.global_row_index < l.global_end", True)
def _(c: Corpus):
    return ga.route(_requests(c), c.ledger).select("pos", "global_row_index", "dataset_index", "local_row_index")


@query("d15_checked_requests", "SELECT l_orderkey, l_linenumber, (l_partkey * 7919) % (SELECT count(*) FROM orders) AS global_row_index FROM lineitem")
def _(c: Corpus):
    n = c.table("orders").count()
    asked = c.table("lineitem").select("l_orderkey", "l_linenumber", F.pmod(F.col("l_partkey") * 7919, F.lit(n)).alias("global_row_index"))
    return ga.checked_requests(asked, n)


@query("set1_ordered_statistics", "+ v AS (SELECT dataset_index, global_feature_id FROM var) SELECT dataset_index, global_feature_id, row_number() OVER (ORDER BY dataset_index, global_feature_id) - 1 AS place FROM v", True)
def _(c: Corpus):
    from ..sources.store import in_order
    from .storage import _folder

    path = f"{_folder(c)}/stats"
    in_order(st.lognorm_stats(c.coo, c.obs, c.var, c.ledger), "lognorm_stats").write.parquet(path)
    stored = c.spark.read.parquet(path).select("dataset_index", "global_feature_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")  # files follow each other, rows within a file too
    inner = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    sizes = stored.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return stored.withColumn("inner", inner).join(F.broadcast(sizes), "file").select("dataset_index", "global_feature_id", (F.col("before") + F.col("inner") - 1).alias("place"))


@query("join2_ordered_gather", _REQ.rstrip() + ", t AS (SELECT global_row_index, count(*) AS n, sum(count) AS total FROM coo GROUP BY 1) SELECT r.pos, r.global_row_index, coalesce(t.n, 0) AS n_genes, CAST(coalesce(total, 0) AS BIGINT) AS total FROM req r LEFT JOIN t ON r.global_row_index = t.global_row_index", True)
def _(c: Corpus):
    rows = ga.gather(_requests(c), c.sparse_rows)
    return rows.select("pos", "global_row_index", F.size("expressed_gene_indices").cast("long").alias("n_genes"), F.aggregate("expression_counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("join3_metadata_gather", _REQ + "SELECT r.pos, r.global_row_index, o.cell_id, o.perturb_label FROM req r JOIN obs o ON r.global_row_index = o.global_row_index", True)
def _(c: Corpus):
    return ga.gather(_requests(c), ga.take_columns(c.obs, ["global_row_index", "cell_id", "perturb_label", "cell_id"]))


@query("join4_attach_metadata", _REQ + "SELECT r.pos, r.global_row_index, o.dataset_index, round(o.size_factor, 6) AS size_factor, o.batch_id FROM req r LEFT JOIN obs o ON r.global_row_index = o.global_row_index", True)
def _(c: Corpus):
    return rounded(ga.attach_metadata(_requests(c), c.obs, ["size_factor", "batch_id"]), 6, "size_factor")


@query("join6_local_to_global_counts", "SELECT o.dataset_index, o.global_row_index, o.origin_index, v.global_feature_id, o.count FROM coo o JOIN var v ON o.dataset_index = v.dataset_index AND o.origin_index = v.origin_index", True)
def _(c: Corpus):
    return ga.to_global(c.coo, c.var).select("dataset_index", "global_row_index", "origin_index", "global_feature_id", "count")


@query("agg1_row_sums", "SELECT dataset_index, global_row_index, row_sum FROM rowsum", True)
def _(c: Corpus):
    return c.size_factors.select("dataset_index", "global_row_index", "row_sum")


@query("agg2_size_factors", "SELECT dataset_index, global_row_index, round(size_factor, 6) AS size_factor FROM sf", True)
def _(c: Corpus):
    return rounded(c.size_factors.select("dataset_index", "global_row_index", "size_factor"), 6, "size_factor")


@query("agg4_log1p_sums", "SELECT dataset_index, origin_index, round(sum(ln(1 + count)), 6) AS sum_log1p, round(sum(ln(1 + count) * ln(1 + count)), 6) AS sum_log1p_sq, count(*) FILTER (count > 0) AS n_cells_detected FROM coo GROUP BY 1, 2", True)
def _(c: Corpus):
    return rounded(st.log1p_sums(c.coo), 6, "sum_log1p", "sum_log1p_sq")


_LOGNORM = """+ x AS (SELECT o.dataset_index, o.origin_index, b.perturb_label, o.count, ln(1 + o.count / b.size_factor) AS x FROM coo o JOIN obs b ON o.global_row_index = b.global_row_index),
"""


@query("agg6_group_sums", _LOGNORM.rstrip().rstrip(",") + """
SELECT dataset_index, perturb_label, origin_index, round(sum(x), 6) AS s, round(sum(x * x), 6) AS q, count(*) FILTER (count > 0) AS k FROM x GROUP BY 1, 2, 3""", True)  # fmt: skip
def _(c: Corpus):
    return rounded(st.group_sums(c.coo, c.obs, "perturb_label"), 6, "s", "q")


@query("e2_lognorm_stats", _LOGNORM + """n AS (SELECT dataset_index, dataset_id, count(*) AS n_obs FROM obs GROUP BY 1, 2),
g AS (SELECT dataset_index, origin_index, sum(x) AS s, sum(x * x) AS q, count(*) FILTER (count > 0) AS k FROM x GROUP BY 1, 2),
m AS (SELECT n.dataset_id, n.dataset_index, v.gene_id, v.global_feature_id, coalesce(s, 0) / n_obs AS mean, greatest(coalesce(q, 0) / n_obs - (coalesce(s, 0) / n_obs) * (coalesce(s, 0) / n_obs), 0) AS var, n_obs, coalesce(k, 0) AS k
      FROM var v JOIN n ON v.dataset_index = n.dataset_index LEFT JOIN g ON v.dataset_index = g.dataset_index AND v.origin_index = g.origin_index)
SELECT dataset_id, dataset_index, gene_id, global_feature_id, round(mean, 6) AS mean_lognorm, round(var, 6) AS var_lognorm, round(sqrt(var), 6) AS std_lognorm, n_obs, k AS n_nonzero FROM m""", True)  # fmt: skip
def _(c: Corpus):
    return rounded(st.lognorm_stats(c.coo, c.obs, c.var, c.ledger), 6, "mean_lognorm", "var_lognorm", "std_lognorm")


_HVG = """+ n AS (SELECT dataset_index, dataset_id, count(*) AS n FROM cell GROUP BY 1, 2),
g AS (SELECT dataset_index, origin_index, sum(ln(1 + count)) AS s, sum(ln(1 + count) * ln(1 + count)) AS q, count(*) FILTER (count > 0) AS k FROM coo GROUP BY 1, 2),
a AS (SELECT n.dataset_id, v.dataset_index, v.origin_index, v.gene_id, v.global_feature_id, coalesce(k, 0) AS n_cells_detected, coalesce(s, 0) / n AS mean,
             (coalesce(q, 0) - n * (coalesce(s, 0) / n) * (coalesce(s, 0) / n)) / greatest(n - 1, 1) AS variance
      FROM var v JOIN n ON v.dataset_index = n.dataset_index LEFT JOIN g ON v.dataset_index = g.dataset_index AND v.origin_index = g.origin_index),
b AS (SELECT *, variance / (CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) AS dispersion, ln(1 + mean) AS mean_log FROM a),
c AS (SELECT *, CASE WHEN dispersion > 0 THEN ln(dispersion) END AS dispersion_log, min(mean_log) OVER (PARTITION BY dataset_index) AS lo, max(mean_log) OVER (PARTITION BY dataset_index) AS hi FROM b),
d AS (SELECT *, CASE WHEN hi = lo THEN lo - (CASE WHEN lo = 0 THEN 0.001 ELSE abs(lo) * 0.001 END) ELSE lo END AS ea, CASE WHEN hi = lo THEN hi + (CASE WHEN lo = 0 THEN 0.001 ELSE abs(lo) * 0.001 END) ELSE hi END AS eb FROM c),
e AS (SELECT *, greatest((SELECT count(*) FROM range(21) t(i) WHERE (CASE WHEN i = 20 THEN eb WHEN i = 0 AND hi <> lo THEN ea - (eb - ea) * 0.001 ELSE ea + i * ((eb - ea) / 20) END) < mean_log) - 1, 0) AS bin FROM d),
f AS (SELECT *, avg(dispersion_log) OVER (PARTITION BY dataset_index, bin) AS centre, stddev_samp(dispersion_log) OVER (PARTITION BY dataset_index, bin) AS spread FROM e),
h AS (SELECT *, (dispersion_log - (CASE WHEN spread IS NULL THEN 0 ELSE centre END)) / nullif(CASE WHEN spread IS NULL THEN centre ELSE spread END, 0) AS dispersion_norm FROM f)
"""


@query("e3_hvg", _HVG + """SELECT dataset_id, dataset_index, origin_index, gene_id, gene_id AS feature_id, round(mean, 6) AS mean, round(variance, 6) AS variance, round(dispersion, 6) AS dispersion, round(dispersion_log, 6) AS dispersion_log,
 round(dispersion_norm, 6) AS dispersion_norm, CAST(row_number() OVER w AS INT) AS hvg_rank, row_number() OVER w <= 200 AS is_hvg, row_number() OVER w <= 200 AS selected_at_default_n_hvg, n_cells_detected, round(mean, 6) AS mean_log1p_expr,
 round(variance, 6) AS variance_log1p_expr, global_feature_id FROM h WINDOW w AS (PARTITION BY dataset_index ORDER BY round(dispersion_norm, 9) DESC NULLS LAST, origin_index)""", True)  # fmt: skip
def _(c: Corpus):
    return rounded(hv.hvg(c.coo, c.cells, c.var, c.ledger, n_hvg=200, digits=9), 6, "mean", "variance", "dispersion", "dispersion_log", "dispersion_norm", "mean_log1p_expr", "variance_log1p_expr")


_WELCH = _LOGNORM + """n AS (SELECT dataset_index, perturb_label, count(*) AS n FROM obs GROUP BY 1, 2),
g AS (SELECT dataset_index, perturb_label, origin_index, sum(x) AS s, sum(x * x) AS q, count(*) FILTER (count > 0) AS k FROM x GROUP BY 1, 2, 3),
a AS (SELECT v.dataset_index, n.perturb_label, v.origin_index, v.global_feature_id, n.n, coalesce(s, 0) / n.n AS mean, coalesce(q, 0) AS q, coalesce(k, 0) / CAST(n.n AS DOUBLE) AS pct
      FROM var v JOIN n ON v.dataset_index = n.dataset_index LEFT JOIN g ON g.dataset_index = v.dataset_index AND g.perturb_label = n.perturb_label AND g.origin_index = v.origin_index),
b AS (SELECT *, CASE WHEN n > 1 THEN greatest((q - n * mean * mean) / (n - 1), 0) ELSE 0 END AS v FROM a),
t AS (SELECT p.dataset_index, p.perturb_label, p.global_feature_id, p.mean - r.mean AS apart, p.v / p.n AS va, r.v / r.n AS vb, p.n AS np, r.n AS nr, p.pct, r.pct AS pct_ref
      FROM b p JOIN b r ON p.dataset_index = r.dataset_index AND p.origin_index = r.origin_index AND r.perturb_label = 'BUILDING' WHERE p.perturb_label <> 'BUILDING')
"""


@query("e5_welch_t", _WELCH + """SELECT dataset_index, perturb_label, global_feature_id, round(apart / ln(2), 6) AS logfoldchange,
 round(CASE WHEN va + vb > 0 THEN apart / sqrt(va + vb) END, 5) AS t_stat,
 round((va + vb) * (va + vb) / nullif((CASE WHEN np > 1 THEN va * va / (np - 1) ELSE 0 END) + (CASE WHEN nr > 1 THEN vb * vb / (nr - 1) ELSE 0 END), 0), 3) AS df, round(pct, 6) AS pct_perturbed, round(pct_ref, 6) AS pct_reference FROM t""", True)  # fmt: skip
def _(c: Corpus):
    rows = we.contrasts(c.coo, c.obs, c.var, CONTROL)
    rows = rows.select("dataset_index", "perturb_label", "global_feature_id", (F.col("apart") / F.log(F.lit(2.0))).alias("logfoldchange"), F.when(~F.col("flat"), F.col("t_stat")).alias("t_stat"), "df", F.col("pct").alias("pct_perturbed"), F.col("pct_ref").alias("pct_reference"))
    return rounded(rounded(rounded(rows, 6, "logfoldchange", "pct_perturbed", "pct_reference"), 5, "t_stat"), 3, "df")


@query("e5_rank_genes")
def _(c: Corpus):
    return we.rank_genes(c.coo, c.obs, c.var, c.ledger, CONTROL)


@query("win4_benjamini_hochberg", """WITH r AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_tax * l_discount AS p_value, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_tax * l_discount) AS k, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem),
b AS (SELECT *, min(p_value * n / k) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM r)
SELECT l_orderkey, l_linenumber, round(p_value, 8) AS p_value, round(least(q, 1), 8) AS p_adj FROM b""")  # fmt: skip
def _(c: Corpus):
    rows = c.table("lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", (F.col("l_tax") * F.col("l_discount")).alias("p_value"))
    return rounded(we.adjusted(rows, ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "p_value", "p_adj"), 8, "p_value", "p_adj")


HVGS, COMPONENTS = 2000, 50


def _selected(c: Corpus):
    return pc.select_features(hv.hvg(c.coo, c.cells, c.var, c.ledger, n_hvg=HVGS, digits=9), c.var)


def _components(c: Corpus) -> int:
    """The default number of components, or as many as the smallest dataset has."""
    least = min(r["n"] for r in c.var.groupBy("dataset_index").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a dataset
    rows = min(r["cell_count"] for r in c.ledger.collect())
    return min(COMPONENTS, least, rows)


_PICK = _HVG + """, sel AS (SELECT dataset_index, origin_index, CAST(row_number() OVER w - 1 AS INT) AS f, CAST(row_number() OVER w AS INT) AS hvg_rank FROM h WINDOW w AS (PARTITION BY dataset_index ORDER BY round(dispersion_norm, 9) DESC NULLS LAST, origin_index) QUALIFY row_number() OVER w <= 2000)
"""


@query("e4_covariance", _PICK + """, y AS (SELECT o.dataset_index, o.global_row_index, s.f, ln(1 + o.count / b.size_factor) AS x FROM coo o JOIN obs b ON o.global_row_index = b.global_row_index JOIN sel s ON s.dataset_index = o.dataset_index AND s.origin_index = o.origin_index),
p AS (SELECT a.dataset_index, a.f AS i, b.f AS j, sum(a.x * b.x) AS xy FROM y a JOIN y b ON a.global_row_index = b.global_row_index AND a.f <= b.f GROUP BY 1, 2, 3),
t AS (SELECT dataset_index, f, sum(x) AS s FROM y GROUP BY 1, 2)
SELECT p.dataset_index, p.i, p.j, round((xy - a.s * b.s / n.n) / greatest(n.n - 1, 1), 7) AS cov FROM p JOIN t a ON a.dataset_index = p.dataset_index AND a.f = p.i JOIN t b ON b.dataset_index = p.dataset_index AND b.f = p.j JOIN n ON n.dataset_index = p.dataset_index""", True)  # fmt: skip
def _(c: Corpus):
    return rounded(pc.covariance(c.coo, c.obs, _selected(c)).drop("n_obs"), 7, "cov")


@query("e4_feature_means", _PICK + """, y AS (SELECT o.dataset_index, s.f, ln(1 + o.count / b.size_factor) AS x FROM coo o JOIN obs b ON o.global_row_index = b.global_row_index JOIN sel s ON s.dataset_index = o.dataset_index AND s.origin_index = o.origin_index)
SELECT sel.dataset_index, sel.f AS selected_feature_index, round(coalesce(sum(x), 0) / min(n.n), 8) AS mean FROM sel JOIN n ON n.dataset_index = sel.dataset_index LEFT JOIN y ON y.dataset_index = sel.dataset_index AND y.f = sel.f GROUP BY 1, 2""", True)  # fmt: skip
def _(c: Corpus):
    return rounded(pc.fit(c.coo, c.obs, _selected(c), _components(c)).select("dataset_index", "selected_feature_index", "mean"), 8, "mean")


@query("e4_pca_components")
def _(c: Corpus):
    sel = _selected(c)
    model = pc.fit(c.coo, c.obs, sel, _components(c))
    names = sel.join(F.broadcast(c.ledger.select("dataset_index", "dataset_id")), "dataset_index").select("dataset_id", "dataset_index", "selected_feature_index", "gene_id", "global_feature_id", "hvg_rank")
    return pc.loadings(model).join(names, ["dataset_index", "selected_feature_index"]).select("dataset_id", "dataset_index", "component_index", "selected_feature_index", "gene_id", "global_feature_id", "loading", "hvg_rank")


@query("e4_pca_component_stats")
def _(c: Corpus):
    return pc.component_stats(pc.fit(c.coo, c.obs, _selected(c), _components(c))).join(F.broadcast(c.ledger.select("dataset_index", "dataset_id")), "dataset_index")


@query("e4_pca_embeddings")
def _(c: Corpus):
    sel, k = _selected(c), _components(c)
    return pc.project(c.coo, c.obs, sel, pc.fit(c.coo, c.obs, sel, k), k)


@query("e4_selected_features", _PICK + "SELECT sel.dataset_index, f AS selected_feature_index, sel.origin_index AS local_feature_index, v.gene_id, v.global_feature_id, sel.hvg_rank, 'hvg_is_hvg' AS selection_source FROM sel JOIN var v ON v.dataset_index = sel.dataset_index AND v.origin_index = sel.origin_index", True)
def _(c: Corpus):
    return _selected(c).select("dataset_index", "selected_feature_index", F.col("origin_index").alias("local_feature_index"), "gene_id", "global_feature_id", "hvg_rank", "selection_source")


@query("e4a_all_features", "SELECT dataset_index, origin_index AS selected_feature_index, gene_id, global_feature_id, 'all_features' AS selection_source FROM var", True)
def _(c: Corpus):
    return pc.select_features(None, c.var).select("dataset_index", "selected_feature_index", "gene_id", "global_feature_id", "selection_source")
