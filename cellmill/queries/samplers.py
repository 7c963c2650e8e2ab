"""Queries of row samplers, gene samplers and pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as arrow
from pyspark.sql import functions as F

from ..operators import blocks as bl
from ..operators import features as fe
from ..operators import gather as ga
from ..operators import hvg as hv
from ..operators import loaders as lo
from ..operators import pairs as pa
from ..operators import sampling as sa
from ..plans.views import CONTROL, Corpus
from .base import Group, rounded
from .corpus import _HVG

GROUP = Group()
query = GROUP.query
_U = "(CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT) + 1) / 4294967297.0"


@query("d4_random_batches", """WITH t AS (SELECT b.i AS batch_id, t.i AS n, CAST(('0x' || substr(md5('7|1|' || CAST(b.i AS VARCHAR) || '|' || CAST(t.i AS VARCHAR)), 1, 15)) AS BIGINT) % (SELECT count(*) FROM orders) AS global_row_index FROM range((SELECT CAST(ceil(count(*) / 128.0) AS BIGINT) FROM orders)) b(i), range(320) t(i)),
k AS (SELECT batch_id, global_row_index, min(n) AS key FROM t GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY key) AS place FROM k)
SELECT CAST(batch_id AS INT) AS batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY global_row_index) - 1 AS INT) AS pos, global_row_index FROM p WHERE place <= least(128, (SELECT count(*) FROM orders) - batch_id * 128)""")  # fmt: skip
def _(c: Corpus):
    return sa.random_batches(c.spark, c.table("orders").count(), 128, None, seed=7, epoch=1)


@query("d4_large_batches", """+ k AS (SELECT b.i AS batch_id, c.global_row_index, row_number() OVER (PARTITION BY b.i ORDER BY md5('7|1|' || CAST(b.i AS VARCHAR) || '|' || CAST(c.global_row_index AS VARCHAR)), c.global_row_index) AS n, (SELECT count(*) FROM orders) // 2 AS size FROM cell c, range((SELECT CAST(ceil(count(*) / (count(*) // 2)) AS BIGINT) FROM orders)) b(i))
SELECT CAST(batch_id AS INT) AS batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY global_row_index) - 1 AS INT) AS pos, global_row_index FROM k WHERE n <= least(size, (SELECT count(*) FROM orders) - batch_id * size)""", True)  # fmt: skip
def _(c: Corpus):
    n = c.table("orders").count()
    return sa.random_batches(c.spark, n, n // 2, None, seed=7, epoch=1)


@query("d5_context_batches", """+ k AS (SELECT cell_context, global_row_index, row_number() OVER (PARTITION BY cell_context ORDER BY md5('3|0|' || CAST(global_row_index AS VARCHAR)), global_row_index) - 1 AS n, count(*) OVER (PARTITION BY cell_context) AS many FROM obs)
SELECT cell_context, CAST(n // 64 AS BIGINT) AS batch_in_context, CAST(n % 64 AS INT) AS pos, global_row_index FROM k WHERE (n // 64 + 1) * 64 <= many""", True)  # fmt: skip
def _(c: Corpus):
    return sa.context_batches(c.obs, "cell_context", 64, seed=3, drop_last=True)


@query("d6_sampler_lengths", "SELECT cell_context, CAST(ceil(count(*) / 64.0) AS BIGINT) AS n_batches FROM obs GROUP BY 1", True)
def _(c: Corpus):
    return sa.n_batches(c.obs, "cell_context", 64)


@query("agg13_context_row_lists", """+ k AS (SELECT batch_id, global_row_index, (row_number() OVER (PARTITION BY batch_id ORDER BY global_row_index) - 1) // 100 AS part FROM obs)
SELECT batch_id, part, count(*) AS n, min(global_row_index) AS first, md5(string_agg(CAST(global_row_index AS VARCHAR), ',' ORDER BY global_row_index)) AS digest FROM k GROUP BY 1, 2""", True)  # fmt: skip
def _(c: Corpus):
    rows = sa.row_lists(c.obs, "batch_id", 100)
    return rows.select("batch_id", "part", F.size("rows").cast("long").alias("n"), F.element_at("rows", 1).alias("first"), F.md5(F.array_join("rows", ",")).alias("digest"))


def _cells(c: Corpus):
    return c.cells.select("global_row_index", "dataset_index")


def _rows(c: Corpus):
    """Sparse rows of all cells with their dataset."""
    return c.sparse_rows.join(_cells(c), "global_row_index")


def _genes(c: Corpus):
    ranks = hv.hvg(c.coo, c.cells, c.var, c.ledger, n_hvg=200, digits=9).select("dataset_index", "origin_index", "hvg_rank", "is_hvg")
    return c.var.join(ranks, ["dataset_index", "origin_index"]).select("dataset_index", "origin_index", "global_feature_id", "hvg_rank", "is_hvg")


def _plain_genes(c: Corpus):
    return c.var.select("dataset_index", "origin_index", "global_feature_id", F.lit(1).alias("hvg_rank"), F.lit(False).alias("is_hvg"))


def _counts(c: Corpus):
    return ga.to_global(c.coo, c.var).select("global_row_index", "global_feature_id", "origin_index", "count")


_B = """+ cnt AS (SELECT o.global_row_index, o.dataset_index, o.origin_index, v.global_feature_id, o.count FROM coo o JOIN var v ON o.dataset_index = v.dataset_index AND o.origin_index = v.origin_index),
size AS (SELECT dataset_index, count(*) AS n FROM var GROUP BY 1),
own AS (SELECT c.global_row_index, c.dataset_index, s.n, coalesce(e.k, 0) AS k FROM cell c JOIN size s ON s.dataset_index = c.dataset_index LEFT JOIN (SELECT global_row_index, count(*) AS k FROM cnt WHERE count > 0 GROUP BY 1) e ON e.global_row_index = c.global_row_index)
"""
_S = _B + """, tried AS (SELECT o.global_row_index, o.dataset_index, CAST(('0x' || substr(md5('11|' || CAST(o.global_row_index AS VARCHAR) || '|0|' || CAST(t.i AS VARCHAR)), 1, 15)) AS BIGINT) % o.n AS number, min(t.i) AS i FROM own o, range(128) t(i) GROUP BY 1, 2, 3),
numbers AS (SELECT t.global_row_index, t.dataset_index, t.number, row_number() OVER (PARTITION BY t.global_row_index ORDER BY t.i) AS i FROM tried t LEFT JOIN cnt ON cnt.global_row_index = t.global_row_index AND cnt.origin_index = t.number AND cnt.count > 0 WHERE cnt.count IS NULL),
keys AS (SELECT o.global_row_index, t.i, sum(-ln(""" + _U.format("'11|' || CAST(o.global_row_index AS VARCHAR) || '|0|key|' || CAST(t.i AS VARCHAR)") + """) / (o.n - o.k - t.i + 1)) OVER (PARTITION BY o.global_row_index ORDER BY t.i) AS key FROM own o, range(1, 33) t(i)),
found AS (SELECT n.global_row_index, n.dataset_index, n.number, round(k.key, 9) AS key FROM numbers n JOIN keys k ON k.global_row_index = n.global_row_index AND k.i = n.i
 UNION ALL SELECT global_row_index, dataset_index, origin_index, round(-ln(""" + _U.format("'11|' || CAST(global_row_index AS VARCHAR) || '|hot|' || CAST(origin_index AS VARCHAR)") + """) / 4.0, 9) FROM cnt WHERE count > 0),
drawn AS (SELECT *, row_number() OVER (PARTITION BY global_row_index ORDER BY key, number) - 1 AS seq FROM found),
s AS (SELECT d.global_row_index, CAST(d.seq AS INT) AS seq, v.global_feature_id FROM drawn d JOIN var v ON v.dataset_index = d.dataset_index AND v.origin_index = d.number WHERE d.seq < 32)
"""  # fmt: skip


@query("d7_gene_weights_expressed", _B + """SELECT o.global_row_index, o.dataset_index, c.global_feature_id, round(4.0 / (o.n + 3.0 * o.k), 9) AS prob FROM own o JOIN cnt c ON c.global_row_index = o.global_row_index AND c.count > 0
UNION ALL SELECT global_row_index, dataset_index, NULL, round(1.0 / (n + 3.0 * k), 9) FROM own""", True)  # fmt: skip
def _(c: Corpus):
    return rounded(sa.cell_weights(_rows(c), _plain_genes(c)), 9, "prob")


@query("d7_gene_weights_uniform", "SELECT dataset_index, global_feature_id, round(1.0 / count(*) OVER (PARTITION BY dataset_index), 9) AS prob FROM var", True)
def _(c: Corpus):
    return rounded(sa.dataset_weights(_plain_genes(c)), 9, "prob")


@query("d7_gene_weights_hvg", _HVG + """, r AS (SELECT dataset_index, global_feature_id, CASE WHEN row_number() OVER (PARTITION BY dataset_index ORDER BY round(dispersion_norm, 9) DESC NULLS LAST, origin_index) <= 100 THEN 4.0 ELSE 1.0 END AS w FROM h)
SELECT dataset_index, global_feature_id, round(w / sum(w) OVER (PARTITION BY dataset_index), 9) AS prob FROM r""", True)
def _(c: Corpus):
    return rounded(sa.dataset_weights(_genes(c), "hvg", hvg_top_k=100), 9, "prob")


@query("d8_sampled_genes", _S + "SELECT global_row_index, seq, global_feature_id FROM s", True)
def _(c: Corpus):
    return sa.sample_rows_genes(_rows(c), _plain_genes(c), 32, 11)


@query("d8_sampled_hvg_genes", _HVG + """, r AS (SELECT dataset_index, origin_index, global_feature_id, CASE WHEN row_number() OVER (PARTITION BY dataset_index ORDER BY round(dispersion_norm, 9) DESC NULLS LAST, origin_index) <= 100 THEN 1 ELSE 0 END AS urn FROM h),
num AS (SELECT *, row_number() OVER (PARTITION BY dataset_index, urn ORDER BY origin_index) - 1 AS number, count(*) OVER (PARTITION BY dataset_index, urn) AS n FROM r), size AS (SELECT DISTINCT dataset_index, urn, n FROM num),
tried AS (SELECT c.global_row_index, c.dataset_index, s.urn, CAST(('0x' || substr(md5('11|' || CAST(c.global_row_index AS VARCHAR) || '|' || CAST(s.urn AS VARCHAR) || '|' || CAST(t.i AS VARCHAR)), 1, 15)) AS BIGINT) % s.n AS number, min(t.i) AS i FROM cell c JOIN size s ON s.dataset_index = c.dataset_index, range(128) t(i) GROUP BY 1, 2, 3, 4),
numbers AS (SELECT *, row_number() OVER (PARTITION BY global_row_index, urn ORDER BY i) AS k FROM tried),
keys AS (SELECT c.global_row_index, s.urn, t.i AS k, sum(-ln(""" + _U.format("'11|' || CAST(c.global_row_index AS VARCHAR) || '|' || CAST(s.urn AS VARCHAR) || '|key|' || CAST(t.i AS VARCHAR)") + """) / ((s.n - t.i + 1) * (1 + 3.0 * s.urn))) OVER (PARTITION BY c.global_row_index, s.urn ORDER BY t.i) AS key FROM cell c JOIN size s ON s.dataset_index = c.dataset_index, range(1, 33) t(i)),
drawn AS (SELECT m.*, row_number() OVER (PARTITION BY m.global_row_index ORDER BY round(e.key, 9), m.urn, m.number) - 1 AS seq FROM numbers m JOIN keys e ON e.global_row_index = m.global_row_index AND e.urn = m.urn AND e.k = m.k)
SELECT d.global_row_index, CAST(d.seq AS INT) AS seq, num.global_feature_id FROM drawn d JOIN num ON num.dataset_index = d.dataset_index AND num.urn = d.urn AND num.number = d.number WHERE d.seq < 32""", True)  # fmt: skip
def _(c: Corpus):
    return sa.sample_rows_genes(_rows(c), _genes(c), 32, 11, "hvg", hvg_top_k=100)


_D9 = _B + """, r AS (SELECT c.global_row_index, c.dataset_index, t.i AS seq, (c.global_row_index * 31 + t.i * 17) % 2100 AS global_feature_id FROM cell c, range(32) t(i)),
w AS (SELECT r.global_row_index, CAST(r.seq AS INT) AS seq, r.global_feature_id, v.global_feature_id IS NOT NULL AS valid, CASE WHEN v.global_feature_id IS NULL THEN -1 ELSE coalesce(n.count, 0) END AS count
 FROM r LEFT JOIN var v ON v.dataset_index = r.dataset_index AND v.global_feature_id = r.global_feature_id LEFT JOIN cnt n ON n.global_row_index = r.global_row_index AND n.global_feature_id = r.global_feature_id)
"""


def _asked(c: Corpus):
    seq = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("seq")
    return _cells(c).select("global_row_index", seq).withColumn("global_feature_id", F.pmod(F.col("global_row_index") * 31 + F.col("seq") * 17, F.lit(2100)))


def _processed(c: Corpus):
    """The cells' own arrays for the genes of _asked."""
    asked = F.array(*(F.pmod(F.col("global_row_index") * 31 + seq * 17, F.lit(2100)) for seq in range(32)))
    return sa.process_arrays(_rows(c).withColumn("genes", asked), c.var, 32)


@query("d9_process_batch", _D9 + "SELECT global_row_index, seq, global_feature_id, count, valid FROM w", True)
def _(c: Corpus):
    return bl.exploded(_processed(c), global_feature_id="genes", count="counts", valid="mask")


@query("d9a_supplied_genes", _D9 + "SELECT global_row_index, seq, global_feature_id FROM w", True)
def _(c: Corpus):
    return sa.check_supplied(_asked(c), 32)


@query("join10_tokens", _D9 + "SELECT global_row_index, seq, global_feature_id, count, valid, CASE WHEN valid THEN global_feature_id + 4 ELSE 0 END AS token_id FROM w", True)
def _(c: Corpus):
    return sa.tokenize_arrays(_processed(c), fe.token_map(fe.vocabulary(c.var)), policy="pad")


@query("d10_loader_batches", _S + """SELECT s.global_row_index, string_agg(CAST(s.global_feature_id AS VARCHAR), ',' ORDER BY seq) AS genes, string_agg(CAST(coalesce(c.count, 0) AS VARCHAR), ',' ORDER BY seq) AS counts
FROM s LEFT JOIN cnt c ON c.global_row_index = s.global_row_index AND c.global_feature_id = s.global_feature_id GROUP BY 1""", True)  # fmt: skip
def _(c: Corpus):
    rows = sa.process_arrays(sa.sample_arrays(_rows(c), _plain_genes(c), 32, 11), c.var, 32)
    return rows.select("global_row_index", F.array_join("genes", ",").alias("genes"), F.array_join("counts", ",").alias("counts"))


_CONFIG = pa.PairConfig(controls=(CONTROL,), batch_size=64, seed=5, treated_target="matched_control_cell")
_K = "CAST(('0x' || substr(md5('5|0|{}|' || CAST({} AS VARCHAR)), 1, 8)) AS BIGINT)"
_PAIRS = """+ num AS (SELECT global_row_index, dataset_index, cell_context, perturb_label, row_number() OVER (PARTITION BY dataset_index, cell_context, perturb_label ORDER BY global_row_index) - 1 AS k, count(*) OVER (PARTITION BY dataset_index, cell_context, perturb_label) AS many FROM obs),
pool AS (SELECT dataset_index, cell_context, perturb_label, count(*) AS many, row_number() OVER (PARTITION BY dataset_index, cell_context ORDER BY perturb_label) - 1 AS j FROM obs WHERE perturb_label <> 'BUILDING' GROUP BY 1, 2, 3),
ch AS (SELECT dataset_index, cell_context, count(*) AS choices FROM pool GROUP BY 1, 2),
a AS (SELECT n.global_row_index AS source_row, n.dataset_index, n.cell_context, """ + _K.format("label", "n.global_row_index") + """ % choices AS j FROM num n JOIN ch USING (dataset_index, cell_context) WHERE n.perturb_label = 'BUILDING'),
a2 AS (SELECT a.source_row, a.dataset_index, a.cell_context, pool.perturb_label, """ + _K.format("row", "a.source_row") + """ % pool.many AS k FROM a JOIN pool ON a.dataset_index = pool.dataset_index AND a.cell_context = pool.cell_context AND a.j = pool.j),
b AS (SELECT n.global_row_index AS source_row, n.dataset_index, n.cell_context, """ + _K.format("control", "n.global_row_index") + """ % c.many AS k FROM num n JOIN (SELECT DISTINCT dataset_index, cell_context, many FROM num WHERE perturb_label = 'BUILDING') c USING (dataset_index, cell_context) WHERE n.perturb_label <> 'BUILDING'),
pr AS (SELECT a2.source_row, t.global_row_index AS target_row, t.perturb_label AS target_label FROM a2 JOIN num t ON t.dataset_index = a2.dataset_index AND t.cell_context = a2.cell_context AND t.perturb_label = a2.perturb_label AND t.k = a2.k
 UNION ALL SELECT b.source_row, t.global_row_index, t.perturb_label FROM b JOIN num t ON t.dataset_index = b.dataset_index AND t.cell_context = b.cell_context AND t.perturb_label = 'BUILDING' AND t.k = b.k)
"""  # fmt: skip


def _paired(c: Corpus):
    return pa.pairs(pa.prepare(c.obs, _CONFIG), _CONFIG)


@query("p3_pairs", _PAIRS + "SELECT source_row, target_row, target_label FROM pr", True)
def _(c: Corpus):
    return _paired(c)


@query("p4_pair_batches", _PAIRS + """, o AS (SELECT source_row, target_row, target_label, row_number() OVER (ORDER BY md5('5|0|order|' || CAST(source_row AS VARCHAR)), source_row) - 1 AS n FROM pr)
SELECT source_row, target_row, target_label, CAST(n // 64 AS BIGINT) AS batch_id, n % 64 AS pos FROM o""", True)  # fmt: skip
def _(c: Corpus):
    return pa.batches(_paired(c), _CONFIG)


@query("p2_label_ids", """+ f AS (SELECT perturb_label AS label, min(global_row_index) AS first_row FROM obs WHERE perturb_label NOT IN ('absent', 'BUILDING') GROUP BY 1)
SELECT 'absent' AS label, 0 AS label_id UNION ALL SELECT 'BUILDING', 1 UNION ALL SELECT label, row_number() OVER (ORDER BY first_row) + 1 FROM f""", True)  # fmt: skip
def _(c: Corpus):
    config = pa.PairConfig(controls=("absent", CONTROL))
    return pa.label_ids(pa.prepare(c.obs, config), config)


_P5 = _PAIRS.replace("+ num", _D9.lstrip().removeprefix("+ ").rstrip() + ", num", 1).replace("cnt AS", "+ cnt AS", 1)


@query("p5_paired_batch", _P5 + """SELECT pr.source_row, pr.target_row, pr.target_label, w.seq, w.global_feature_id, CASE WHEN w.valid THEN w.count ELSE -2 END AS source_value,
 CASE WHEN tv.global_feature_id IS NULL THEN -2 ELSE coalesce(ct.count, 0) END AS target_value, round(so.size_factor, 6) AS source_size_factor, round(ta.size_factor, 6) AS target_size_factor
FROM pr JOIN w ON w.global_row_index = pr.source_row JOIN obs so ON so.global_row_index = pr.source_row JOIN obs ta ON ta.global_row_index = pr.target_row
LEFT JOIN var tv ON tv.dataset_index = ta.dataset_index AND tv.global_feature_id = w.global_feature_id LEFT JOIN cnt ct ON ct.global_row_index = pr.target_row AND ct.global_feature_id = w.global_feature_id""", True)  # fmt: skip
def _(c: Corpus):
    return rounded(pa.paired_batch(_paired(c), _asked(c), _counts(c), c.var, c.obs), 6, "source_size_factor", "target_size_factor")


@query("p2a_lookup_rows", "+ r AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7919) % (SELECT count(*) FROM orders) AS global_row_index FROM lineitem) SELECT r.l_orderkey, r.l_linenumber, r.global_row_index, o.perturb_label, o.cell_context FROM r JOIN obs o ON o.global_row_index = r.global_row_index", True)
def _(c: Corpus):
    asked = c.table("lineitem").select("l_orderkey", "l_linenumber", F.pmod(F.col("l_partkey") * 7919, F.lit(c.table("orders").count())).alias("global_row_index"))
    return pa.lookup_rows(asked, pa.prepare(c.obs, _CONFIG).select("global_row_index", "perturb_label", "cell_context"))


@query("p5b_batch_checks", "SELECT * FROM (VALUES ('shape', true), ('pairs', (SELECT count(*) > 0 FROM orders)), ('sources', (SELECT count(*) > 0 FROM customer)), ('size_factors', (SELECT min(l_quantity) > 0 FROM lineitem))) x(\"check\", ok)")
def _(c: Corpus):
    paired = _paired(c)
    return pa.check_batch(paired, pa.paired_batch(paired, _asked(c), _counts(c), c.var, c.obs), 32)


@query("p7_masked_values", _D9 + """, m AS (SELECT *, row_number() OVER (PARTITION BY global_row_index ORDER BY CASE WHEN valid THEN 0 ELSE 1 END, md5('9|mask|' || CAST(global_row_index AS VARCHAR) || '|' || CAST(seq AS VARCHAR)), seq) AS n, count(*) FILTER (valid) OVER (PARTITION BY global_row_index) AS many FROM w)
SELECT global_row_index, seq, global_feature_id, count, valid, valid AND n <= floor(many * 0.15) AS masked, CASE WHEN valid AND n <= floor(many * 0.15) THEN -1 WHEN valid THEN count ELSE -2 END AS value FROM m""", True)  # fmt: skip
def _(c: Corpus):
    return pa.mask_arrays(_processed(c), 0.15, 9)


@query("p6_prepend_cls", _D9 + "SELECT global_row_index, '1,' || string_agg(CAST(global_feature_id AS VARCHAR), ',' ORDER BY seq) AS genes, '-3,' || string_agg(CAST(count AS VARCHAR), ',' ORDER BY seq) AS counts FROM w GROUP BY 1", True)
def _(c: Corpus):
    rows = pa.with_cls(_processed(c), 1)
    return rows.select("global_row_index", F.array_join("genes", ",").alias("genes"), F.array_join("counts", ",").alias("counts"))


@query("p8_full_expression", _B + """, g AS (SELECT count(*) AS size FROM gene), e AS (SELECT global_row_index, sum(count) AS total, sum(count * (global_feature_id + 1)) AS weighted FROM cnt GROUP BY 1), m AS (SELECT dataset_index, count(*) AS n_valid, sum(global_feature_id) AS valid_sum FROM var GROUP BY 1)
SELECT c.global_row_index, g.size, CAST(coalesce(e.total, 0) AS BIGINT) AS total, CAST(coalesce(e.weighted, 0) AS BIGINT) AS weighted, m.n_valid, CAST(m.valid_sum AS BIGINT) AS valid_sum FROM cell c JOIN m ON m.dataset_index = c.dataset_index, g LEFT JOIN e ON e.global_row_index = c.global_row_index""", True)  # fmt: skip
def _(c: Corpus):
    def digest(ids, dataset, counts, valid):
        n, v = counts.shape
        weighted = np.einsum("ij,j->i", counts, np.arange(1, v + 1, dtype=np.int64))
        parts = [ids, np.full(n, v), counts.sum(axis=1, dtype=np.int64), weighted, np.full(n, valid.sum()), np.full(n, np.flatnonzero(valid).sum())]
        return arrow.RecordBatch.from_arrays([arrow.array(x.astype(np.int64)) for x in parts], names=["global_row_index", "size", "total", "weighted", "n_valid", "valid_sum"])

    schema = "global_row_index long, size long, total long, weighted long, n_valid long, valid_sum long"
    return pa.full_blocks(_rows(c), c.var, fe.token_map(fe.vocabulary(c.var)), digest, schema)


def _loader(c: Corpus, **options):
    return lo.Loader(c.sparse_rows, c.obs, _plain_genes(c), lo.Options(seq_len=16, **options), fe.token_map(fe.vocabulary(c.var)))


@query("d17_context_loader", """+ k AS (SELECT cell_context, perturb_label, count(*) AS n FROM obs GROUP BY 1, 2), s AS (SELECT dataset_index, count(*) AS g FROM var GROUP BY 1)
SELECT cell_context, perturb_label, CAST(ceil(n / 64.0) AS BIGINT) AS batches, n AS examples, n * 16 AS places, n * 16 AS tokens FROM k""", True)  # fmt: skip
def _(c: Corpus):
    rows = _loader(c, sampler="context", context=("cell_context", "perturb_label"), batch_size=64, metadata=("cell_context", "perturb_label")).examples()
    size = lambda name: F.sum(F.size(name).cast("long"))
    own = F.sum(F.size(F.filter("tokens", lambda x: x >= 4)).cast("long"))
    return rows.groupBy("cell_context", "perturb_label").agg(F.count_distinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("examples"), size("genes").alias("places"), own.alias("tokens"))


@query("p10_paired_loader", """+ n AS (SELECT count(*) AS n FROM obs WHERE dataset_index <> 1) SELECT n // 64 AS batches, n // 64 * 64 AS pairs, n // 64 * 64 * 16 AS places, n // 64 * 64 * 2 AS masked FROM n""", True)
def _(c: Corpus):
    some = c.obs.where("dataset_index <> 1").select("global_row_index")
    loader = lo.PairedLoader(_loader(c, mode="expressed"), _CONFIG, sources=some)
    loader.set_epoch(2)
    rows = loader.examples()
    masked = F.size(F.filter("masked", lambda x: x)).cast("long")
    return rows.agg(F.count_distinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("pairs"), F.sum(F.size("genes").cast("long")).alias("places"), F.sum(masked).alias("masked"))


@query("x_stratified_rows", """+ k AS (SELECT batch_id, global_row_index, row_number() OVER (PARTITION BY batch_id ORDER BY md5('2|' || CAST(global_row_index AS VARCHAR)), global_row_index) AS n FROM obs)
SELECT batch_id, global_row_index FROM k WHERE n <= 20""", True)  # fmt: skip
def _(c: Corpus):
    return sa.stratified(c.obs.select("batch_id", "global_row_index"), "batch_id", 20, 2)
