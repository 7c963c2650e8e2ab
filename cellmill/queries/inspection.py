"""Queries of inspection, materialisation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inspect as ins
from ..operators import materialize as ma
from ..operators import validate as va
from ..plans.views import Corpus
from .base import Group, rounded

GROUP = Group()
query = GROUP.query
_CUSTOMER = ["c_name", "c_nationkey", "c_mktsegment"]


@query("a1_profile_fields", """WITH s AS (SELECT c_custkey AS ord, 'c_name' AS col, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
 UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY ord) AS n FROM s WHERE v IS NOT NULL),
d AS (SELECT col, v, min(n) AS n FROM r WHERE n <= 256 GROUP BY 1, 2), e AS (SELECT col, v, n, row_number() OVER (PARTITION BY col ORDER BY n) AS k FROM d)
SELECT s.col AS "column", CASE s.col WHEN 'c_nationkey' THEN 'int' ELSE 'string' END AS dtype, count(*) FILTER (s.v IS NULL) AS null_count, (SELECT count(DISTINCT v) FROM r WHERE r.col = s.col AND n <= 64) AS sampled_distinct,
 (SELECT string_agg(v, '|' ORDER BY n) FROM e WHERE e.col = s.col AND k <= 5) AS examples FROM s GROUP BY s.col""")  # fmt: skip
def _(c: Corpus):
    rows = c.table("customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return ins.profile(rows, "c_custkey", ["c_name", "c_nationkey", "segment"]).withColumn("examples", F.array_join("examples", "|"))


@query("a2_control_candidates", """SELECT * FROM (VALUES ('condition', 'Mock', 'low'), ('perturb_label', 'Non-Targeting', 'high'), ('is_control', 'yes', 'high')) t("column", candidate_values, confidence)""")
def _(c: Corpus):
    m = F.col("c_custkey") % 3
    rows = c.table("customer").select("c_custkey", F.when(m == 0, "Non-Targeting").otherwise(F.col("c_mktsegment")).alias("perturb_label"), F.when(m == 1, "Mock").otherwise("drug").alias("condition"), F.when(m == 2, "yes").otherwise("no").alias("is_control"), F.lit("x").alias("treatment"))
    return ins.control_candidates(rows, "c_custkey").select("column", F.array_join("candidate_values", "|").alias("candidate_values"), "confidence")


def _sources(c: Corpus):
    """Four count sources of the same orders: counts, log1p of counts scaled by the row's least, raw with fewer genes, and normalised."""
    rows = c.entries.select("global_row_index", "l_partkey", "count")
    least = rows.groupBy("global_row_index").agg(F.min("count").alias("least"))
    rows = rows.join(least, "global_row_index").withColumn("unit", F.floor(F.col("count") / F.col("least")).cast("double"))
    parts = [(".X", F.log1p("unit")), (".layers[counts]", F.col("count").cast("double")), (".layers[norm]", F.col("count") / 7.0), (".raw.X", F.when(F.col("l_partkey") % 2 == 0, F.col("count").cast("double")).otherwise(0.0))]
    return rows.select("global_row_index", "l_partkey", F.explode(F.array(*(F.struct(F.lit(n).alias("source"), v.alias("value")) for n, v in parts))).alias("x")).select("x.source", F.col("global_row_index").alias("row"), F.col("l_partkey").alias("gene"), "x.value")


def _shapes(c: Corpus):
    n = c.table("orders").agg(F.count(F.lit(1)).alias("n_rows"))
    g = c.table("part").agg(F.count(F.lit(1)).alias("n_genes"))
    names = c.spark.createDataFrame([(".X", 0), (".raw.X", 1), (".layers[counts]", 2), (".layers[norm]", 3)], "source string, place int")
    return names.join(F.broadcast(n)).join(F.broadcast(g))


_SRC = """+ b AS (SELECT e.global_row_index, e.l_partkey, e.count, floor(e.count / min(e.count) OVER (PARTITION BY e.global_row_index)) AS unit FROM entry e),
src AS (SELECT '.X' AS source, global_row_index AS row, ln(1 + unit) AS value FROM b UNION ALL SELECT '.layers[counts]', global_row_index, CAST(count AS DOUBLE) FROM b
 UNION ALL SELECT '.layers[norm]', global_row_index, count / 7.0 FROM b UNION ALL SELECT '.raw.X', global_row_index, CAST(count AS DOUBLE) FROM b WHERE l_partkey % 2 = 0),
shape AS (SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM part) AS g),
pick AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 31) AS BIGINT) AS row FROM range(32) t(i), shape),
st AS (SELECT source, count(*) AS n, max(abs(value - round_even(value, 0))) AS most, avg(CASE WHEN abs(value - round_even(value, 0)) > 1e-8 THEN 1.0 ELSE 0.0 END) AS share FROM src JOIN pick USING (row) GROUP BY source)
"""


@query("a3_matrix_audit", _SRC + """SELECT source, (SELECT count(*) FROM pick) AS sampled_rows, n AS sampled_nonzero, round(n / CAST((SELECT count(*) FROM pick) * (SELECT g FROM shape) AS DOUBLE), 9) AS density, round(share, 9) AS fraction_noninteger, round(most, 9) AS max_deviation,
 CASE WHEN share = 0 THEN 'pass' ELSE 'fail' END AS status FROM st""", True)  # fmt: skip
def _(c: Corpus):
    rows = ins.audit(_sources(c), _shapes(c)).select("source", "sampled_rows", "sampled_nonzero", "density", "fraction_noninteger", "max_deviation", "status")
    return rounded(rows, 9, "density", "fraction_noninteger", "max_deviation")


@query("a4_rank_sources", _SRC + """, sc AS (SELECT source, (CASE source WHEN '.layers[counts]' THEN 500 WHEN '.raw.X' THEN 450 WHEN '.X' THEN 400 ELSE 100 END) + (CASE WHEN share = 0 THEN 50 ELSE -200 END) AS score FROM st)
SELECT source, CAST(score AS INT) AS score, CAST(row_number() OVER (ORDER BY score DESC) AS INT) AS rank FROM sc""", True)  # fmt: skip
def _(c: Corpus):
    return ins.rank_sources(ins.audit(_sources(c), _shapes(c))).select("source", "score", "rank")


@query("a5_reverse_normalisation", _SRC + """, x AS (SELECT source, row, exp(value) - 1 AS x FROM src JOIN pick USING (row) WHERE source IN ('.X', '.layers[norm]')),
r AS (SELECT source, x / min(x) OVER (PARTITION BY source, row) AS ratio FROM x)
SELECT source, max(abs(ratio - round_even(ratio, 0))) <= 0.01 AS recovered FROM r GROUP BY source""", True)  # fmt: skip
def _(c: Corpus):
    values = _sources(c)
    return ins.try_recovery(values, ins.audit(values, _shapes(c))).select("source", "recovered")


@query("a6_choose_source", "SELECT '.raw.X' AS source, 'pass' AS status, 'direct' AS pass_mode, false AS uses_recovery")
def _(c: Corpus):
    values = _sources(c)
    audited = ins.audit(values, _shapes(c))
    return ins.choose_source(audited, ins.try_recovery(values, audited))


@query("set4_evenly_spaced_rows", "SELECT DISTINCT o_orderpriority AS dataset_id, CAST(floor(i * (n - 1) / 31) AS BIGINT) AS row FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), range(32) t(i)")
def _(c: Corpus):
    sizes = c.table("orders").groupBy(F.col("o_orderpriority").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("dataset_id", F.explode(ins.sample_rows(F.col("n"))).alias("row"))


@query("b1_direct_counts", "SELECT l_orderkey AS row, l_partkey AS gene, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2")
def _(c: Corpus):
    values = c.table("lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value"))
    return ma.direct_counts(values).groupBy("row", "gene").agg(F.sum("count").alias("count"))


@query("b1_recovered_counts", """+ b AS (SELECT e.global_row_index, e.l_partkey, floor(e.count / min(e.count) OVER (PARTITION BY e.global_row_index)) AS unit FROM entry e)
SELECT global_row_index AS row, l_partkey AS gene, CAST(unit AS INT) AS count FROM b""", True)  # fmt: skip
def _(c: Corpus):
    return ma.recover_counts(_sources(c).where("source = '.X'").select("row", "gene", "value")).select("row", "gene", "count")


@query("agg8_recovery_row_terms", """+ b AS (SELECT e.global_row_index, floor(e.count / min(e.count) OVER (PARTITION BY e.global_row_index)) AS unit FROM entry e)
SELECT global_row_index AS row, round(min(exp(ln(1 + unit)) - 1), 6) AS least, round(sum(exp(ln(1 + unit)) - 1), 6) AS total FROM b GROUP BY 1""", True)  # fmt: skip
def _(c: Corpus):
    rows = _sources(c).where("source = '.X'").groupBy("row").agg(F.min(F.expm1("value")).alias("least"), F.sum(F.expm1("value")).alias("total"))
    return rounded(rows, 6, "least", "total")


@query("d13_validate_corpus", """SELECT * FROM (VALUES ('contiguous_ranges', true), ('indices_follow_positions', true), ('no_empty_dataset', true), ('unique_dataset_ids', true), ('rows_match_ledger', true), ('global_is_start_plus_local', true), ('no_orphan_rows', true), ('sampled_rows_exist', true)) t("check", ok)""")
def _(c: Corpus):
    return va.validate(c.ledger, c.obs, c.sparse_rows)
