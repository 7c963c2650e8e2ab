"""Corpus views over star-schema tables: datasets, cells, genes and counts.

A dataset is an order priority, a cell an order, a gene a part, a count the
summed quantity of a part in an order; a perturbation label is the customer's
market segment (control: BUILDING), a cell context their region, a batch their
nation. Orders without line items are cells without counts.

Views are DataFrames; those that are read many times (genes, counts, obs) are
written once, or plans repeat them at every use until they outgrow the driver.
``WITH`` is the same in SQL, for oracles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import stored
from .ordering import dense_position

CONTROL = "BUILDING"

WITH = """
ds AS (SELECT o_orderpriority AS dataset_id, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS dataset_index
       FROM (SELECT DISTINCT o_orderpriority FROM orders)),
cell AS (SELECT o.o_orderkey, o.o_custkey, d.dataset_id, d.dataset_index,
                row_number() OVER (PARTITION BY d.dataset_index ORDER BY o.o_orderkey) - 1 AS local_row_index,
                row_number() OVER (ORDER BY d.dataset_index, o.o_orderkey) - 1 AS global_row_index
         FROM orders o JOIN ds d ON o.o_orderpriority = d.dataset_id),
ledger AS (SELECT dataset_index, dataset_id, count(*) AS cell_count, min(global_row_index) AS global_start, max(global_row_index) + 1 AS global_end
           FROM cell GROUP BY dataset_index, dataset_id),
entry AS (SELECT c.dataset_index, c.global_row_index, c.local_row_index, l.l_partkey, CAST(sum(CAST(l.l_quantity AS INT)) AS INT) AS count
          FROM lineitem l JOIN cell c ON l.l_orderkey = c.o_orderkey GROUP BY 1, 2, 3, 4),
var0 AS (SELECT dataset_index, l_partkey, CAST(row_number() OVER (PARTITION BY dataset_index ORDER BY l_partkey) - 1 AS INT) AS origin_index
         FROM (SELECT DISTINCT dataset_index, l_partkey FROM entry)),
gene0 AS (SELECT l_partkey, min(CAST(dataset_index AS BIGINT) * 1000000000 + origin_index) AS place FROM var0 GROUP BY l_partkey),
gene AS (SELECT l_partkey, row_number() OVER (ORDER BY place) - 1 AS global_feature_id FROM gene0),
var AS (SELECT v.dataset_index, v.origin_index, v.l_partkey, 'P' || CAST(v.l_partkey AS VARCHAR) AS gene_id, g.global_feature_id
        FROM var0 v JOIN gene g ON v.l_partkey = g.l_partkey),
coo AS (SELECT e.dataset_index, e.global_row_index, v.origin_index, e.count
        FROM entry e JOIN var v ON e.dataset_index = v.dataset_index AND e.l_partkey = v.l_partkey),
rowsum AS (SELECT c.dataset_index, c.global_row_index, CAST(coalesce(sum(e.count), 0) AS BIGINT) AS row_sum
           FROM cell c LEFT JOIN entry e ON c.global_row_index = e.global_row_index GROUP BY 1, 2),
med AS (SELECT dataset_index, median(CAST(row_sum AS DOUBLE)) AS m FROM rowsum GROUP BY 1),
sf AS (SELECT r.dataset_index, r.global_row_index, CAST(CAST(CASE WHEN r.row_sum / (CASE WHEN m <= 0 THEN 1.0 ELSE m END) <= 0 THEN 1.0
         ELSE r.row_sum / (CASE WHEN m <= 0 THEN 1.0 ELSE m END) END AS FLOAT) AS DOUBLE) AS size_factor
       FROM rowsum r JOIN med USING (dataset_index)),
obs AS (SELECT c.global_row_index, c.local_row_index, c.dataset_index, c.dataset_id, 'C' || CAST(c.o_orderkey AS VARCHAR) AS cell_id, s.size_factor,
               cu.c_mktsegment AS perturb_label, r.r_name AS cell_context, n.n_name AS batch_id
        FROM cell c JOIN sf s ON c.global_row_index = s.global_row_index JOIN customer cu ON c.o_custkey = cu.c_custkey
        JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)
"""


@dataclass
class Corpus:
    """Lazy views of one directory of tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def datasets(self) -> DataFrame:
        names = self.table("orders").select(F.col("o_orderpriority").alias("dataset_id")).distinct()
        return names.select("dataset_id", (F.row_number().over(Window.orderBy("dataset_id")) - 1).alias("dataset_index"))

    @cached_property
    def ledger(self) -> DataFrame:
        """dataset_index, dataset_id, cell_count, global_start, global_end: half-open ranges that follow each other from 0."""
        counts = self.table("orders").groupBy(F.col("o_orderpriority").alias("dataset_id")).agg(F.count(F.lit(1)).alias("cell_count"))
        end = F.sum("cell_count").over(Window.orderBy("dataset_index").rowsBetween(Window.unboundedPreceding, 0))
        rows = counts.withColumn("dataset_index", F.row_number().over(Window.orderBy("dataset_id")) - 1)
        return rows.select("dataset_index", "dataset_id", "cell_count", (end - F.col("cell_count")).alias("global_start"), end.alias("global_end"))

    @cached_property
    def cells(self) -> DataFrame:
        """o_orderkey, o_custkey, dataset_id, dataset_index, local_row_index, global_row_index: positions by dataset and key, without one task a dataset."""
        own = F.broadcast(self.ledger.select("dataset_id", "dataset_index", "global_start"))  # one row a dataset
        rows = self.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("dataset_id")).join(own, "dataset_id")
        placed = dense_position(rows, [F.col("dataset_index"), F.col("o_orderkey")], "global_row_index")
        return placed.select("o_orderkey", "o_custkey", "dataset_id", "dataset_index", (F.col("global_row_index") - F.col("global_start")).alias("local_row_index"), "global_row_index")

    @cached_property
    def entries(self) -> DataFrame:
        """dataset_index, global_row_index, l_partkey, count: the counts by part, pre-aggregated before the join."""
        lines = self.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("count"))
        return lines.join(self.cells, F.col("l_orderkey") == F.col("o_orderkey")).select("dataset_index", "global_row_index", "l_partkey", "count")

    @cached_property
    def var(self) -> DataFrame:
        """dataset_index, origin_index, gene_id, canonical_gene_id, global_feature_id (first appearance by dataset, then origin)."""
        from ..operators.features import first_appearance

        lines = self.table("lineitem").select("l_orderkey", "l_partkey").join(self.table("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        genes = lines.select("o_orderpriority", "l_partkey").distinct().join(F.broadcast(self.datasets), F.col("o_orderpriority") == F.col("dataset_id"))
        origin = F.row_number().over(Window.partitionBy("dataset_index").orderBy("l_partkey")) - 1
        genes = genes.select("dataset_index", "l_partkey", origin.alias("origin_index"), F.concat(F.lit("P"), F.col("l_partkey")).alias("gene_id"))
        ids = first_appearance(genes, "gene_id").select("gene_id", F.col("global_id").alias("global_feature_id"))
        return stored(genes.join(ids, "gene_id").select("dataset_index", "origin_index", "gene_id", F.col("gene_id").alias("canonical_gene_id"), "global_feature_id", "l_partkey"))

    @cached_property
    def coo(self) -> DataFrame:
        """dataset_index, global_row_index, origin_index, count."""
        keys = self.var.select("dataset_index", "l_partkey", "origin_index")
        return stored(self.entries.join(keys, ["dataset_index", "l_partkey"]).select("dataset_index", "global_row_index", "origin_index", "count"))

    @cached_property
    def size_factors(self) -> DataFrame:
        """dataset_index, global_row_index, row_sum, size_factor."""
        from ..operators.materialize import size_factors

        return size_factors(self.cells, self.entries)

    @cached_property
    def obs(self) -> DataFrame:
        """One row a cell with its identity, size factor, label, context and batch."""
        who = self.table("customer").join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        who = who.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("perturb_label"), F.col("r_name").alias("cell_context"), F.col("n_name").alias("batch_id"))
        sf = self.size_factors.select("global_row_index", "size_factor")
        rows = self.cells.join(who, "o_custkey").join(sf, "global_row_index")
        return stored(rows.select("global_row_index", "local_row_index", "dataset_index", "dataset_id", F.concat(F.lit("C"), F.col("o_orderkey")).alias("cell_id"), "size_factor", "perturb_label", "cell_context", "batch_id"))

    @cached_property
    def sparse_rows(self) -> DataFrame:
        """global_row_index, expressed_gene_indices, expression_counts: parallel arrays by origin index; empty for cells without counts."""
        from ..operators.gather import to_sparse_rows

        return to_sparse_rows(self.cells, self.coo)
