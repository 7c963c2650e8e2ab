"""Structural checks of a corpus, one row a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import draw


def validate(ledger: DataFrame, obs: DataFrame, rows: DataFrame, sample: int = 128, seed: int = 0) -> DataFrame:
    """check, ok: ranges of the ledger, identities of rows, and a seeded sample of rows with all range ends."""
    order = Window.orderBy("dataset_index")  # the ledger has one row a dataset
    lag = F.coalesce(F.lag("global_end").over(order), F.lit(0))
    steps = ledger.select("*", lag.alias("before"), (F.row_number().over(order) - 1).alias("place"))
    ranges = steps.agg(
        F.min(((F.col("before") == F.col("global_start")) & (F.col("global_end") - F.col("global_start") == F.col("cell_count"))).cast("int")).alias("contiguous_ranges"),
        F.min((F.col("place") == F.col("dataset_index")).cast("int")).alias("indices_follow_positions"),
        F.min((F.col("cell_count") > 0).cast("int")).alias("no_empty_dataset"),
        (F.count_distinct("dataset_id") == F.count(F.lit(1))).cast("int").alias("unique_dataset_ids"),
    )
    sizes = obs.groupBy("dataset_index").agg(F.count(F.lit(1)).alias("n"))
    counted = ledger.join(sizes, "dataset_index", "full").agg(F.min((F.col("n").eqNullSafe(F.col("cell_count"))).cast("int")).alias("rows_match_ledger"))
    offsets = F.broadcast(ledger.select("dataset_index", "global_start"))
    identity = obs.join(offsets, "dataset_index", "left").agg(F.min((F.col("global_row_index").eqNullSafe(F.col("global_start") + F.col("local_row_index"))).cast("int")).alias("global_is_start_plus_local"))
    orphans = rows.select("global_row_index").join(obs.select("global_row_index"), "global_row_index", "left_anti").agg((F.count(F.lit(1)) == 0).cast("int").alias("no_orphan_rows"))
    picked = obs.select("global_row_index").orderBy(draw(seed, F.col("global_row_index"))).limit(sample)
    ends = ledger.select(F.explode(F.array("global_start", F.col("global_end") - 1)).alias("global_row_index"))
    bridge = picked.union(ends).distinct().join(rows.select("global_row_index"), "global_row_index", "left_anti").agg((F.count(F.lit(1)) == 0).cast("int").alias("sampled_rows_exist"))
    one = reduce(lambda a, b: a.join(F.broadcast(b)), [ranges, counted, identity, orphans, bridge])
    pairs = F.array(*(F.struct(F.lit(c).alias("check"), (F.col(c) == 1).alias("ok")) for c in one.columns))
    return one.select(F.explode(pairs).alias("x")).select("x.check", "x.ok")
