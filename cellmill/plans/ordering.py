"""Positions in a total order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpointed


def dense_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`: the row's position (from 0) in the order, which must be total.

    Rows are range-partitioned, sorted and numbered within their partition, and
    offset by the sizes of the partitions before (a literal of one number a
    partition, so that what reads the result has no exchange of ours in its
    plan). The numbered rows are checkpointed: ranges come from a sample, and
    all uses must see the same.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    ranged = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = checkpointed(ranged.withColumn("_id", F.monotonically_increasing_id()).drop(*keys))  # partition and place in it
    part = F.shiftright("_id", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before = [0]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    at = F.get(F.lit(before).cast("array<bigint>"), part) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, at).drop("_id")
