"""From count sources to stored counts: translation, size factors, recovery of integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest distance from an integer that direct counts and recovered counts may have.
DIRECT, RECOVERED = 1e-6, 0.01


def size_factors(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """dataset_index, global_row_index, row_sum, size_factor = row sum / median row sum of the dataset, rounded to float32.

    A median of 0 or less counts as 1; so does a factor of 0 or less. Cells
    without counts take part with a row sum of 0.
    """
    sums = counts.groupBy("global_row_index").agg(F.sum("count").alias("row_sum"))
    rows = cells.select("dataset_index", "global_row_index").join(sums, "global_row_index", "left").withColumn("row_sum", F.coalesce("row_sum", F.lit(0)).cast("long"))
    middle = rows.groupBy("dataset_index").agg(F.median(F.col("row_sum").cast("double")).alias("median"))
    rows = rows.join(F.broadcast(middle), "dataset_index")  # one row a dataset
    factor = F.col("row_sum") / F.when(F.col("median") <= 0, 1.0).otherwise(F.col("median"))
    factor = F.when((factor <= 0) | F.isnan(factor), 1.0).otherwise(factor)
    return rows.select("dataset_index", "global_row_index", "row_sum", factor.cast("float").cast("double").alias("size_factor"))


def is_integer_like(value: Column, tolerance: float = DIRECT) -> Column:
    return F.abs(value - F.rint(value)) <= tolerance


def direct_counts(values: DataFrame) -> DataFrame:
    """row, gene, count of stored values that are integers; another value is an error. values: row, gene, value; zeros are not stored."""
    kept = F.when(is_integer_like(F.col("value")), F.rint("value").cast("int")).otherwise(F.raise_error(F.lit("a count is not an integer")))
    return values.where("value <> 0").select("row", "gene", kept.alias("count"))


def recover_counts(values: DataFrame, strict: bool = True) -> DataFrame:
    """row, gene, count, deviation from log1p values: expm1 by the row's least expm1, rounded.

    A deviation of over 0.01 from an integer is an error, or null if not strict.
    """
    raw = values.where("value <> 0").select("row", "gene", F.expm1("value").alias("x"))
    least = raw.groupBy("row").agg(F.min("x").alias("least"))
    scaled = raw.join(least, "row").withColumn("ratio", F.col("x") / F.col("least"))
    off = F.abs(F.col("ratio") - F.rint("ratio"))
    bad = F.raise_error(F.lit("recovered counts are not integers")) if strict else F.lit(None).cast("int")
    return scaled.select("row", "gene", F.when(off <= RECOVERED, F.rint("ratio").cast("int")).otherwise(bad).alias("count"), off.alias("deviation"))
