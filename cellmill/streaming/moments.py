"""Statistics of rows that keep arriving: bounded batches, and mergeable moments by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset_batches(cells: DataFrame, batch_size: int = 1024) -> DataFrame:
    """cells with batch_id: rows of one dataset in order, the last batch as it is."""
    if batch_size <= 0:
        raise ValueError("batch_size must be above 0")
    return cells.withColumn("batch_id", F.floor(F.col("local_row_index") / batch_size))


def moments(values: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, s, q of x by group: sums that merge, so a stream keeps them as state."""
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))


def finish(sums: DataFrame) -> DataFrame:
    mean = F.col("s") / F.col("n")
    return sums.withColumns({"mean": mean, "variance": F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))}).drop("s", "q")


def stream_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream, each file as it appears."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet" if not _is_folder(spark, f"{sf_dir}/{table}.parquet") else "*.parquet").parquet(sf_dir if not _is_folder(spark, f"{sf_dir}/{table}.parquet") else f"{sf_dir}/{table}.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """All rows of a finite stream's result, through a table in memory; for aggregates of few groups."""
    name = f"t{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def streamed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of event values by type, kept as streaming state in complete mode."""
    return finish(run_to_end(moments(stream_table(spark, sf_dir, "events"), ["event_type"], "value"), "complete"))


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events and value sums by day and type, with a watermark for late rows."""
    events = stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = events.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    rows = run_to_end(days, "complete")
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))
