"""Reading rows by position: sparse rows, ordered gathers, routing to datasets, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_sparse_rows(cells: DataFrame, coo: DataFrame) -> DataFrame:
    """global_row_index with parallel arrays of local genes and counts, sorted by gene; cells without counts have empty arrays."""
    packed = coo.groupBy("global_row_index").agg(F.array_sort(F.collect_list(F.struct("origin_index", "count"))).alias("x"))
    rows = cells.select("global_row_index").join(packed, "global_row_index", "left")
    none = F.array().cast("array<int>")
    return rows.select("global_row_index", F.coalesce(F.col("x.origin_index"), none).alias("expressed_gene_indices"), F.coalesce(F.col("x.count"), none).alias("expression_counts"))


def to_coo(rows: DataFrame) -> DataFrame:
    """global_row_index, position, gene, count from sparse rows."""
    pair = F.posexplode(F.arrays_zip(F.col("expressed_gene_indices").alias("g"), F.col("expression_counts").alias("n")))
    return rows.select("global_row_index", pair.alias("position", "x")).select("global_row_index", "position", F.col("x.g").alias("gene"), F.col("x.n").alias("count"))


def row_offsets(rows: DataFrame, by: str = "dataset_index") -> DataFrame:
    """global_row_index, first and end offset of each row in the flat arrays of its dataset."""
    end = F.sum(F.size("expressed_gene_indices").cast("long")).over(Window.partitionBy(by).orderBy("global_row_index").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(by, "global_row_index", (end - F.size("expressed_gene_indices")).alias("first"), end.alias("end"))


def gather(requests: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """rows in the order of requests (pos, global_row_index); duplicates are allowed, sort by pos to read them."""
    return requests.join(rows, "global_row_index", how)


def subset(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows whose global_row_index is asked for."""
    return rows.join(asked.select("global_row_index"), "global_row_index", "left_semi")


def corpus_totals(ledger: DataFrame) -> DataFrame:
    """n_datasets, n_cells."""
    return ledger.agg(F.count(F.lit(1)).alias("n_datasets"), F.coalesce(F.sum("cell_count"), F.lit(0)).alias("n_cells"))


def route(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """requests with the dataset that owns each row and the row's local number; a row outside all ranges is an error.

    The ledger has one row a dataset and is joined by range as a broadcast.
    """
    own = F.broadcast(ledger.select("dataset_index", "global_start", "global_end"))
    hit = requests.join(own, (F.col("global_row_index") >= F.col("global_start")) & (F.col("global_row_index") < F.col("global_end")), "left")
    index = F.when(F.col("dataset_index").isNull(), F.raise_error(F.concat(F.lit("row out of range: "), F.col("global_row_index").cast("string")))).otherwise(F.col("dataset_index"))
    return hit.withColumn("dataset_index", index).withColumn("local_row_index", F.col("global_row_index") - F.col("global_start")).drop("global_start", "global_end")


def attach_metadata(batch: DataFrame, obs: DataFrame, columns: list[str]) -> DataFrame:
    """batch with dataset_index and the columns of obs; unknown and reserved names are errors."""
    missing = [c for c in columns if c not in obs.columns]
    if missing:
        raise KeyError(f"unknown metadata columns: {missing}")
    taken = [c for c in columns if c in batch.columns and c != "global_row_index"]
    if taken:
        raise ValueError(f"reserved columns: {taken}")
    wanted = list(dict.fromkeys(["global_row_index", "dataset_index", *columns]))
    return batch.join(obs.select(*wanted), "global_row_index", "left")


def take_columns(obs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chosen columns, each once, in the order asked; all by default."""
    if columns is None:
        return obs
    unknown = [c for c in columns if c not in obs.columns]
    if unknown:
        raise KeyError(f"unknown columns: {unknown}")
    return obs.select(*dict.fromkeys(columns))


def check_rows(rows: list[int] | None, start: int, end: int) -> list[int]:
    """Row numbers if they are integers, distinct and in [start, end); None is all of them."""
    if rows is None:
        return list(range(start, end))
    if any(isinstance(r, bool) or not isinstance(r, int) for r in rows):
        raise TypeError("row indices must be integers")
    if len(set(rows)) != len(rows):
        raise ValueError("row indices must be unique")
    if any(not start <= r < end for r in rows):
        raise IndexError(f"row indices must be in [{start}, {end})")
    return rows


def checked_requests(requests: DataFrame, n_rows: int) -> DataFrame:
    """requests whose global_row_index is in [0, n_rows); a null or another one is an error when it is read."""
    g = F.col("global_row_index")
    outside = F.raise_error(F.concat(F.lit(f"row is not in [0, {n_rows}): "), F.coalesce(g.cast("string"), F.lit("null")))).cast("long")
    return requests.withColumn("global_row_index", F.when((g >= 0) & (g < n_rows), g.cast("long")).otherwise(outside))


def to_global(coo: DataFrame, gene_map: DataFrame) -> DataFrame:
    """coo by global gene; counts of genes that a dataset lists twice are kept apart (by local order)."""
    return coo.join(gene_map.select("dataset_index", "origin_index", "global_feature_id"), ["dataset_index", "origin_index"])


def match_genes(sampled: DataFrame, counts: DataFrame) -> DataFrame:
    """sampled (row, seq, global gene) with the count of the first matching local gene, 0 without one."""
    first = F.row_number().over(Window.partitionBy("global_row_index", "global_feature_id").orderBy("origin_index"))
    one = counts.withColumn("_n", first).where("_n = 1").select("global_row_index", "global_feature_id", "count")
    return sampled.join(one, ["global_row_index", "global_feature_id"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def lookup(column: Column, valid: Column, otherwise: int) -> Column:
    return F.when(valid, column).otherwise(F.lit(otherwise))
