"""Small relational pieces: derived indices, column order, row reports, filters, moment merging, ordered uniques."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import dense_position

STRUCTURAL = ("global_row_index", "dataset_index", "dataset_id", "local_row_index")
CONTENT = ("cell_id", "size_factor")


def derive_indices(obs: DataFrame, ledger: DataFrame, stored_order: str) -> DataFrame:
    """obs with local and global row numbers from the stored order and the ledger, whatever was stored."""
    own = F.broadcast(ledger.select("dataset_id", "dataset_index", F.col("global_start").alias("_start")))  # one row a dataset
    rows = obs.drop("dataset_index", "global_row_index", "local_row_index").join(own, "dataset_id")
    placed = dense_position(rows, [F.col("_start"), F.col(stored_order)], "global_row_index")
    return placed.withColumn("local_row_index", F.col("global_row_index") - F.col("_start")).drop("_start")


def ordered(obs: DataFrame) -> DataFrame:
    """Structural columns, then content, then the others by name."""
    first = [c for c in (*STRUCTURAL, *CONTENT) if c in obs.columns]
    return obs.select(*first, *sorted(c for c in obs.columns if c not in first))


def row_report(asked: DataFrame, start: int, end: int) -> DataFrame:
    """n, n_distinct, n_outside of requested rows: what must be equal, and 0, for a valid request."""
    g = F.col("global_row_index")
    return asked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(g).alias("n_distinct"), F.count(F.when((g < start) | (g >= end), 1)).alias("n_outside"))


_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<op><=|>=|!=|<>|==|=|<|>)|(?P<mark>[(),])|(?P<name>[A-Za-z_]\w*))""")
_WORDS = {"and", "or", "not", "in", "is", "null"}


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """df where a small condition holds: comparisons, is [not] null, [not] in (...), and / or / not, parentheses.

    Only column names, literals and these words pass; anything else is an error.
    """
    parts, at = [], 0
    condition = condition.rstrip()
    while at < len(condition):
        m = _TOKEN.match(condition, at)
        if not m:
            raise ValueError(f"cannot read {condition[at:]!r}")
        at = m.end()
        if m["name"] and m["name"].lower() not in _WORDS:
            if m["name"] not in df.columns:
                raise KeyError(m["name"])
            parts.append(f"`{m['name']}`")
        else:
            parts.append(m[0].strip())
    return df.where(F.expr(" ".join(parts)))


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, m2 of groups from those of their parts."""
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    square = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    return parts.groupBy(*by).agg(total.alias("n"), mean.alias("mean"), (square - total * mean * mean).alias("m2"))


def ordered_unique(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Each key once with its position in order of first appearance."""
    first = rows.groupBy(key).agg(F.min(at).alias("_at"))
    return dense_position(first, [F.col("_at"), F.col(key)], "pos").select(key, "pos")


def flag_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `known`, whether their keys are in the other table."""
    yes, no = rows.join(known, keys, "left_semi"), rows.join(known, keys, "left_anti")
    return yes.withColumn("known", F.lit(True)).unionByName(no.withColumn("known", F.lit(False)))


def batch_ids(rows: DataFrame, order: str, size: int) -> DataFrame:
    return dense_position(rows, [F.col(order)], "_n").withColumn("batch_id", F.floor(F.col("_n") / size)).drop("_n")
