"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by exact token length for each source; only that
   histogram (one row for each source and length) is fitted.
2. Targets: sources weigh 5, 2, 1 by rank and share all words; none gets more
   than 3 times its own words, the excess goes to the others by weight.
3. A source takes every document floor(target / words) times. What is left of
   the target is shared over lengths in proportion, then filled by seeded
   single documents, and the last words are fitted by a bounded-knapsack
   dynamic program over lengths (a bit set of reachable sums): at least the
   last FITTED words, and the last four of the longest documents.
4. Of each length, the documents with the smallest seeded hashes of id and
   text are selected: the hash of the last one is found inside one slice of
   the hash range, so that a hot source and length is never sorted in one task.

Defined cases: a null text has size 0; a null source ranks last; documents of
size 0 take 0 words; rows that repeat an id and a text are taken together (of
one id and different texts, each on its own); ties of length are broken by the
hash; a very long text is one document of its length; no documents give no
rows; all columns but those that the result adds are kept, whatever their names.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import dense_position
from .common import checkpointed, free_names, text_hash

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3.0, 20240
#: Documents of one slice of the hash range; words that the dynamic program fits at least.
SLICE, FITTED = 1_000, 1 << 16
#: Sources that one task may number (more are numbered by ranges), and lengths of sources that are broadcast at most.
FEW = 100_000


def with_size(docs: DataFrame, size: str, h: str) -> DataFrame:
    """docs with the columns size (words by ASCII white space) and h (the seeded hash, not negative)."""
    blank = " \t\n\x0b\x0c\r"
    each = F.regexp_replace(F.rtrim(F.col("text"), F.lit(blank)), f"[{blank}]*+[^{blank}]++", "x")  # a letter a word
    words = F.coalesce(F.length(each), F.lit(0)).cast("long")
    return docs.withColumns({size: words, h: F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), text_hash(), F.lit(SEED)), 1)})


def targets(hist: DataFrame) -> DataFrame:
    """source, source_size, target: a water-filling by weight under the caps.

    The level rises until no more sources are capped below it; each round is
    one aggregate over sources, so no task holds all of them.
    """
    sums = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    many = sums.count()
    if many > FEW:
        ranked = dense_position(sums, [F.col("source").isNull(), F.col("source")], "rank")
    else:
        ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    rows = checkpointed(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("cap")), many)
    total, level, last = None, 0.0, -1.0
    while level > last:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        r = rows.agg(F.sum("source_size").alias("total"), F.sum(F.when(capped, F.col("cap"))).alias("capped"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        total, last = r["total"] or 0, level
        level = max(level, (total - (r["capped"] or 0.0)) / r["weight"]) if total and r["weight"] else level
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def knapsack(lengths: list[int], counts: list[int], goal: int) -> dict[int, int]:
    """How many of each length come nearest to goal (of two as near, from below); exact if the goal can be reached."""
    most = goal + max(lengths, default=0)
    mask = (1 << (most + 1)) - 1
    reach, pieces, before = 1, [], []
    for length, count in zip(lengths, counts, strict=True):
        count = min(count, most // length)
        step = 1
        while count and not reach >> goal & 1:
            step = min(step, count)
            count -= step
            pieces.append((length, step))
            before.append(reach)
            reach |= reach << (length * step) & mask
            step *= 2
        if reach >> goal & 1:
            break
    above = reach >> goal
    at = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    if above and (above & -above).bit_length() - 1 < goal - at:
        at = goal + (above & -above).bit_length() - 1
    out: dict[int, int] = {}
    for (length, step), old in zip(reversed(pieces), reversed(before), strict=True):
        if not old >> at & 1:
            out[length] = out.get(length, 0) + step
            at -= length * step
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, seed: str) -> tuple[int, np.ndarray]:
    """Copies that every document gets, and of each length the number of documents that get one more."""
    total = int((sizes * counts).sum())
    if not total:
        return 0, np.zeros(len(sizes), np.int64)
    whole = int(target // total)
    budget = int(round(target - whole * total))
    extra = np.where(sizes > 0, (counts * (budget / total)).astype(np.int64), 0)
    left = budget - int((sizes * extra).sum())
    order = np.array(random.Random(seed).sample(range(len(sizes)), len(sizes)))
    fitted = max(FITTED, 4 * int(sizes.max()))
    while left > fitted:
        free = order[(extra[order] < counts[order]) & (sizes[order] > 0)]
        free = free[np.cumsum(sizes[free]) <= left - fitted // 2]
        if not len(free):
            break
        extra[free] += 1
        left -= int(sizes[free].sum())
    open_ = [i for i in order if sizes[i] > 0 and extra[i] < counts[i]]
    found = knapsack([int(sizes[i]) for i in open_], [int(counts[i] - extra[i]) for i in open_], left) if left > 0 else {}
    return whole, extra + np.array([found.get(int(s), 0) for s in sizes], np.int64)


def plan(sized: DataFrame, rows: int) -> DataFrame:
    """For each source and size: source_size, target, n documents, whole copies of all, extra documents with one copy more."""
    hist = checkpointed(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), rows)
    goal = targets(hist).withColumnRenamed("source", "own")
    rows = hist.join(goal, hist["source"].eqNullSafe(goal["own"])).drop("own")

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("size")
        source = one["source"].iloc[0]
        whole, extra = fit(one["size"].to_numpy(np.int64), one["n"].to_numpy(np.int64), float(one["target"].iloc[0]), f"{SEED}|{source}")
        return one.assign(whole=whole, extra=extra)

    return rows.groupBy("source").applyInPandas(run, "source string, size long, n long, source_size long, target double, whole long, extra long")


def cuts(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """source, size, cut: the hash of the last extra document, for those lengths of which some but not all are extra."""
    some = planned.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select(F.col("source").alias("s2"), F.col("size").alias("z2"), "n", "extra")
    rows = sized.join(some, sized["source"].eqNullSafe(some["s2"]) & (sized["size"] == some["z2"])).select("s2", "z2", "extra", "h", F.floor(F.col("h") / F.lit(2.0**63) * F.ceil(F.col("n") / SLICE)).alias("part"))
    counted = rows.groupBy("s2", "z2", "extra", "part").agg(F.count(F.lit(1)).alias("own"))
    before = F.sum("own").over(Window.partitionBy("s2", "z2").orderBy("part")) - F.col("own")
    last = counted.withColumn("need", F.col("extra") - before).where((F.col("need") > 0) & (F.col("need") <= F.col("own"))).select(F.col("s2").alias("s3"), F.col("z2").alias("z3"), F.col("part").alias("p3"), "need")
    inside = rows.join(last, rows["s2"].eqNullSafe(last["s3"]) & (rows["z2"] == last["z3"]) & (rows["part"] == last["p3"]))
    number = F.row_number().over(Window.partitionBy("s3", "z3", "p3").orderBy("h"))
    return inside.withColumn("number", number).where(F.col("number") == F.col("need")).select("s3", "z3", F.col("h").alias("cut"))


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and copies (0 to 3); all other columns are kept."""
    sized = checkpointed(with_size(docs.select("doc_id", "text", "source"), "size", "h").select("source", "size", "h"))
    rows = sized.count()
    planned = checkpointed(plan(sized, rows).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism))
    most = planned.count()
    last = cuts(sized, planned)
    chosen = planned.join(last, planned["source"].eqNullSafe(last["s3"]) & (planned["size"] == last["z3"]), "left")
    rows = docs.drop("size", "source_size", "target", "copies")
    h, s1, z1, x = free_names([*rows.columns, "size", "source_size", "target", "copies"], "h", "s1", "z1", "x")
    chosen = checkpointed(chosen.select(F.col("source").alias(s1), F.col("size").alias(z1), F.struct("source_size", "target", "whole", "extra", "n", "cut").alias(x)), most)
    rows = with_size(rows, "size", h)
    more = F.when(F.col(f"{x}.extra") >= F.col(f"{x}.n"), 1).when(F.col(h) <= F.col(f"{x}.cut"), 1).otherwise(0)
    chosen = F.broadcast(chosen) if most <= FEW else chosen
    joined = rows.join(chosen, rows["source"].eqNullSafe(chosen[s1]) & (rows["size"] == chosen[z1]))
    return joined.withColumns({"source_size": F.col(f"{x}.source_size"), "target": F.col(f"{x}.target"), "copies": F.col(f"{x}.whole") + more}).drop(s1, z1, x, h)


def mixing(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
