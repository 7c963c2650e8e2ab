"""Inspection of a dataset: column profiles, control labels, audits and choice of count sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_key

SAMPLE_ROWS, PROFILE_VALUES, SCAN_VALUES, EXAMPLES, LABELS = 32, 64, 256, 5, 12
# Columns that may name controls, in this order, and labels that do.
CONTROL_COLUMNS = (
    "perturbation",
    "perturb_label",
    "guide_id",
    "sgRNA",
    "target_gene",
    "condition",
    "treatment",
    "genotype",
    "control",
    "is_control",
)
STRONG_LABELS = ("ctrl", "control", "ntc", "nontargeting", "nonperturbing", "nonperturbed", "scramble", "scrambled")
AMBIGUOUS_LABELS = ("wt", "wildtype", "untreated", "vehicle", "mock", "baseline")
TRUE_LABELS = ("1", "t", "true", "y", "yes")


def _long(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """order, column, value (text) of chosen columns, stacked."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.col(order).alias("_at"), F.explode(pairs).alias("x")).select("_at", "x.column", "x.value")


def _once(df: DataFrame, order: str, columns: list[str], scan: int) -> DataFrame:
    """column, value, n: the distinct values among the first `scan` non-null ones of each column, and the place of their first."""
    rows = _long(df, order, columns).where(F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("column").orderBy("_at"))
    return rows.withColumn("n", place).where(F.col("n") <= scan).groupBy("column", "value").agg(F.min("n").alias("n"))


def first_values(df: DataFrame, order: str, columns: list[str], scan: int, keep: int) -> DataFrame:
    """column, values: the first `keep` distinct values among the first `scan` non-null ones of each column."""
    kept = _once(df, order, columns, scan).withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("n"))).where(F.col("k") <= keep)
    return kept.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))


def profile(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """column, dtype, null_count, sampled_distinct (of the first 64 values), examples (first 5 distinct of 256)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    nulls = _long(df, order, columns).groupBy("column").agg(F.count(F.when(F.col("value").isNull(), 1)).alias("null_count"))
    seen = _once(df, order, columns, SCAN_VALUES).groupBy("column").agg(F.count(F.when(F.col("n") <= PROFILE_VALUES, 1)).alias("sampled_distinct"), F.array_sort(F.collect_list(F.struct("n", "value"))).alias("x"))
    some = seen.select("column", "sampled_distinct", F.transform(F.slice("x", 1, EXAMPLES), lambda x: x["value"]).alias("examples"))  # 256 values a column at most
    dtype = F.create_map(*(F.lit(x) for c in columns for x in (c, kinds[c])))
    rows = nulls.join(some, "column", "left")
    return rows.select("column", F.element_at(dtype, F.col("column")).alias("dtype"), "null_count", F.coalesce("sampled_distinct", F.lit(0)).alias("sampled_distinct"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def control_candidates(df: DataFrame, order: str) -> DataFrame:
    """column, candidate_values, confidence: columns that may name controls, the strongest reading of each."""
    have = {c.lower(): c for c in df.columns}
    columns = [have[c.lower()] for c in CONTROL_COLUMNS if c.lower() in have]
    seen = first_values(df, order, columns, SCAN_VALUES, LABELS) if columns else df.sparkSession.createDataFrame([], "column string, values array<string>")
    hit = lambda known: F.filter("values", lambda v: label_key(v).isin(*known))
    flag = F.lower("column").isin("control", "is_control") & (F.size(hit(TRUE_LABELS)) > 0)
    values = F.when(flag, hit(TRUE_LABELS)).when(F.size(hit(STRONG_LABELS)) > 0, hit(STRONG_LABELS)).otherwise(hit(AMBIGUOUS_LABELS))
    sure = F.when(flag | (F.size(hit(STRONG_LABELS)) > 0), "high").otherwise("low")
    return seen.select("column", values.alias("candidate_values"), F.lit("ctrl").alias("suggested_output"), sure.alias("confidence")).where(F.size("candidate_values") > 0)


def sample_rows(n: Column, k: int = SAMPLE_ROWS) -> Column:
    """Evenly spaced row numbers of n rows (array): all if k or fewer."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long")))
    return F.array_distinct(F.when(n <= k, every).otherwise(spread))


def transform_family(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("log|norm|scale"), "transformed").when(low.contains("bin"), "binned").when(low.contains("count"), "count-like").when(name == ".raw.X", "raw").otherwise("identity")


def source_priority(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("count") & ~low.rlike("norm|log|bin"), 500).when(name == ".raw.X", 450).when(name == ".X", 400).when(low.rlike("norm|log|scale"), 100).when(low.contains("bin"), 80).otherwise(250)


def audit(values: DataFrame, shapes: DataFrame, k: int = SAMPLE_ROWS) -> DataFrame:
    """One row a count source: sampled values, density, distance from integers, status and recovery policy.

    values: source, row, gene, value (zeros not stored); shapes: source, place, n_rows, n_genes.
    """
    sampled = shapes.select("source", F.explode(sample_rows(F.col("n_rows"), k)).alias("row"))
    rows = values.where("value <> 0").join(F.broadcast(sampled), ["source", "row"])  # at most k rows a source
    off = F.abs(F.col("value") - F.rint("value"))
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max(off).alias("most"), F.avg((off > 1e-8).cast("double")).alias("share"), F.min((F.col("value") >= 0).cast("int")).alias("positive"))
    shape = shapes.withColumn("sampled_rows", F.size(sample_rows(F.col("n_rows"), k)).cast("long"))
    r = shape.join(sums, "source", "left").fillna({"n": 0, "most": 0.0, "share": 0.0, "positive": 1})
    family = transform_family(F.col("source"))
    exact = (F.col("positive") == 1) & (F.col("share") == 0)
    near = (F.col("positive") == 1) & (F.col("most") <= 1e-6) & (family == "identity")
    status = F.when(F.col("n") == 0, "needs-review").when(exact, "pass").when(near, "needs-review").otherwise("fail")
    policy = F.when(F.col("n") == 0, "disallowed").when(exact, "not-needed").when(near, "allowed-with-explicit-assumption").otherwise("disallowed")
    return r.select("source", "place", "n_rows", "n_genes", "sampled_rows", F.col("n").alias("sampled_nonzero"), (F.col("n") / F.greatest(F.col("sampled_rows") * F.col("n_genes"), F.lit(1))).alias("density"), F.col("share").alias("fraction_noninteger"), F.col("most").alias("max_deviation"), (F.col("positive") == 1).alias("nonnegative"), family.alias("transform"), status.alias("status"), policy.alias("recovery_policy"))


def rank_sources(audited: DataFrame) -> DataFrame:
    """audited with score (priority and status) and rank; ties keep the order of sources."""
    bonus = F.when(F.col("status") == "pass", 50).when(F.col("status") == "needs-review", 10).otherwise(-200)
    score = source_priority(F.col("source")) + bonus
    return audited.withColumn("score", score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "place")))


def try_recovery(values: DataFrame, audited: DataFrame, k: int = SAMPLE_ROWS) -> DataFrame:
    """source, recovered_deviation, recovered_fraction, recovered: expm1 by the row's least expm1 on the sampled rows of sources that did not pass."""
    sampled = audited.where("status <> 'pass'").select("source", F.explode(sample_rows(F.col("n_rows"), k)).alias("row"))
    rows = values.where("value <> 0").join(F.broadcast(sampled), ["source", "row"]).withColumn("x", F.expm1("value"))
    least = F.min("x").over(Window.partitionBy("source", "row"))
    rows = rows.withColumn("least", least).where("least > 0").withColumn("ratio", F.col("x") / F.col("least"))
    off = F.abs(F.col("ratio") - F.rint("ratio"))
    sums = rows.groupBy("source").agg(F.max(off).alias("recovered_deviation"), F.avg((off > 1e-8).cast("double")).alias("recovered_fraction"))
    return sums.withColumn("recovered", F.col("recovered_deviation") <= 0.01)


def choose_source(audited: DataFrame, recovered: DataFrame) -> DataFrame:
    """The chosen source (one row): most genes, direct before recovered, source order; none if nothing passes."""
    rows = audited.join(recovered, "source", "left")
    mode = F.when(F.col("status") == "pass", "direct").when(F.col("recovered"), "recovered")
    status = F.when(mode == "direct", "pass").when(F.col("recovered_fraction") > 0, "needs-review").otherwise("pass")
    ranked = rows.withColumn("pass_mode", mode).withColumn("decided", status).where(F.col("pass_mode").isNotNull())
    order = Window.orderBy(F.desc("n_genes"), (F.col("pass_mode") == "recovered").cast("int"), "place")
    best = ranked.withColumn("n", F.row_number().over(order)).where("n = 1").select("source", F.col("decided").alias("status"), "pass_mode", (F.col("pass_mode") == "recovered").alias("uses_recovery"))
    none = audited.sparkSession.range(1).select(F.lit("none").alias("source"), F.lit("fail").alias("status"), F.lit(None).cast("string").alias("pass_mode"), F.lit(False).alias("uses_recovery"))
    return none.join(best.select(F.lit(1).alias("_one")), F.lit(True), "left_anti").unionByName(best)


def readiness(decision: DataFrame, controls: DataFrame) -> DataFrame:
    """Whether a dataset can be materialised (readiness) and how many control columns it offers."""
    n = controls.agg(F.count(F.lit(1)).alias("control_columns"))
    ready = F.when(F.col("status") == "pass", "pass").when(F.col("status") == "needs-review", "needs-review").otherwise("fail")
    return decision.join(F.broadcast(n)).select("source", "status", "uses_recovery", ready.alias("materialization_readiness"), "control_columns")
