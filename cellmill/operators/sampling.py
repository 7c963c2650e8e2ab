"""Samplers of rows and genes. Draws are md5 keys of seed, epoch and row, so they repeat on any cluster and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordering import dense_position
from . import blocks

PAD, ABSENT = -1, 0


def draw(*parts: Column | int | str) -> Column:
    """A hexadecimal key of the parts; rows in order of it are a uniform draw."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1) from the first 8 digits of the key."""
    return (F.conv(F.substring(draw(*parts), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)


def random_batches(spark: SparkSession, n_rows: int, batch_size: int, n_batches: int | None, seed: int, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """batch_id, pos, global_row_index: every batch an independent draw without replacement of rows 0 .. n_rows - 1, sorted.

    Without n_batches, an epoch: as many batches as the rows fill, the last one
    of the rows that are left over (drop_last: without it).
    Batches of up to a quarter of the rows draw row numbers straight (twice as
    many as needed, each once, the first ones count), in time that does not
    depend on the number of rows; larger ones take the smallest keys of all rows.
    """
    if batch_size <= 0 or n_rows < 0:
        raise ValueError("batch_size must be above 0")
    tail = 0
    if n_batches is None:
        n_batches, tail = divmod(n_rows, batch_size)
        tail = 0 if drop_last else tail
        n_batches += tail > 0
    batches = spark.range(n_batches).select(F.col("id").cast("int").alias("batch_id"))
    if 4 * batch_size <= n_rows:
        tries = batches.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(2 * batch_size + 63))).alias("n"))
        row = F.pmod(F.conv(F.substring(draw(seed, epoch, F.col("batch_id"), F.col("n")), 1, 15), 16, 10).cast("long"), F.lit(n_rows))
        keyed = tries.select("batch_id", "n", row.alias("global_row_index")).groupBy("batch_id", "global_row_index").agg(F.min("n").alias("key"))
    else:
        every = spark.range(n_rows).select(F.col("id").alias("global_row_index"), F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))).alias("batch_id")).where(F.col("batch_id") < n_batches).where("batch_id >= 0")
        keyed = every.withColumn("key", draw(seed, epoch, F.col("batch_id"), F.col("global_row_index")))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("key", "global_row_index"))
    size = F.when(F.col("batch_id") == n_batches - 1, tail).otherwise(batch_size) if tail else F.lit(batch_size)
    kept = keyed.withColumn("place", place).where(F.col("place") <= size)
    return kept.select("batch_id", (F.row_number().over(Window.partitionBy("batch_id").orderBy("global_row_index")) - 1).alias("pos"), "global_row_index")


def places(rows: DataFrame, by: list[str], order: list[Column], name: str, many: str) -> DataFrame:
    """rows with `name`, their place from 0 within their group by `order` (total within a group), and `many`, the group's size.

    Rows are placed in ranges of the whole order, so a hot group is many ranges.
    """
    placed = dense_position(rows, [*(F.col(c) for c in by), *order], "_at")
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias(many))
    match = [placed[c].eqNullSafe(groups[c]) for c in by]
    joined = placed.join(groups, match).drop(*(groups[c] for c in by))
    return joined.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")


def context_batches(rows: DataFrame, context: str, batch_size: int, seed: int, epoch: int = 0, shuffle: bool = True, drop_last: bool = False) -> DataFrame:
    """context, batch_in_context, pos, global_row_index: each context's rows dealt out whole into batches of its own."""
    if batch_size <= 0:
        raise ValueError("batch_size must be above 0")
    key = [draw(seed, epoch, F.col("global_row_index")), F.col("global_row_index")] if shuffle else [F.col("global_row_index")]
    rows = places(rows.select(context, "global_row_index"), [context], key, "n", "many")
    batch = F.floor(F.col("n") / batch_size)
    rows = rows.withColumn("batch_in_context", batch).withColumn("pos", F.col("n") % batch_size)
    if drop_last:
        rows = rows.where((F.col("batch_in_context") + 1) * batch_size <= F.col("many"))
    return rows.select(context, "batch_in_context", "pos", "global_row_index")


def row_lists(rows: DataFrame, by: str, size: int = 65_536) -> DataFrame:
    """by, part, rows: each group's row numbers in order, in arrays of `size` rows at most."""
    placed = places(rows.select(by, "global_row_index"), [by], [F.col("global_row_index")], "n", "many")
    return placed.groupBy(by, F.floor(F.col("n") / size).alias("part")).agg(F.sort_array(F.collect_list("global_row_index")).alias("rows"))


def n_batches(rows: DataFrame, context: str, batch_size: int, drop_last: bool = False) -> DataFrame:
    """context, n_batches."""
    n = F.count(F.lit(1)) / batch_size
    return rows.groupBy(context).agg((F.floor(n) if drop_last else F.ceil(n)).alias("n_batches"))


def check_mode(mode: str, hvg_top_k: int | None = None) -> None:
    if mode not in ("uniform", "expressed", "hvg"):
        raise ValueError(f"unknown mode {mode!r}")
    if hvg_top_k is not None and hvg_top_k <= 0:
        raise ValueError("hvg_top_k must be above 0")


def _chosen(hvg_top_k: int | None) -> Column:
    return F.coalesce(F.col("is_hvg") if hvg_top_k is None else F.col("hvg_rank").between(1, hvg_top_k), F.lit(False))


def dataset_weights(genes: DataFrame, mode: str = "uniform", weight: float = 3.0, hvg_top_k: int | None = None) -> DataFrame:
    """dataset_index, global_feature_id, prob: the weights that all cells of a dataset share (uniform and hvg)."""
    check_mode(mode, hvg_top_k)
    if mode == "expressed":
        raise ValueError("weights of expressed genes are each cell's own")
    w = F.lit(1.0) if mode == "uniform" else 1 + weight * _chosen(hvg_top_k).cast("double")
    rows = genes.select("dataset_index", "global_feature_id", w.alias("w"))
    total = F.sum("w").over(Window.partitionBy("dataset_index"))
    return rows.select("dataset_index", "global_feature_id", (F.col("w") / total).alias("prob"))


def cell_weights(rows: DataFrame, genes: DataFrame, weight: float = 3.0) -> DataFrame:
    """global_row_index, dataset_index, global_feature_id, prob of each cell's expressed genes, and with a null gene that of each other gene.

    rows: global_row_index, dataset_index and the sparse arrays. The weights of
    a cell are as many rows as it expresses genes and one, whatever the
    vocabulary.
    """
    sizes = F.broadcast(genes.groupBy("dataset_index").agg(F.count(F.lit(1)).alias("n")))  # one row a dataset
    own = rows.join(sizes, "dataset_index").select("global_row_index", "dataset_index", "n", expressed().alias("hot"))
    total = F.col("n") + weight * F.size("hot")
    some = own.select("global_row_index", "dataset_index", total.alias("total"), F.explode("hot").alias("origin_index")).join(genes.select("dataset_index", "origin_index", "global_feature_id"), ["dataset_index", "origin_index"])
    rest = own.select("global_row_index", "dataset_index", F.lit(None).cast("long").alias("global_feature_id"), (1 / total).alias("prob"))
    return some.select("global_row_index", "dataset_index", F.col("global_feature_id").cast("long").alias("global_feature_id"), ((1 + weight) / F.col("total")).alias("prob")).unionByName(rest)


def expressed() -> Column:
    """Local genes with a count above 0 of a sparse row."""
    pairs = F.arrays_zip(F.col("expressed_gene_indices").alias("g"), F.col("expression_counts").alias("c"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda x: x["c"] > 0), lambda x: x["g"]))


def _tried(seed: int | str, urn: int, size: Column, out: Column, need: int) -> Column:
    """Distinct draws from the numbers below `size` that the array `out` does not hold, enough as a rule.

    The first half more than needed come first: only where they run short are
    all 2 * need + 64 made, of which they are the beginning. blocks._tried makes them for many cells at once.
    """
    number = lambda i: F.pmod(F.conv(F.substring(draw(seed, F.col("global_row_index"), urn, i), 1, 15), 16, 10).cast("long"), size).cast("int")
    drawn = lambda n: F.array_except(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), number), out)
    few, all_ = need + need // 2 + 4, 2 * need + 64
    short = F.aggregate(F.array(drawn(few)), F.array().cast("array<int>"), lambda _, x: F.when(F.size(x) >= F.least(F.lit(need), size - F.size(out)), x).otherwise(drawn(all_)))  # so that the first draws are made once
    return F.when(size > 0, short).otherwise(F.array().cast("array<int>"))


def sample_arrays(rows: DataFrame, genes: DataFrame, seq_len: int, seed: int | str, mode: str = "expressed", weight: float = 3.0, hvg_top_k: int | None = None) -> DataFrame:
    """rows with `genes`: seq_len genes of each cell without replacement by weight, as exponential keys give them, in one array a cell.

    rows: global_row_index, dataset_index and the sparse arrays; genes:
    dataset_index, origin_index (0 .. n - 1 of each dataset), global_feature_id,
    for hvg hvg_rank and is_hvg, and where some genes must not be drawn able,
    whether one may. All genes of one weight are an urn that
    is drawn from without being listed, so a cell takes time by seq_len and the
    genes it expresses, and nothing is shuffled.
    """
    check_mode(mode, hvg_top_k)
    if seq_len <= 0:
        raise ValueError("seq_len must be above 0")
    urn = _chosen(hvg_top_k).cast("int") if mode == "hvg" else F.lit(0)
    able = F.col("able") if "able" in genes.columns else F.lit(True)
    genes = genes.withColumns({"urn": urn, "able": F.coalesce(able, F.lit(False))})
    return blocks.sampled(rows, genes if mode == "expressed" else genes.where("able"), seq_len, seed, mode, weight)


def sample_rows_genes(rows: DataFrame, genes: DataFrame, seq_len: int, seed: int | str, mode: str = "expressed", weight: float = 3.0, hvg_top_k: int | None = None) -> DataFrame:
    """global_row_index, seq, global_feature_id of sample_arrays, a row a place."""
    return blocks.exploded(sample_arrays(rows, genes, seq_len, seed, mode, weight, hvg_top_k), global_feature_id="genes")


def gene_weights(cells: DataFrame, genes: DataFrame, counts: DataFrame, mode: str = "uniform", weight: float = 3.0, hvg_top_k: int | None = None) -> DataFrame:
    """global_row_index, global_feature_id, prob of every gene of a cell's dataset: the dense table, for the cells of a batch.

    cells: global_row_index, dataset_index;
    genes: dataset_index, global_feature_id, hvg_rank, is_hvg; counts:
    global_row_index, global_feature_id, count. Modes: uniform; expressed
    (1 + weight where expressed); hvg (1 + weight where selected, or ranked 1 to
    hvg_top_k). Genes that a dataset lacks have no row, which is weight 0.
    """
    check_mode(mode, hvg_top_k)
    rows = cells.select("global_row_index", "dataset_index").join(genes, "dataset_index")
    if mode == "uniform":
        w = F.lit(1.0)
    elif mode == "expressed":
        hit = counts.where("count > 0").select("global_row_index", "global_feature_id", F.lit(1.0).alias("_hit")).distinct()
        rows = rows.join(hit, ["global_row_index", "global_feature_id"], "left")
        w = 1 + weight * F.coalesce("_hit", F.lit(0.0))
    else:
        w = 1 + weight * _chosen(hvg_top_k).cast("double")
    rows = rows.withColumn("w", w)
    return rows.select("global_row_index", "dataset_index", "global_feature_id", (F.col("w") / F.sum("w").over(Window.partitionBy("global_row_index"))).alias("prob"))


def sample_genes(weights: DataFrame, seq_len: int, seed: int) -> DataFrame:
    """global_row_index, seq, global_feature_id: seq_len genes of each cell without replacement by weight (Efraimidis-Spirakis keys)."""
    key = F.round(-F.log(uniform(seed, F.col("global_row_index"), F.col("global_feature_id"))) / F.col("prob"), 9)
    place = F.row_number().over(Window.partitionBy("global_row_index").orderBy(key, "global_feature_id"))
    return weights.where("prob > 0").withColumn("seq", place - 1).where(F.col("seq") < seq_len).select("global_row_index", "seq", "global_feature_id")


def check_supplied(sampled: DataFrame, seq_len: int) -> DataFrame:
    """sampled (global_row_index, seq, global_feature_id) where every cell has each of seq_len places once; another shape is an error."""
    shape = sampled.groupBy("global_row_index").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("seq").alias("_d"), F.min("seq").alias("_a"), F.max("seq").alias("_b"))
    good = (F.col("_n") == seq_len) & (F.col("_d") == seq_len) & (F.col("_a") == 0) & (F.col("_b") == seq_len - 1)
    checked = shape.select(F.when(good, F.col("global_row_index")).otherwise(F.raise_error(F.lit(f"gene ids must be {seq_len} a cell")).cast("long")).alias("global_row_index"))
    return sampled.join(checked, "global_row_index")


def process(cells: DataFrame, sampled: DataFrame, counts: DataFrame, genes: DataFrame, seq_len: int) -> DataFrame:
    """global_row_index, seq, global_feature_id, count, valid for each of seq_len places.

    A gene that the cell's dataset lacks, and a place without a gene, is not
    valid (count -1, gene -1 where there is none); a valid gene without a
    count is 0; the first local gene counts where several map to one.
    """
    places = cells.select("global_row_index", "dataset_index", F.explode(F.sequence(F.lit(0), F.lit(seq_len - 1))).alias("seq"))
    rows = places.join(sampled, ["global_row_index", "seq"], "left")
    known = genes.select("dataset_index", "global_feature_id", F.lit(True).alias("valid")).distinct()
    rows = rows.join(known, ["dataset_index", "global_feature_id"], "left")
    first = F.row_number().over(Window.partitionBy("global_row_index", "global_feature_id").orderBy("origin_index"))
    one = counts.withColumn("_n", first).where("_n = 1").select("global_row_index", "global_feature_id", "count")
    rows = rows.join(one, ["global_row_index", "global_feature_id"], "left")
    valid = F.coalesce("valid", F.lit(False))
    return rows.select("global_row_index", "seq", F.coalesce("global_feature_id", F.lit(PAD)).alias("global_feature_id"), F.when(valid, F.coalesce("count", F.lit(ABSENT))).otherwise(PAD).alias("count"), valid.alias("valid"))


def process_arrays(rows: DataFrame, genes: DataFrame, seq_len: int | None, pad: int = PAD) -> DataFrame:
    """global_row_index, dataset_index and the arrays genes, counts and mask of seq_len places: process without a row a place.

    rows: global_row_index, dataset_index, the sparse arrays and genes, the
    array of global ids asked for (null: a place without a gene). Counts come
    from the cell's own arrays, so nothing is shuffled. Without seq_len, as
    many places as are asked for. pad is the count of places that are not valid. More columns of rows stay.
    """
    return blocks.processed(rows, genes, seq_len, pad)


def tokenize(processed: DataFrame, tokens: DataFrame, pad: int = 0, policy: str = "exclude") -> DataFrame:
    """processed with token_id: pad for places that are not valid or (policy pad) have no token; policy exclude drops genes without one."""
    table = tokens.select(F.col("global_id").alias("global_feature_id"), "token_id", "tokenizable")
    rows = processed.join(table, "global_feature_id", "left")
    if policy == "exclude":
        rows = rows.where(~F.col("valid") | F.coalesce("tokenizable", F.lit(False)))
    elif policy != "pad":
        raise ValueError(f"unknown policy {policy!r}")
    return rows.withColumn("token_id", F.when(F.col("valid") & F.coalesce("tokenizable", F.lit(False)), F.col("token_id")).otherwise(pad)).drop("tokenizable")


def tokenize_arrays(processed: DataFrame, tokens: DataFrame, pad: int = 0, policy: str = "exclude") -> DataFrame:
    """global_row_index, seq, global_feature_id, count, valid, token_id of tokenize, from processed arrays."""
    if policy not in ("exclude", "pad"):
        raise ValueError(f"unknown policy {policy!r}")
    rows = blocks.exploded(blocks.tokenized(processed, tokens, pad), global_feature_id="genes", count="counts", valid="mask", token_id="tokens")
    return rows.where(F.col("token_id").isNotNull()) if policy == "exclude" else rows.withColumn("token_id", F.coalesce("token_id", F.lit(pad).cast("long")))


def collate(processed: DataFrame) -> DataFrame:
    """One row a cell: arrays of genes, counts and masks in order of seq."""
    items = F.array_sort(F.collect_list(F.struct("seq", "global_feature_id", "count", "valid")))
    rows = processed.groupBy("global_row_index").agg(items.alias("x"))
    return rows.select("global_row_index", F.col("x.global_feature_id").alias("genes"), F.col("x.count").alias("counts"), F.col("x.valid").alias("mask"))


def stratified(rows: DataFrame, stratum: str, per_stratum: int, seed: int) -> DataFrame:
    """Extension: up to per_stratum rows of each stratum."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, F.col("global_row_index")), "global_row_index"))
    return rows.withColumn("_n", place).where(F.col("_n") <= per_stratum).drop("_n")
