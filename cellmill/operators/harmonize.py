"""Harmonising metadata: declarative column mappings, compiled to one select, and vocabularies."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.ordering import dense_position

# Columns that every canonical table has.
OBS_MUST_HAVE = (
    "assay",
    "batch_id",
    "cell_context",
    "cell_id",
    "cell_line_or_type",
    "condition",
    "dataset_id",
    "dataset_index",
    "disease_state",
    "donor_id",
    "dose",
    "dose_unit",
    "global_row_index",
    "local_row_index",
    "perturb_label",
    "perturb_type",
    "sex",
    "size_factor",
    "species",
    "timepoint",
    "timepoint_unit",
    "tissue",
)
VAR_MUST_HAVE = ("origin_index", "gene_id", "canonical_gene_id", "global_id")
OBS_STRATEGIES = ("source-field", "literal", "passthrough", "row-index", "null", "coalesce", "join", "template", "conditional")
VAR_STRATEGIES = ("source-field", "literal", "passthrough", "gene-mapping", "auto", "null")
TYPED = {"size_factor": "float", "dataset_index": "int", "global_row_index": "int", "local_row_index": "int", "origin_index": "int", "global_id": "int"}


@dataclass
class Case:
    """One case of a conditional: a column, a test (equals, in, not_null) and a value or a column to take."""

    column: str
    test: str = "equals"
    values: tuple[str, ...] = ()
    value: str | None = None
    take: str | None = None
    case_sensitive: bool = True
    strip_whitespace: bool = False

    def check(self) -> None:
        if self.test not in ("equals", "in", "not_null"):
            raise ValueError(f"unknown test {self.test!r}")
        if self.test != "not_null" and not self.values:
            raise ValueError(f"{self.column}: {self.test} lacks its values")
        if (self.value is None) == (self.take is None):
            raise ValueError(f"{self.column}: a case gives a value or a column")


@dataclass
class Mapping:
    """How one canonical column is made."""

    name: str
    strategy: str = "source-field"
    source: str | None = None
    sources: tuple[str, ...] = ()
    literal: str | None = None
    fallback: str = t.NA
    transforms: list[tuple[str, dict]] = field(default_factory=list)
    separator: str = "+"
    skip_nulls: bool = True
    template: str | None = None
    missing: str = "fallback"
    missing_value: str | None = None
    cases: tuple[Case, ...] = ()
    default: str | None = None
    default_column: str | None = None

    def check(self, strategies: tuple[str, ...] = OBS_STRATEGIES) -> None:
        """Raises if the strategy is unknown or lacks what it needs."""
        if self.strategy not in strategies:
            raise ValueError(f"{self.name}: unknown strategy {self.strategy!r}")
        needs = {"source-field": self.source, "coalesce": self.sources, "join": self.sources, "template": self.template, "conditional": self.cases or self.default is not None or self.default_column}
        if strategies is VAR_STRATEGIES:
            needs = {}  # a gene's column of the same name serves
        if self.strategy in needs and not needs[self.strategy]:
            raise ValueError(f"{self.name}: {self.strategy} lacks its source")
        if self.missing not in ("fallback", "empty", "literal"):
            raise ValueError(f"{self.name}: unknown filling {self.missing!r}")
        if self.default is not None and self.default_column:
            raise ValueError(f"{self.name}: two defaults")
        for case in self.cases:
            case.check()


def missing_required(names: list[str], required: tuple[str, ...] = OBS_MUST_HAVE) -> list[str]:
    return [c for c in required if c not in names]


def check_schema(mappings: list[Mapping], strategies: tuple[str, ...] = OBS_STRATEGIES, required: tuple[str, ...] = OBS_MUST_HAVE) -> None:
    names = [m.name for m in mappings]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated columns: {sorted({n for n in names if names.count(n) > 1})}")
    for m in mappings:
        m.check(strategies)
    if lacking := missing_required(names, required):
        raise ValueError(f"missing required columns: {lacking}")


def _source(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise KeyError(f"no column {name!r}")
    return F.coalesce(F.col(name).cast("string"), F.lit(t.NA))


def _finish(c: Column, m: Mapping) -> Column:
    out = t.pipeline(c, m.transforms, m.fallback, warnings.warn)
    if m.name in TYPED:
        return t.to_float(out) if TYPED[m.name] == "float" else t.to_int(out)
    return out


def predicate(df: DataFrame, case: Case) -> Column:
    """Whether a case holds: a column that equals a value, is in a list, or is not null-like."""
    own = _source(df, case.column)
    if case.test == "not_null":
        return ~t.is_null_like(own)
    strip = lambda c: t.strip_whitespace(c) if case.strip_whitespace else c
    low = lambda c: c if case.case_sensitive else F.lower(c)
    values = [v.strip() if case.strip_whitespace else v for v in case.values]
    values = values if case.case_sensitive else [v.lower() for v in values]
    if case.test in ("equals", "in"):
        return low(strip(own)).isin(*values)
    raise ValueError(f"unknown test {case.test!r}")


_ROW = "_row_index"


def obs_column(df: DataFrame, m: Mapping) -> Column:
    """The Column of one mapping over raw columns of df."""
    m.check()
    if m.strategy == "literal":
        return F.lit(m.literal if m.literal is not None else m.fallback)
    if m.strategy == "null":
        return _finish(F.lit(m.fallback), m) if m.name in TYPED else F.lit(m.fallback)
    if m.strategy == "row-index":
        return F.col(_ROW).cast("int")  # numbered by canonical_obs
    if m.strategy == "passthrough":
        for name in (m.name, m.source):
            if name in df.columns:
                return F.coalesce(F.col(name).cast("string"), F.lit(m.fallback))
        warnings.warn(f"{m.name}: no column to pass through")
        return F.lit(m.fallback)
    if m.strategy == "source-field":
        if m.source not in df.columns:
            warnings.warn(f"{m.name}: no column {m.source!r}")
            return F.lit(m.fallback)
        return _finish(_source(df, m.source), m)
    if m.strategy == "coalesce":
        return _finish(t.coalesce_values([_source(df, s) for s in m.sources]), m)
    if m.strategy == "join":
        parts = [_source(df, s) for s in m.sources]
        if m.skip_nulls:
            joined = F.array_join(F.filter(F.array(*(F.when(~t.is_null_like(p), p) for p in parts)), lambda x: x.isNotNull()), m.separator)
        else:
            joined = F.array_join(F.array(*(F.when(t.is_null_like(p), F.lit(m.fallback)).otherwise(p) for p in parts)), m.separator)
        return _finish(joined, m)
    if m.strategy == "template":
        return _finish(t.render_template(m.template, {c: _source(df, c) for c in df.columns}, m.missing, m.fallback, m.missing_value), m)
    other = _source(df, m.default_column) if m.default_column else F.lit(m.default if m.default is not None else m.fallback)
    take = lambda c: _source(df, c.take) if c.take else F.lit(c.value)
    return _finish(reduce(lambda out, c: F.when(predicate(df, c), take(c)).otherwise(out), reversed(m.cases), other), m)


def canonical_obs(df: DataFrame, mappings: list[Mapping], order: list[str], extensible: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """The canonical table of raw rows: mapped columns, then extensible ones as text (missing: NA, with a warning). order, which must be total, numbers rows (row-index)."""
    if strict:
        check_schema(mappings)
    more = []
    for c in extensible:
        if c not in df.columns:
            warnings.warn(f"no column {c!r}")
        more.append((F.coalesce(F.col(c).cast("string"), F.lit(t.NA)) if c in df.columns else F.lit(t.NA)).alias(c))
    if any(m.strategy == "row-index" for m in mappings):  # by ranges of the order, never in one task
        df = dense_position(df, [F.col(c) for c in order], _ROW)
    return df.select(*(obs_column(df, m).alias(m.name) for m in mappings), *more)


def with_size_factor(raw: DataFrame, factors: DataFrame) -> DataFrame:
    """raw with size_factor by cell_id: 1.0 where there is none; of repeated ids the last (by its order) counts. factors: cell_id, size_factor, order."""
    last = factors.groupBy("cell_id").agg(F.max_by("size_factor", "order").alias("size_factor"))
    return raw.join(last, "cell_id", "left").withColumn("size_factor", F.coalesce("size_factor", F.lit(1.0)))


def map_genes(var: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """var with canonical_gene_id by a table (gene_id, canonical, line; the last line of a gene counts), itself where unmapped."""
    if table is None:
        return var.withColumn("canonical_gene_id", F.col("gene_id"))
    last = table.groupBy("gene_id").agg(F.max_by("canonical", "line").alias("_to"))
    return var.join(last, "gene_id", "left").withColumn("canonical_gene_id", F.coalesce("_to", "gene_id")).drop("_to")


def canonical_var(var: DataFrame, mappings: list[Mapping], table: DataFrame | None = None, extensible: tuple[str, ...] = (), by: str = "dataset_index", strict: bool = True) -> DataFrame:
    """by and the canonical columns of raw genes, then extensible ones.

    gene_id is the text of its source; canonical_gene_id is mapped by the
    table (itself without one); global_id is the place of the canonical id in
    order, within a dataset. Other columns go by their strategy: source-field
    (transformed), literal, passthrough (the column of the same name), null;
    any other is the fallback, with a warning.
    """
    check_schema(mappings, VAR_STRATEGIES, VAR_MUST_HAVE if strict else ())
    by_name = {m.name: m for m in mappings}
    own = by_name.get("gene_id")
    source = (own.source or "gene_id") if own else None
    gene = _source(var, source) if source in var.columns else F.lit(t.NA)
    rows = map_genes(var.withColumn("_gene", gene).withColumnsRenamed({c: f"_raw_{c}" for c in ("gene_id", "canonical_gene_id") if c in var.columns}).withColumnRenamed("_gene", "gene_id"), table)
    raw = {c: F.col(f"_raw_{c}") if c in ("gene_id", "canonical_gene_id") else F.col(c) for c in var.columns}
    rows = rows.withColumn("_place", F.dense_rank().over(Window.partitionBy(by).orderBy("canonical_gene_id")) - 1)

    def column(m: Mapping) -> Column:
        if m.name in ("gene_id", "canonical_gene_id"):
            return F.col(m.name)
        if m.name == "global_id":
            return F.col("_place")
        if m.strategy == "source-field":
            name = m.source or m.name
            return _finish(F.coalesce(raw[name].cast("string"), F.lit(t.NA)) if name in raw else F.lit(m.fallback), m)
        if m.strategy == "passthrough":
            c = F.coalesce(raw[m.name].cast("string"), F.lit(m.fallback)) if m.name in raw else F.lit(m.fallback)
            return t.to_int(c) if TYPED.get(m.name) == "int" else c
        if m.strategy == "literal":
            return F.lit(m.literal or m.fallback)
        if m.strategy != "null":
            warnings.warn(f"{m.name}: strategy {m.strategy!r} makes no such column")
        return F.lit(m.fallback)

    more = []
    for c in extensible:
        if c not in raw:
            warnings.warn(f"no column {c!r}")
        more.append((F.coalesce(raw[c].cast("string"), F.lit(t.NA)) if c in raw else F.lit(t.NA)).alias(c))
    return rows.select(by, *(column(m).alias(m.name) for m in mappings), *more)


VAR_DEFAULTS = (Mapping("origin_index", "passthrough"), Mapping("gene_id", source="gene_id"), Mapping("canonical_gene_id", "gene-mapping"), Mapping("global_id", "auto"))


def vocabulary_rows(obs: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """by..., column, value, place: distinct values of text columns without empty ones and NA, numbered in order. One row a value."""
    by = by or []
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))
    rows = obs.select(*by, F.explode(pairs).alias("x")).select(*by, "x.column", "x.value").where(F.col("value").isNotNull() & ~F.col("value").isin("", t.NA)).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by, "column").orderBy("value")))


def merged_vocabulary(per_dataset: DataFrame) -> DataFrame:
    """column, value, n_datasets over all datasets."""
    return per_dataset.groupBy("column", "value").agg(F.count_distinct("dataset_index").alias("n_datasets"))
