"""Queries of the scalar transforms, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.views import Corpus
from .base import Group

GROUP = Group()


def _on_parts(name: str, make, sql: str, source=lambda: F.col("p_name"), given: str = "p_name"):
    """A query of one transform of a text made of part columns: p_partkey, input, output."""

    @GROUP.query(name, f"WITH s AS (SELECT p_partkey, {given} AS input FROM part) SELECT p_partkey, input, {sql} AS output FROM s")
    def _(c: Corpus):
        rows = c.table("part").select("p_partkey", source().alias("input"))
        return rows.select("p_partkey", "input", make(F.col("input")).alias("output"))


_STR = lambda *parts: lambda: F.concat(*(F.col(p) if p.startswith("p_") else F.lit(p) for p in parts))
_padded = _STR("  ", "p_name", " \t")
_PADDED = "'  ' || p_name || ' ' || chr(9)"
_dose = lambda: F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("nM", " μM", "mg/kg", "", " junk", " UM "))), (F.col("p_partkey") % 6 + 1).cast("int")))
_DOSE = "CAST(p_size AS VARCHAR) || (CASE p_partkey % 6 WHEN 0 THEN 'nM' WHEN 1 THEN ' μM' WHEN 2 THEN 'mg/kg' WHEN 3 THEN '' WHEN 4 THEN ' junk' ELSE ' UM ' END)"
_time = lambda: F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("h", " hr", " days", "", "min", " weeks"))), (F.col("p_partkey") % 6 + 1).cast("int")))
_TIME = "CAST(p_size AS VARCHAR) || (CASE p_partkey % 6 WHEN 0 THEN 'h' WHEN 1 THEN ' hr' WHEN 2 THEN ' days' WHEN 3 THEN '' WHEN 4 THEN 'min' ELSE ' weeks' END)"
_gene = lambda: F.concat(F.when(F.col("p_partkey") % 3 == 0, "sym").otherwise("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"), F.lit("."), F.col("p_size").cast("string"))
_GENE = "(CASE WHEN p_partkey % 3 = 0 THEN 'sym' ELSE 'ENSG' END) || lpad(CAST(p_partkey AS VARCHAR), 11, '0') || '.' || CAST(p_size AS VARCHAR)"
_flag = lambda: F.element_at(F.array(*map(F.lit, (" 0 ", "Yes", "FALSE", "maybe", "t", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
_FLAG = "(CASE p_partkey % 6 WHEN 0 THEN ' 0 ' WHEN 1 THEN 'Yes' WHEN 2 THEN 'FALSE' WHEN 3 THEN 'maybe' WHEN 4 THEN 't' ELSE '' END)"
_null = lambda: F.element_at(F.array(*map(F.lit, ("NA", " n/a", "None", "", ".", "x"))), (F.col("p_partkey") % 6 + 1).cast("int"))
_NULL = "(CASE p_partkey % 6 WHEN 0 THEN 'NA' WHEN 1 THEN ' n/a' WHEN 2 THEN 'None' WHEN 3 THEN '' WHEN 4 THEN '.' ELSE 'x' END)"
_guide = lambda: F.concat("p_name", F.element_at(F.array(*map(F.lit, ("_sg1", "-guide2", "_ -3", "_12", ""))), (F.col("p_partkey") % 5 + 1).cast("int")))
_GUIDE = "p_name || (CASE p_partkey % 5 WHEN 0 THEN '_sg1' WHEN 1 THEN '-guide2' WHEN 2 THEN '_ -3' WHEN 3 THEN '_12' ELSE '' END)"
_S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_MICRO = "translate(input, 'μµ', 'uu')"
_DEC = r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)"
_DU, _TU = "[A-Za-zµμ%]+(?:/[A-Za-zµμ%]+)?", "[A-Za-z]+"


def _quantity(units: str, group: int) -> str:
    return rf"nullif(regexp_extract(trim(input), '^\s*({_DEC})\s*({units})\s*$', {group}), '')"


_UNIT = lambda x: f"CASE lower(translate({x}, 'μµ', 'uu')) WHEN 'nm' THEN 'nm' WHEN 'um' THEN 'um' WHEN 'mg/kg' THEN 'mg/kg' WHEN 'mm' THEN 'mm' WHEN '%' THEN '%' ELSE {x} END"
_TUNIT = lambda x: f"CASE WHEN lower({x}) IN ('h', 'hr', 'hrs', 'hour', 'hours') THEN 'h' WHEN lower({x}) IN ('d', 'day', 'days') THEN 'd' WHEN lower({x}) IN ('m', 'min', 'mins', 'minute', 'minutes') THEN 'm' ELSE {x} END"
_BARE = r"CASE WHEN regexp_matches(trim(input), '^[0-9.]+$') THEN trim(input) END"

_on_parts("fn1_map_control_labels", lambda c: t.map_control_labels(c, ["Small Ring", " blue bolt"]), f"CASE WHEN lower({_S.format('input')}) IN ('small ring', 'blue bolt') THEN 'ctrl' ELSE input END", _padded, _PADDED)
_on_parts("fn2_strip_whitespace", t.strip_whitespace, _S.format("input"), _padded, _PADDED)
_on_parts("fn3_replace_empty_with_null", t.replace_empty_with_null, f"CASE WHEN {_S.format('input')} = '' THEN 'NA' ELSE input END", _null, _NULL)
_on_parts("fn4_strip_prefix", lambda c: t.strip_prefix(c, "Brand#"), "CASE WHEN starts_with(input, 'Brand#') THEN substr(input, 7) ELSE input END", _STR("p_brand"), "p_brand")
_on_parts("fn5_strip_suffix", lambda c: t.strip_suffix(c, "ring"), "CASE WHEN suffix(input, 'ring') THEN left(input, length(input) - 4) ELSE input END")
_on_parts("fn6_strip_guide_suffix", t.strip_guide_suffix, r"""CASE WHEN regexp_matches(input, '(?i)[_\-\s](?:sg|guide|grna)\d+$') THEN regexp_replace(regexp_replace(input, '(?i)[_\-\s](?:sg|guide|grna)\d+$', ''), '[_ -]+$', '')
 WHEN regexp_matches(input, '(?i)[_\-]g\d+$') THEN regexp_replace(regexp_replace(input, '(?i)[_\-]g\d+$', ''), '[_ -]+$', '')
 WHEN regexp_matches(input, '[_-][0-9]+$') THEN regexp_replace(regexp_replace(input, '[_-][0-9]+$', ''), '[_ -]+$', '') ELSE input END""", _guide, _GUIDE)  # fmt: skip
_on_parts("fn7_regex_sub", lambda c: t.regex_sub(c, "([aeiou])([a-z])", r"\2$\1"), r"regexp_replace(input, '([aeiou])([a-z])', '\2$\1', 'g')")
_on_parts("fn8_normalize_case", lambda c: F.concat(t.normalize_case(c, "title"), F.lit("|"), t.normalize_case(c, "upper")), "upper(input[1]) || substr(input, 2, position(' ' IN input) - 1) || upper(input[position(' ' IN input) + 1]) || substr(input, position(' ' IN input) + 2) || '|' || upper(input)")
_on_parts("fn9_recognize_control", lambda c: t.recognize_control(c, ["^small", "BOLT$"]), "regexp_matches(input, '(?i)^small') OR regexp_matches(input, '(?i)BOLT$')")
_on_parts("fn10_join_with_plus", lambda c: t.join_with_plus([c, F.lit(""), F.lit(None), F.upper(c)]), "CASE WHEN input = '' THEN '' ELSE input || '+' || upper(input) END", _null, _NULL)
_on_parts("fn11_coalesce_values", lambda c: t.coalesce_values([c, F.lit(" none "), F.when(F.length(c) > 1, F.lit("second"))]), f"CASE WHEN lower({_S.format('input')}) NOT IN ('', 'na', 'n/a', 'none', 'null', 'nan', '.', '-') THEN input WHEN length(input) > 1 THEN 'second' ELSE 'NA' END", _null, _NULL)
_on_parts("fn12_split_on_delimiter", lambda c: F.concat_ws("|", t.split_on_delimiter(c, " ", 1), t.split_on_delimiter(c, " ", 5), t.split_on_delimiter(c, " ", -1)), "coalesce(nullif(split_part(input, ' ', 2), ''), 'NA') || '|NA|NA'")
_on_parts("fn13_map_values", lambda c: t.map_values(c, {"small ring": "A", "blue bolt": "B"}), "CASE input WHEN 'small ring' THEN 'A' WHEN 'blue bolt' THEN 'B' ELSE input END")
_on_parts("fn14_dose_parse", t.dose_parse, f"coalesce({_quantity(_DU, 1)}, {_BARE}, 'NA')", _dose, _DOSE)
_on_parts("fn15_dose_unit", t.dose_unit, f"coalesce({_UNIT(_quantity(_DU, 2))}, 'NA')", _dose, _DOSE)
_on_parts("fn16_normalize_dose_unit", t.normalize_dose_unit, f"CASE WHEN trim(input) = '' THEN 'NA' WHEN {_quantity(_DU, 2)} IS NULL OR {_UNIT(_quantity(_DU, 2))} = {_quantity(_DU, 2)} AND {_quantity(_DU, 2)} NOT IN ('mg/kg') THEN trim(input) ELSE {_UNIT(_quantity(_DU, 2))} END", _dose, _DOSE)
_on_parts("fn17_timepoint_parse", t.timepoint_parse, f"coalesce({_quantity(_TU, 1)}, {_BARE}, 'NA')", _time, _TIME)
_on_parts("fn18_timepoint_unit", t.timepoint_unit, f"coalesce({_TUNIT(_quantity(_TU, 2))}, 'NA')", _time, _TIME)
_on_parts("fn19_normalize_time_unit", t.normalize_time_unit, f"CASE WHEN trim(input) = '' THEN 'NA' WHEN {_quantity(_TU, 2)} IS NULL OR lower({_quantity(_TU, 2)}) = 'weeks' THEN trim(input) ELSE {_TUNIT(_quantity(_TU, 2))} END", _time, _TIME)
_on_parts("fn20_strip_ensembl_version", t.strip_ensembl_version, r"CASE WHEN starts_with(upper(input), 'ENS') THEN regexp_replace(input, '\.[0-9]+$', '') ELSE input END", _gene, _GENE)
_on_parts("fn21_normalize_boolean", t.normalize_boolean, "CASE WHEN lower(trim(input)) IN ('true', '1', 'yes', 'y', 't') THEN 'true' WHEN lower(trim(input)) IN ('false', '0', 'no', 'n', 'f') THEN 'false' ELSE input END", _flag, _FLAG)
_on_parts("fn22_is_null_like", t.is_null_like, f"lower({_S.format('input')}) IN ('', 'na', 'n/a', 'none', 'null', 'nan', '.', '-')", _null, _NULL)
_on_parts("fn23_read_null", t.read_null, f"CASE WHEN lower({_S.format('input')}) NOT IN ('', 'na', 'none', 'null', 'nan', '.', '-') THEN input END", _null, _NULL)
_on_parts("fn24_fold_micro", t.fold_micro, _MICRO, _dose, _DOSE)
_on_parts("fn25_transform_pipeline", lambda c: t.pipeline(c, [("strip_whitespace", {}), ("no_such_one", {}), ("strip_prefix", {"prefix": "small "}), ("map_values", {"mapping": {"ring": "-"}})], fallback="none given"),
          f"CASE WHEN {_S.format('input')} = 'small ring' THEN 'none given' WHEN starts_with({_S.format('input')}, 'small ') AND {_S.format('input')} <> 'small ring' THEN substr({_S.format('input')}, 7) WHEN {_S.format('input')} = 'ring' THEN 'none given' ELSE {_S.format('input')} END", _padded, _PADDED)
_on_parts("fn28_render_template", lambda c: F.concat_ws("|", *(t.render_template("{a}:{b}", {"a": c, "b": F.lit("k")}, m, "gone") for m in ("fallback", "empty", "literal"))),
          "CASE WHEN lower(trim(input)) IN ('', 'na', 'n/a', 'none', '.') THEN 'gone|:k|{a}:k' ELSE input || ':k|' || input || ':k|' || input || ':k' END", _null, _NULL)
_on_parts("fn32_label_key", t.label_key, "regexp_replace(lower(input), '[^a-z0-9]', '', 'g')", _STR("p_brand", " ", "p_name"), "p_brand || ' ' || p_name")
_on_parts("fn34_value_patterns", lambda c: F.concat_ws("|", *(t.looks_like(c, k).cast("string") for k in ("dose", "ensembl", "ensembl_versioned"))), r"'false|' || CAST(starts_with(input, 'ENSG') AS VARCHAR) || '|' || CAST(regexp_matches(input, '^ENSG[0-9]+\.[0-9]+$') AS VARCHAR)", _gene, _GENE)


@GROUP.query("fn26_unpack_json", "SELECT event_id, props->>'k' AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def _(c: Corpus):
    return c.table("events").select("event_id", *t.unpack_json(F.col("props"), ["k", "absent"]))


@GROUP.query("fn27_pack_json", """SELECT c_custkey, '{"c_name":"' || c_name || '","c_nationkey":' || CAST(c_nationkey AS VARCHAR) || ',"segment":' || (CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END) || '}' AS raw_fields FROM customer""")
def _(c: Corpus):
    rows = c.table("customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return rows.select("c_custkey", t.pack_json(["c_name", "c_nationkey", "segment"]).alias("raw_fields"))


@GROUP.query("fn29_lognorm_value", "SELECT l_orderkey, l_linenumber, round(sum(ln(1 + l_quantity / (1 + l_tax))), 6) AS x FROM lineitem GROUP BY 1, 2")
def _(c: Corpus):
    from ..operators.stats import log_normalised

    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", log_normalised(F.col("l_quantity"), 1 + F.col("l_tax")).alias("x"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum("x"), 6).alias("x"))


@GROUP.query("fn35_typed_coercion", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INT) AS i, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS f FROM orders")
def _(c: Corpus):
    price = F.when(F.col("o_orderstatus") == "O", F.lit(" n/a ")).otherwise(F.col("o_totalprice").cast("string"))
    return c.table("orders").select("o_orderkey", t.to_int(F.left("o_orderpriority", F.lit(1))).alias("i"), t.to_float(price).alias("f"))
