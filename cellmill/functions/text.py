"""Scalar transforms of metadata text, as Column builders. A null input counts as the empty string."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "NA"
# Texts that mean nothing when metadata is written, and when it is read.
NULL_LIKE = ("", "na", "n/a", "none", "null", "nan", ".", "-")
NULL_LITERALS = ("", "na", "none", "null", "nan", ".", "-")
# Dose units by alias.
DOSE_UNITS = {
    "%": "%",
    "nm": "nm",
    "nanomolar": "nm",
    "nanomol": "nm",
    "um": "um",
    "micromolar": "um",
    "mm": "mm",
    "millimolar": "mm",
    "mg/kg": "mg/kg",
    "ug/kg": "ug/kg",
}
# Time units by alias.
TIME_UNITS = {
    "d": "d",
    "day": "d",
    "days": "d",
    "h": "h",
    "hour": "h",
    "hours": "h",
    "hr": "h",
    "hrs": "h",
    "m": "m",
    "min": "m",
    "mins": "m",
    "minute": "m",
    "minutes": "m",
}
# Guide suffixes; the first that matches goes.
GUIDE_SUFFIXES = (
    r"(?i)(?:[_\-\s](?:sg|guide|grna)\d+)$",
    r"(?i)(?:[_\-]g\d+)$",
    r"(?i)(?:[_\-]\d+)$",
)
# A decimal, the units that may follow a dose and a time.
DECIMAL = r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)"
DOSE_UNIT_TEXT = r"[A-Za-zµμ%]+(?:/[A-Za-zµμ%]+)?"
TIME_UNIT_TEXT = r"[A-Za-z]+"
#: What float() reads: digits with single underscores, exponents, infinities, nan.
_DIGITS = r"\d(?:_?\d)*"
FLOAT = rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)$"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_micro(c: Column) -> Column:
    """Both code points of micro as u."""
    return F.translate(c, "μµ", "uu")


def strip_whitespace(c: Column) -> Column:
    """Without white space (of all Unicode) at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def is_null_like(c: Column, values: tuple[str, ...] = NULL_LIKE) -> Column:
    return F.lower(strip_whitespace(c)).isin(*values)


def read_null(c: Column) -> Column:
    """Null where the text is a null literal of reading (n/a is none of them)."""
    return F.when(~is_null_like(c, NULL_LITERALS), c)


def _norm(c: Column, case_sensitive: bool, strip: bool) -> Column:
    c = fold_micro(strip_whitespace(c) if strip else text(c))
    return c if case_sensitive else F.lower(c)


def _norm_py(v: str, case_sensitive: bool, strip: bool) -> str:
    v = (v.strip() if strip else v).replace("μ", "u").replace("µ", "u")
    return v if case_sensitive else v.lower()


def map_control_labels(c: Column, candidates: list[str], output: str = "ctrl", case_sensitive: bool = False, strip_whitespace: bool = True) -> Column:
    known = [_norm_py(v, case_sensitive, strip_whitespace) for v in candidates]
    return F.when(_norm(c, case_sensitive, strip_whitespace).isin(*known), F.lit(output)).otherwise(text(c))


def replace_empty_with_null(c: Column, strip_whitespace: bool = True) -> Column:
    return F.when((globals()["strip_whitespace"](c) if strip_whitespace else text(c)) == "", F.lit(NA)).otherwise(text(c))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(text(c).startswith(prefix), F.substring(text(c), len(prefix) + 1, 1 << 30)).otherwise(text(c))


def strip_suffix(c: Column, suffix: str) -> Column:
    if not suffix:
        return text(c)
    return F.when(text(c).endswith(suffix), F.left(text(c), F.length(text(c)) - len(suffix))).otherwise(text(c))


def strip_guide_suffix(c: Column, pattern: str | None = None) -> Column:
    """Without the first guide suffix that matches; then _, - and blanks at the end go too."""
    out = text(c)
    for p in reversed([pattern] if pattern else GUIDE_SUFFIXES):
        out = F.when(text(c).rlike(p), F.regexp_replace(F.regexp_replace(text(c), p, ""), "[_ -]+$", "")).otherwise(out)
    return out


def regex_sub(c: Column, pattern: str, replacement: str) -> Column:
    """Every match replaced; \\1 in the replacement is the first group."""
    java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    return F.regexp_replace(text(c), pattern, java)


def normalize_case(c: Column, mode: str) -> Column:
    if mode in ("lower", "upper"):
        return getattr(F, mode)(text(c))
    if mode != "title":
        raise ValueError(f"unknown case {mode!r}")
    parts = F.split(text(c), r"(?<=\P{L})|(?<=\p{L})(?=\P{L})")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def recognize_control(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text(c).rlike(f"(?i){p}") for p in patterns), F.lit(False))


def join_with_plus(columns: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*map(text, columns)), lambda x: x != ""), "+")


def coalesce_values(columns: list[Column]) -> Column:
    return F.coalesce(*(F.when(~is_null_like(c), text(c)) for c in columns), F.lit(NA))


def split_on_delimiter(c: Column, delimiter: str = ",", part: int = 0) -> Column:
    if part < 0:
        return F.lit(NA)
    got = strip_whitespace(F.split_part(text(c), F.lit(delimiter), F.lit(part + 1)))
    return F.when(got == "", F.lit(NA)).otherwise(got)


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return text(c)
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(table, text(c)), text(c))


def _quantity(c: Column, units: str, group: int) -> Column:
    """Number (1) or unit (2) of a quantity, null if the text is none."""
    return F.nullif(F.regexp_extract(strip_whitespace(c), rf"^\s*({DECIMAL})\s*({units})\s*$", group), F.lit(""))


def _number(c: Column, units: str) -> Column:
    bare = strip_whitespace(c)
    return F.coalesce(_quantity(c, units, 1), F.when(bare.rlike(FLOAT), bare), F.lit(NA))


def _unit(c: Column, units: str, table: dict[str, str]) -> Column:
    """The usual spelling of a unit or of a quantity's unit; unknown ones stay as given, nothing is NA."""
    own = strip_whitespace(c)
    unit = F.coalesce(_quantity(c, units, 2), own)
    aliases = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.when(own == "", F.lit(NA)).otherwise(F.coalesce(F.try_element_at(aliases, F.lower(fold_micro(unit))), own))


def dose_parse(c: Column) -> Column:
    """The number of a dose; a bare number stays, anything else is NA."""
    return _number(c, DOSE_UNIT_TEXT)


def dose_unit(c: Column) -> Column:
    unit = _quantity(c, DOSE_UNIT_TEXT, 2)
    return F.when(unit.isNull(), F.lit(NA)).otherwise(normalize_dose_unit(unit))


def normalize_dose_unit(c: Column) -> Column:
    return _unit(c, DOSE_UNIT_TEXT, DOSE_UNITS)


def timepoint_parse(c: Column) -> Column:
    return _number(c, TIME_UNIT_TEXT)


def timepoint_unit(c: Column) -> Column:
    unit = _quantity(c, TIME_UNIT_TEXT, 2)
    return F.when(unit.isNull(), F.lit(NA)).otherwise(normalize_time_unit(unit))


def normalize_time_unit(c: Column) -> Column:
    return _unit(c, TIME_UNIT_TEXT, TIME_UNITS)


def strip_ensembl_version(c: Column) -> Column:
    return F.when(F.upper(text(c)).startswith("ENS"), F.regexp_replace(text(c), r"\.[0-9]+$", "")).otherwise(text(c))


def normalize_boolean(c: Column, true_output: str = "true", false_output: str = "false", true_values: tuple[str, ...] = ("true", "1", "yes", "y", "t"), false_values: tuple[str, ...] = ("false", "0", "no", "n", "f"), case_sensitive: bool = False, strip_whitespace: bool = True) -> Column:
    own = _norm(c, case_sensitive, strip_whitespace)
    known = lambda values: [_norm_py(v, case_sensitive, strip_whitespace) for v in values]
    return F.when(own.isin(*known(true_values)), F.lit(true_output)).when(own.isin(*known(false_values)), F.lit(false_output)).otherwise(text(c))


def label_key(c: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]", "")


def unpack_json(c: Column, keys: list[str]) -> list[Column]:
    """Fields of a JSON object as text; absent keys are null, booleans are spelt True and False."""
    fields = F.from_json(c, "map<string,string>")
    value = lambda k: F.try_element_at(fields, F.lit(k))
    return [F.when(value(k) == "true", "True").when(value(k) == "false", "False").otherwise(value(k)).alias(k) for k in keys]


def pack_json(columns: list[str]) -> Column:
    """All columns as one JSON object, nulls kept, NaN as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def to_int(c: Column) -> Column:
    """Null-like texts are null; others must be integers (an error if not)."""
    return F.when(~is_null_like(c), strip_whitespace(c)).cast("int")


def to_float(c: Column) -> Column:
    return F.when(~is_null_like(c), strip_whitespace(c)).cast("double")


def render_template(template: str, columns: dict[str, Column], missing: str = "fallback", fallback: str = NA, missing_value: str | None = None) -> Column:
    """{name} fields filled in; a null-like field gives the fallback for all, or for itself nothing (empty), or missing_value or its name (literal)."""
    parts, holes = [], []
    for piece in re.split(r"(\{[^{}]+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            name = piece[1:-1]
            if name not in columns:
                raise KeyError(name)
            hole = is_null_like(columns[name])
            holes.append(hole)
            other = {"fallback": F.lit(fallback), "empty": F.lit(""), "literal": F.lit(piece if missing_value is None else missing_value)}[missing]
            parts.append(F.when(hole, other).otherwise(text(columns[name])))
        elif piece:
            parts.append(F.lit(piece))
    out = F.concat(*parts) if parts else F.lit("")
    any_hole = reduce(lambda a, b: a | b, holes, F.lit(False))
    return F.when(any_hole, F.lit(fallback)).otherwise(out) if missing == "fallback" else out


#: Patterns that suggest a transform when most values of a column match.
VALUE_PATTERNS = {
    "dose": rf"(?i)^\s*{DECIMAL}\s*(nm|um|mm|pm|mg/kg|mg/ml|ug/ml|ng/ml)\s*$",
    "time": rf"(?i)^\s*{DECIMAL}\s*(h|hr|hrs|hours?|d|days?|mins?|minutes?)\s*$",
    "guide": "(?i)[_-](sg(RNA)?|g|guide)?[0-9]+$",
    "ensembl": "(?i)^ENS[A-Z]*G[0-9]+",
    "ensembl_versioned": r"(?i)^ENS[A-Z]*G[0-9]+\.[0-9]+$",
}


def looks_like(c: Column, kind: str) -> Column:
    return text(c).rlike(VALUE_PATTERNS[kind])


#: Transforms by name, as schemas call them.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (
        map_control_labels, strip_whitespace, replace_empty_with_null, strip_prefix, strip_suffix, strip_guide_suffix, regex_sub, normalize_case, split_on_delimiter, map_values, dose_parse, dose_unit, normalize_dose_unit,
        timepoint_parse, timepoint_unit, normalize_time_unit, strip_ensembl_version, normalize_boolean,
    )
}


def register(name: str, build: Callable[..., Column]) -> None:
    """Adds a transform of one's own: (Column, **arguments) to Column."""
    TRANSFORMS[name] = build


def pipeline(c: Column, rules: list[tuple[str, dict]], fallback: str = NA, warn: Callable[[str], None] = lambda _: None) -> Column:
    """Transforms in order. Unknown ones are skipped with a warning; wrong arguments or a null-like result give the fallback."""
    out = F.coalesce(c.cast("string"), F.lit(NA))
    for name, arguments in rules:
        if name not in TRANSFORMS:
            warn(f"unknown transform {name!r}")
            continue
        try:
            out = TRANSFORMS[name](out, **arguments)
        except (TypeError, ValueError, KeyError, re.error) as e:
            warn(f"{name}: {e}")
            return F.lit(fallback)
    return F.when(is_null_like(out), F.lit(fallback)).otherwise(out)
