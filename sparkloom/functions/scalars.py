"""Scalar functions whose NULL rules or arguments differ from Spark's functions of like name. JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regexp_extract_null(s: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; NULL, not '', without a match."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def split_index(s: Column, delimiter: str, i: int) -> Column:
    """Part ``i`` from 0 between literal delimiters; NULL out of range."""
    literal = "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in delimiter)
    return F.when(F.lit(i) >= 0, F.get(F.split(s, literal, -1), F.lit(max(i, 0))))


def count_char(s: Column, c: str) -> Column:
    """How often a string (its first character, if longer) occurs in ``s``."""
    return F.length(s) - F.length(F.replace(s, F.lit(c[:1]), F.lit("")))


def _json_at(s: Column, path: str) -> tuple[Column, Column]:
    """The text at a path and whether it is an object or array, by its JSON type; bad JSON and JSON nulls give NULL."""
    v = F.try_variant_get(F.try_parse_json(s), path, "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind != "VOID", v), kind.startswith("OBJECT") | kind.startswith("ARRAY")


def json_value(s: Column, path: str, default: str | None = None) -> Column:
    """A scalar at a path as text; objects, arrays and missing paths give the default."""
    v, nested = _json_at(s, path)
    return F.coalesce(F.when(~nested, v.cast("string")), F.lit(default))


def json_query(s: Column, path: str, wrapper: str = "without", empty: str | None = None) -> Column:
    """An object or array at a path. Wrapper: ``without`` (scalars are NULL), ``conditional`` (scalars are wrapped) or ``always``."""
    v, nested = _json_at(s, path)
    text = F.to_json(v)
    wrap = F.concat(F.lit("["), text, F.lit("]"))
    out = {"without": F.when(nested, text), "conditional": F.when(nested, text).otherwise(wrap), "always": wrap}[wrapper]
    return F.coalesce(F.when(v.isNotNull(), out), F.lit(empty))


def json_split(s: Column, separator: str = ",") -> Column:
    """The elements of a JSON array of strings, joined."""
    return F.array_join(F.from_json(s, "array<string>"), separator)


def hash_code(*cs: Column) -> Column:
    """A 32-bit Murmur3 hash (Spark's seed; for dealing rows out, not for comparing with other engines)."""
    return F.hash(*cs)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def to_timestamp_ltz(n: Column, precision: int = 3) -> Column:
    return F.timestamp_seconds(n) if precision == 0 else F.timestamp_millis(n)


def date_add_days(ts: Column, days: Column) -> Column:
    """A time some days later, as milliseconds since 1970."""
    return F.unix_millis(ts.cast("timestamp") + F.make_dt_interval(days))
