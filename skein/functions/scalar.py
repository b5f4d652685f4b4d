"""Scalar expressions: ratios, keys, digests, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_or_zero(a, b) -> Column:
    """``a / b``, 0.0 where the denominator is 0: the convention of metrics."""
    return F.coalesce(F.try_divide(_d(a), _d(b)), F.lit(0.0))


def ratio_or_null(a, b) -> Column:
    """``a / b``, null where the denominator is 0: the convention of percentages."""
    return F.try_divide(_d(a), _d(b))


def percent(a, b) -> Column:
    return F.round(ratio_or_null(a, b) * 100, 2)


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def segment_id(u, v, key) -> Column:
    """``u_v_key``."""
    return F.concat_ws("_", u, v, key)


def node_id(osm) -> Column:
    return F.concat(F.lit("osm_"), F.col(osm).cast("string"))


def scalar_or_json(df: DataFrame, column: str) -> Column:
    """An attribute as text: arrays, maps and structs as JSON, anything else as it is written, a column that is absent as null."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    if column not in kinds:
        return F.lit(None).cast("string").alias(column)
    own = F.col(f"`{column}`")
    return (F.to_json(own) if kinds[column] in ("array", "map", "struct") else own.cast("string")).alias(column)


def attributes(df: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """``keys`` and the ``wanted`` attributes as text, whether ``df`` has them or not."""
    return df.select(*keys, *[scalar_or_json(df, c) for c in wanted])


def stripped(column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def passage_id(column) -> Column:
    """The first ten hex digits of the SHA-1 of the stripped text."""
    return F.substring(F.sha1(stripped(F.col(column)).cast("binary")), 1, 10)


def has_name(column) -> Column:
    return F.col(column).isNotNull() & (F.trim(column) != "")


def specific_name(column, generic: list[str], least: int = 4) -> Column:
    """Names long enough to search for: single words must not be generic."""
    c = F.col(column)
    return (F.length(c) >= least) & (c.contains(" ") | ~F.lower(c).isin(generic))


#: An item of a list in brackets: in single or double quotes, a backslash before a quote of its own kind.
QUOTED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""


def multi_values(column) -> Column:
    """A field that holds nothing, one value or a list in brackets, as an array of values.

    Items of a list stand in quotes of either kind, so one may hold the other. A bracketed list
    whose items are not quoted is taken as the literal text.
    """
    c = F.col(column)
    items = F.regexp_extract_all(c, F.lit(QUOTED), F.lit(1))
    plain = F.transform(items, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    is_list = c.rlike(r"(?s)^\s*\[\s*(" + QUOTED + r"\s*(,\s*" + QUOTED + r"\s*)*,?)?\s*\]\s*$")
    return F.when(c.isNull() | (F.trim(c) == ""), F.array().cast("array<string>")).when(is_list, plain).otherwise(F.array(c))


def parsed_matches(column, schema: str) -> Column:
    """An array of structs from JSON; invalid or missing text gives an empty array."""
    return F.coalesce(F.from_json(column, schema), F.array().cast(schema))


def mapped_label(column, mapping: dict, excluded: list) -> Column:
    """Labels by ``mapping``; excluded ones give null, unknown ones raise."""
    out = F.when(F.col(column).isin(excluded), F.lit(None).cast("int"))
    for label, value in mapping.items():
        out = out.when(F.col(column) == label, F.lit(value))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int"))
