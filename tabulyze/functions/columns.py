"""Schema walks and null-safe column expressions.

NaN counts as missing everywhere, so floating columns are read through
``value()``, which turns NaN into NULL before any aggregate sees it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
SCALAR_TYPES = INTEGER_TYPES + FLOAT_TYPES + DATETIME_TYPES + (
    T.DecimalType, T.StringType, T.BooleanType)


def require_rows(df: DataFrame) -> DataFrame:
    """Reject a table without columns or rows."""
    if not df.columns:
        raise ValueError("the table has no columns")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def col(name: str) -> Column:
    return F.col(quoted(name))


def kind(field: T.StructField) -> str:
    """numeric, boolean, datetime, string or other."""
    dtype = field.dataType
    if isinstance(dtype, (*INTEGER_TYPES, *FLOAT_TYPES, T.DecimalType)):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    return "other"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f) in kinds]


def numeric_columns(df: DataFrame, bool_is_numeric: bool = False) -> list[str]:
    return columns_of(df, "numeric", "boolean") if bool_is_numeric else columns_of(df, "numeric")


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "string")


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "datetime")


def is_integer(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, INTEGER_TYPES)


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL."""
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        return F.nanvl(col(name), F.lit(None).cast(df.schema[name].dataType))
    return col(name)


def number(df: DataFrame, name: str) -> Column:
    """The column as a double with NaN read as NULL."""
    return value(df, name).cast("double")


def compact_sql(df: DataFrame, name: str) -> str:
    """SQL text of a grouping key equal exactly when the cells are equal.

    Long strings are replaced by their SHA-256 (marked with ``#`` so that it
    cannot meet a short cell), which keeps shuffles of text columns narrow.
    """
    cell = value_sql(df, name)
    if kind(df.schema[name]) == "string":
        return f"if(length({cell}) > 64, concat('#', sha2({cell}, 256)), {cell})"
    if kind(df.schema[name]) == "other":
        return f"if({cell} is null, null, sha2(to_json(struct({cell} as cell)), 256))"
    return cell


def compact(df: DataFrame, name: str) -> Column:
    return F.expr(compact_sql(df, name))


def clip(cell: Column, low: Column, high: Column) -> Column:
    """Clamp that keeps NULL, which ``greatest`` and ``least`` alone would skip, and reads NaN,
    which they rank above every number, as NULL."""
    return F.when(cell.isNotNull() & ~F.isnan(cell.cast("double")), F.least(F.greatest(cell, low), high))


def rounded(x: Column | str, places: int) -> Column:
    """Round as scaled integers, so a double just under a tie is not read as the tie it prints like."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * float(10 ** places)) / float(10 ** places)


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)) * 100


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(x) -> str:
    """A Python scalar as SQL text."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        return f"{x!r}D" if math.isfinite(x) else f"double('{x!r}')"
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_sql(df: DataFrame, name: str) -> str:
    """SQL text of ``number()``. Wide expressions are built as text: one parse
    instead of a driver round trip per node."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DoubleType):
        return f"nanvl({quoted(name)}, cast(null as double))"
    if isinstance(dtype, T.FloatType):
        return f"cast(nanvl({quoted(name)}, cast(null as float)) as double)"
    return f"cast({quoted(name)} as double)"


def value_sql(df: DataFrame, name: str) -> str:
    """SQL text of ``value()``."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, FLOAT_TYPES):
        return f"nanvl({quoted(name)}, cast(null as {dtype.simpleString()}))"
    return quoted(name)


def pick(values: list, ordinal: str = "ordinal") -> Column:
    """Map a column's ordinal back to its name (or another per-column literal)."""
    return F.expr(f"element_at(array({', '.join(map(literal, values))}), {ordinal} + 1)")


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put one-row frames next to each other without a join."""
    types = {f.name: f.dataType.simpleString() for frame in frames for f in frame.schema.fields}
    rows = None
    for frame in frames:
        own = set(frame.columns)
        aligned = frame.selectExpr(*[quoted(c) if c in own else f"cast(null as {t}) as {quoted(c)}"
                                     for c, t in types.items()])
        rows = aligned if rows is None else rows.unionAll(aligned)
    return rows.selectExpr(*[f"max({quoted(c)}) as {quoted(c)}" for c in types])
