"""Coercion of loosely typed columns: bad cells become NULL, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double; text that is no number, NaN or a missing column give NULL."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.DoubleType, T.FloatType)):
        return F.expr(f"nanvl(try_cast(`{name}` as double), null)")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.expr(f"cast(`{name}` as double)")
    return F.lit(None).cast("double")


def number_or(df: DataFrame, name: str, default: float = 0.0) -> Column:
    if name not in df.columns:
        return F.lit(float(default))
    return F.coalesce(number(df, name), F.lit(float(default)))


def selected(df: DataFrame, name: str) -> Column:
    """True when the quantity in ``name`` is a positive number."""
    return number_or(df, name) > 0


def whole(value: Column, default: int = 0) -> Column:
    """Truncate to an integer; NULL becomes ``default``."""
    return F.coalesce(value.try_cast("int"), F.lit(default))


def text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.col(name).cast("string")


def instant(df: DataFrame, name: str) -> Column:
    """Column as a UTC timestamp; unreadable text becomes NULL."""
    if name not in df.columns:
        return F.lit(None).cast("timestamp")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def flag(condition: Column) -> Column:
    """1.0 when true, 0.0 when false or unknown."""
    return F.when(condition, 1.0).otherwise(0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(top, F.nullif(bottom, F.lit(0.0)))


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns computed exactly once per row.

    ``withColumns`` lets the optimizer substitute a definition wherever the column is used, filters
    included, which multiplies long chains of dependent rules.  A one-row generator stops that.
    """
    values = [column.alias(name) for name, column in columns.items()]
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*values))))
