"""Numeric and date coercion of arbitrary result columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER_TEXT = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"

QUARTER_TEXT = r"^\s*\d{4}-?[Qq][1-4]\s*$"

# Date spellings accepted beside ISO text.
DATE_FORMATS = (
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyy/M/d",
    "yyyy.M.d",
    "yyyyMMdd",
    "M-d-yyyy",
    "d-M-yyyy",
    "MMM yyyy",
    "MMMM yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d-MMM-yyyy",
)


def to_value(column: Column, kind: T.DataType) -> Column:
    """Column as a double; what is no number becomes null, and so does NaN."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        number = column.cast("double")
    elif isinstance(kind, T.StringType):
        number = F.when(column.rlike(NUMBER_TEXT), F.trim(column).try_cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(column.cast("timestamp")).cast("double") * 1000
    else:
        number = F.lit(None).cast("double")
    return F.when(~F.isnan(number), number)


def reads_as_date(column: Column, kind: T.DataType) -> Column:
    """True where the value can be understood as a date; null never can."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.isNotNull()
    if isinstance(kind, T.NumericType):
        return column.isNotNull() & ~F.isnan(column.cast("double"))
    if not isinstance(kind, T.StringType):
        return F.lit(False)
    text = F.trim(column)
    parsed = F.coalesce(
        text.try_cast("timestamp"),
        *[F.try_to_timestamp(text, F.lit(fmt)) for fmt in DATE_FORMATS],
    )
    return F.coalesce(parsed.isNotNull() | text.rlike(QUARTER_TEXT), F.lit(False))


def date_text(column: Column, kind: T.DataType) -> Column:
    """First ten characters of the value's text; null becomes empty."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return F.lit("")
    return F.left(F.coalesce(column.cast("string"), F.lit("")), F.lit(10))
