"""Periods, granularities and date prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Granularities, their truncation unit and the text of a period.
GRANULARITY_UNITS = {
    "daily": "day",
    "weekly": "week",
    "monthly": "month",
    "quarterly": "quarter",
    "annual": "year",
}
PERIOD_FORMATS = {
    "daily": "yyyy-MM-dd",
    "weekly": "yyyy-MM-dd",
    "monthly": "yyyy-MM",
    "quarterly": "yyyy-MM",
    "annual": "yyyy-MM",
}

# How a declared range must end to lie on a period boundary.
BOUNDARY_SUFFIXES = {"monthly": "-01", "quarterly": "-01", "annual": "-01-01"}


def period_start(ts: Column, granularity: str) -> Column:
    """Start of the period as a timestamp, cheap to group by."""
    return F.date_trunc(GRANULARITY_UNITS[granularity], ts)


def period_text(start: Column, granularity: str) -> Column:
    """Text of a period start, meant for rows that are already grouped."""
    return F.date_format(start, PERIOD_FORMATS[granularity])


def month_prefix(text: Column) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(7))


def day_prefix(text: Column) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(10))


def snap_to_period(date: Column, granularity: Column) -> Column:
    """Date text moved to the start of its period; a bare year becomes its first day."""
    size = F.length(date)
    return (
        F.when(size == 4, F.concat(date, F.lit("-01-01")))
        .when(size < 7, date)
        .when(granularity.isin("monthly", "quarterly"), F.concat(F.left(date, F.lit(7)), F.lit("-01")))
        .when(granularity == "annual", F.concat(F.left(date, F.lit(4)), F.lit("-01-01")))
        .otherwise(date)
    )


def on_boundary(date: Column, granularity: Column) -> Column:
    """True when empty, or aligned to the granularity; others are always aligned."""
    blank = F.coalesce(date, F.lit("")) == ""
    aligned = F.lit(True)
    for name, suffix in BOUNDARY_SUFFIXES.items():
        aligned = F.when(granularity == name, blank | date.endswith(suffix)).otherwise(aligned)
    return aligned


def span_months(start: Column, end: Column) -> Column:
    """Whole months from ``start`` to ``end``; null when either is blank or malformed."""

    def months(text: Column) -> Column:
        year = F.left(text, F.lit(4)).try_cast("int")
        return year * 12 + text.substr(6, 2).try_cast("int")

    return (months(end) - months(start)).cast("bigint")
