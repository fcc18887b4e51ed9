"""Column expressions that the workloads need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Lower-case words between white space; empty ones dropped."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def week_of_year(day: Column | str) -> Column:
    """Day of the year over seven, from 0; not the ISO week."""
    return F.floor(F.dayofyear(day) / 7).cast("long")


def us_date(text: Column | str) -> Column:
    return F.to_date(text, "MM/dd/yyyy")


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def argmin(values: Column) -> Column:
    """The first place, from 0, of the least value."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def add_scaled(a: Column | str, b: Column | str, factor: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * factor)


def top_of(values: Column | str, k: int) -> Column:
    """The ``k`` greatest values of a list, greatest first."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def millis(ts: Column | str) -> Column:
    return F.unix_millis(ts)
