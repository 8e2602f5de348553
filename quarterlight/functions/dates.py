"""Quarters: YYYYQn names, ends, neighbours, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_name(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def name_to_end(name: Column) -> Column:
    """Last day of YYYYQn."""
    return F.last_day(F.make_date(F.substring(name, 1, 4).try_cast("int"), F.substring(name, 6, 1).try_cast("int") * 3, F.lit(1)))


def previous_quarter(name: Column) -> Column:
    return quarter_name(F.add_months(name_to_end(name), -3))


def quarter_range(first: Column, last: Column) -> Column:
    """Names of all quarters from first to last."""
    return F.transform(F.sequence(F.trunc(name_to_end(first), "quarter"), F.trunc(name_to_end(last), "quarter"), F.expr("interval 3 months")), quarter_name)
