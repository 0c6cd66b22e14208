"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def monday_of(when) -> Column:
    """The Monday that starts the week of a date or timestamp."""
    return F.trunc(F.to_date(when), "week")


def week_floor_of_cutoff(when: Column, hour: int) -> Column:
    """First Monday whose cutoff (Monday ``hour`` o'clock) lies strictly after ``when``."""
    own = monday_of(when)
    cutoff = own.cast("timestamp_ntz") + F.expr(f"INTERVAL '{hour}' HOUR")
    return F.when(when < cutoff, own).otherwise(F.date_add(own, 7))


def first_monday_on_or_after(day: Column) -> Column:
    return monday_of(F.date_add(day, 6))


def blank_to_null(text) -> Column:
    return F.nullif(F.col(text) if isinstance(text, str) else text, F.lit(""))


def as_number(value) -> Column:
    """Text or number to double; text that is no number becomes NULL."""
    return (F.col(value) if isinstance(value, str) else value).try_cast("double")


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, NULL unless the denominator is above zero."""
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def bounded(value: Column, low=None, high=None) -> Column:
    """Clip that keeps NULL as NULL (``greatest``/``least`` would drop it)."""
    if low is not None:
        value = F.when(value < low, F.lit(low)).otherwise(value)
    if high is not None:
        value = F.when(value > high, F.lit(high)).otherwise(value)
    return value


def larger_if_known(left: Column, right: Column) -> Column:
    """Larger of two values, NULL when either is NULL."""
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right))


def ceil_weeks(days: Column) -> Column:
    return F.ceil(bounded(days, 0) / F.lit(7.0)).cast("int")


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant map as a CASE expression."""
    chain = None
    for name, value in table.items():
        step = key == F.lit(name)
        chain = F.when(step, F.lit(value)) if chain is None else chain.when(step, F.lit(value))
    return chain if default is None else chain.otherwise(F.lit(default))


def known(key: Column, table: dict, name: str) -> Column:
    """``lookup`` that fails on a value the map does not have; NULL stays NULL."""
    error = F.raise_error(F.concat(F.lit(f"unknown {name}: "), key)).cast("double")
    return F.when(key.isNotNull(), F.coalesce(lookup(key, table), error))
