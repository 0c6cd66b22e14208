"""Row generators: week spine and dense grids.

The grids are made by exploding constant arrays next to the SKU rows, so building
them needs no join and keeps whatever partitioning the SKU rows have.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PlanningScope:
    """Channels, centers and Mondays that the dense grid covers."""

    channels: tuple[str, ...]
    centers: tuple[str, ...]
    first_week: str
    last_week: str

    def __post_init__(self):
        for day in (self.first_week, self.last_week):
            if date.fromisoformat(day).weekday() != 0:
                raise ValueError(f"{day} is not a Monday")

    @property
    def first(self) -> Column:
        return F.lit(date.fromisoformat(self.first_week))

    @property
    def last(self) -> Column:
        return F.lit(date.fromisoformat(self.last_week))

    @property
    def weeks(self) -> Column:
        return mondays_between(self.first, self.last)

    def covers_week(self, week: Column) -> Column:
        return week.between(self.first, self.last)


def cells_per_sku(scope: PlanningScope) -> int:
    """Rows of the dense grid for one SKU."""
    days = date.fromisoformat(scope.last_week) - date.fromisoformat(scope.first_week)
    return len(scope.channels) * len(scope.centers) * max(0, days.days // 7 + 1)


def mondays_between(first: Column, last: Column) -> Column:
    """Array of Mondays, empty when ``last`` comes before ``first``."""
    week = F.expr("INTERVAL '7' DAY")
    return F.when(first <= last, F.sequence(first, last, week)).otherwise(
        F.array().cast("array<date>")
    )


def literal_array(values) -> Column:
    return F.array(*[F.lit(value) for value in values])


def with_weeks(df: DataFrame, scope: PlanningScope) -> DataFrame:
    return df.select("*", F.explode(scope.weeks).alias("week_start_date"))


def with_channels(df: DataFrame, scope: PlanningScope) -> DataFrame:
    return df.select("*", F.explode(literal_array(scope.channels)).alias("channel_id"))


def with_centers(df: DataFrame, scope: PlanningScope) -> DataFrame:
    return df.select("*", F.explode(literal_array(scope.centers)).alias("center_id"))


def week_spine(days: DataFrame, day_column: str) -> DataFrame:
    """All Mondays between the first and the last day found in a table."""
    edges = days.agg(
        F.to_date(F.date_trunc("week", F.min(day_column))).alias("first"),
        F.to_date(F.date_trunc("week", F.max(day_column))).alias("last"),
    )
    return edges.select(F.explode(mondays_between(F.col("first"), F.col("last"))).alias(
        "week_start_date"))


def decision_grid(skus: DataFrame, scope: PlanningScope) -> DataFrame:
    """SKU x channel x center x week."""
    grid = with_weeks(with_centers(with_channels(skus.select("sku_id"), scope), scope), scope)
    return grid.select("sku_id", "channel_id", "center_id", "week_start_date")


def center_grid(skus: DataFrame, scope: PlanningScope) -> DataFrame:
    """SKU x center x week, for facts that know no channel."""
    return with_weeks(with_centers(skus, scope), scope)


def vendor_grid(vendors: DataFrame, scope: PlanningScope) -> DataFrame:
    """Vendor x week."""
    return with_weeks(vendors, scope)
