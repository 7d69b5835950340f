"""Operators over short ordered series: one row per year or per group.

The windows here have no partition, or one group per partition. Their input is
already aggregated (at most one row per calendar year or per year and genre),
never film rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eraframe.constants import MOVING_YEARS
from eraframe.functions.rounding import round_half_up


def trailing_rows(order: str, rows: int = MOVING_YEARS) -> WindowSpec:
    """The current row and those before it; missing years widen the span."""
    return Window.orderBy(order).rowsBetween(1 - rows, Window.currentRow)


def with_share(
    df: DataFrame, within: list[str], amount: str, total: str, share: str
) -> DataFrame:
    """Add the group total and each row's percentage of it; a group is one task's."""
    whole = F.sum(amount).over(Window.partitionBy(*within))
    return _with_ratio(df.withColumn(total, whole), amount, total, share)


def with_share_of_large(
    df: DataFrame, within: list[str], amount: str, total: str, share: str
) -> DataFrame:
    """:func:`with_share` for groups that may outgrow a task.

    The totals are summed on their own and joined back: being few they are broadcast,
    or else adaptive execution splits a large group. At run time both sides read one
    exchange of ``df``. Null groups are groups too.
    """
    groups = [f"_group{i}" for i in range(len(within))]
    pairs = list(zip(within, groups, strict=True))
    totals = df.groupBy(*[F.col(c).alias(g) for c, g in pairs]).agg(F.sum(amount).alias(total))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(g)) for c, g in pairs))
    return _with_ratio(df.join(totals, same).drop(*groups), amount, total, share)


def _with_ratio(df: DataFrame, amount: str, total: str, share: str) -> DataFrame:
    ratio = F.col(amount).cast("double") / F.nullif(F.col(total), F.lit(0)) * 100
    return df.withColumn(share, round_half_up(ratio, 2))


def year_blocks(df: DataFrame, inside: Column, year: str = "release_year") -> DataFrame:
    """First and last year of every unbroken run of rows with ``inside`` true.

    Rows follow each other in year order; a year with no row breaks no run.
    """
    flag = F.coalesce(inside, F.lit(False))
    so_far = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.select(year, flag.alias("inside"))
        .withColumn("gap", F.count(F.when(~F.col("inside"), 1)).over(so_far))
        .filter("inside")
        .groupBy("gap")
        .agg(F.min(year).alias("start_year"), F.max(year).alias("end_year"))
        .select("start_year", "end_year")
        .orderBy("start_year")
    )
