"""Exact continuous quantile of an INT column at any scale."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = 16


def quantile_of_counts(
    counts: DataFrame, value: str, rows: str, q: float, totals: Iterable[str] = ()
) -> DataFrame:
    """Interpolated ``q`` quantile (``quantile``) and sums ``total_<c>`` of ``totals``, as one row.

    ``counts`` has one row per distinct INT ``value`` with its frequency
    ``rows``, so duplicates are combined before anything is shuffled. The
    values are ranked in two steps, first the ranges that share their upper 16
    bits, then only the one or two ranges that hold the wanted rank: no task
    ever orders more than 65,536 ranges or twice 65,536 values.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"quantile out of range: {q}")
    totals = list(totals)
    sums = [f"total_{c}" for c in totals]
    coarse = F.shiftright(value, _LOW_BITS)
    # The join below asks for this; asked for here, both uses read the same rows.
    counts = counts.filter(coarse.isNotNull())
    everything = Window.partitionBy()
    upto = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (
        counts.groupBy(coarse.alias("coarse"))
        .agg(F.sum(rows).alias("in_range"), *[F.sum(c).alias(f"total_{c}") for c in totals])
        .select(
            "coarse",
            "in_range",
            F.sum("in_range").over(upto).alias("reached"),
            ((F.sum("in_range").over(everything) - 1) * F.lit(q)).alias("position"),
            *[F.sum(c).over(everything).alias(c) for c in sums],
        )
    )
    lower, upper = F.floor("position"), F.ceil("position")
    wanted = ranges.filter(
        (F.col("reached") > lower) & (F.col("reached") - F.col("in_range") <= upper)
    ).select("coarse", "position", (F.col("reached") - F.col("in_range")).alias("before"), *sums)
    within = Window.partitionBy("coarse").orderBy(value)
    # Always true. It keeps the columns of both uses of ``counts`` equal, so that the
    # engine counts once and reads that exchange twice.
    same_columns = F.pmod(F.hash(*totals), F.lit(2)) < 2 if totals else F.lit(True)
    ranked = (
        counts.withColumn("coarse", coarse)
        .join(F.broadcast(wanted), "coarse")
        .filter(same_columns)
        .withColumn(
            "reached",
            F.col("before")
            + F.sum(rows).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
    )

    def value_at(rank: Column) -> Column:
        return F.min(F.when(F.col("reached") > rank, F.col(value))).cast("double")

    return ranked.agg(
        value_at(lower).alias("low"),
        value_at(upper).alias("high"),
        F.max(F.col("position") - lower).alias("part"),
        *[F.max(c).alias(c) for c in sums],
    ).select(
        (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("quantile"), *sums
    )
