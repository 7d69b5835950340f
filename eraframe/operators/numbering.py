"""Gapless numbers for rows in a given order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eraframe.sources import sinks


def numbered(
    rows: DataFrame, order: Sequence[str], name: str, after: DataFrame | int = 0
) -> DataFrame:
    """Adds column ``name``: the place of each row in ``order``, from ``after`` + 1 on.

    ``after`` is a number, or a frame of one row and column that holds it. Rows are
    sorted by range over all tasks and stored; only the row count of each task is
    summed up in one place. Rows that are equal in ``order`` are numbered in
    any order, so name enough columns. Nulls come first.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, task, first, earlier = (f"{name}_{part}" for part in ("place", "task", "first", "earlier"))
    ordered = (
        rows.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id())
        .withColumn(task, F.shiftright(place, 33))
    )
    ordered = sinks.hand_off(ordered, "numbered")
    start = F.lit(after) if isinstance(after, int) else after.scalar()
    # One row per task, whatever the number of rows.
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy(task).agg(F.min(place).alias(first), F.count(F.lit(1)).alias("held"))
    starts = counts.withColumn(earlier, F.coalesce(F.sum("held").over(before), F.lit(0)) + start)
    return (
        ordered.join(starts.drop("held"), task)
        .withColumn(name, F.col(place) - F.col(first) + F.col(earlier) + 1)
        .drop(place, task, first, earlier)
    )
