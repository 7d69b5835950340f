"""Keyed row sets: keep the first row, add only what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank filter is applied in every task before the shuffle, so a key with
    very many copies sends one row per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def only_new(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``existing`` yet; a null is a key like any other."""
    known = existing.select(F.col(key).alias("known_key"))
    return df.join(known, df[key].eqNullSafe(known["known_key"]), "left_anti")
