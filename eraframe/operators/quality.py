"""Integrity checks that stand in for database constraints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, table: str, key: str) -> DataFrame:
    """Key values that occur more than once."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select(
            F.lit(table).alias("table_name"),
            F.lit(key).alias("key_column"),
            F.col(key).cast("string").alias("key_value"),
            "copies",
        )
    )


def null_counts(df: DataFrame, table: str, columns: Iterable[str]) -> DataFrame:
    """Null count per column, one pass, one row per column."""
    columns = list(columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(
        F.lit(table).alias("table_name"),
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns]
            )
        ),
    )


def orphans(df: DataFrame, foreign_key: str, dim: DataFrame, dim_key: str, table: str) -> DataFrame:
    """Foreign-key values with no dimension row, with the rows they hold.

    The fact is counted per key first, so the anti join sees distinct keys.
    """
    held = df.groupBy(F.col(foreign_key).alias(dim_key)).agg(F.count(F.lit(1)).alias("row_count"))
    return held.join(dim.select(dim_key), dim_key, "left_anti").select(
        F.lit(table).alias("dim_table"),
        F.lit(foreign_key).alias("foreign_key"),
        F.col(dim_key).cast("string").alias("key_value"),
        "row_count",
    )
