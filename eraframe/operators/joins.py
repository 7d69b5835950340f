"""Joining facts with the film dimension without tripping over hot films."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def film_groups(
    fact: DataFrame,
    movies: DataFrame,
    keys: Iterable[str] = (),
    totals: Iterable[str] = (),
    means: Iterable[str] = (),
) -> DataFrame:
    """Fact measures joined with film attributes, ready for a further groupBy.

    Columns: ``keys``, the film attributes, ``films`` (row count),
    ``<c>_total`` for ``totals`` and ``<c>_sum``/``<c>_known`` for ``means``.

    Rows meet their film in one join. The optimizer broadcasts a small film
    dimension; otherwise the fact is shuffled by film once, and adaptive execution
    splits a film that holds a large part of it.
    """
    known = {c: F.col(c).isNotNull().cast("bigint") for c in means}
    rows = fact.select(
        "movie_key",
        *keys,
        F.lit(1).cast("bigint").alias("films"),
        *[F.col(c).alias(f"{c}_total") for c in totals],
        *[F.col(c).cast("double").alias(f"{c}_sum") for c in known],
        *[known[c].alias(f"{c}_known") for c in known],
    )
    return rows.join(movies, "movie_key")


def group_mean(name: str) -> Column:
    """Mean over the rows behind ``film_groups`` output; null if none is known."""
    return F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_known"))
