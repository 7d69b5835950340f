"""Reshaping of report results for the dashboard pages.

The inputs are report results with at most one row per year, per year and
tier, or per year and genre, but for the ratings of :func:`rating_histogram`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eraframe import constants as K
from eraframe.functions.rounding import round_half_up
from eraframe.operators.series import year_blocks


def executive_kpis(trends: DataFrame) -> DataFrame:
    """Totals over the yearly trends and the budget-weighted return in percent."""
    sums = trends.agg(
        *[
            F.coalesce(F.sum(column), F.lit(0)).alias(name)
            for name, column in (
                ("total_revenue", "total_box_office"),
                ("total_movies", "movies_released"),
                ("total_profit", "net_profit"),
                ("total_budget", "total_industry_budget"),
            )
        ]
    )
    weighted = F.col("total_profit").cast("double") / F.col("total_budget").cast("double") * 100
    return sums.withColumn(
        "avg_roi", F.when(F.col("total_budget") > 0, weighted).otherwise(F.lit(0.0))
    )


def crisis_blocks(yearly: DataFrame) -> DataFrame:
    """Runs of crisis years in any yearly report with ``era_type``."""
    return year_blocks(yearly, F.col("era_type") == K.CRISIS)


def streaming_blocks(runtimes: DataFrame) -> DataFrame:
    """Runs of years in the streaming or short-form era."""
    return year_blocks(runtimes, F.col("streaming_era_flag") != K.PRE_STREAMING)


def runtime_premium(runtimes: DataFrame) -> DataFrame:
    """Moving runtime of the top films over that of all; null if either is null or 0."""
    top, every = F.col("ma5_runtime_top100"), F.col("ma5_runtime_all")
    return runtimes.withColumn(
        "runtime_premium", F.when((top != 0) & (every != 0), round_half_up(top - every, 2))
    ).orderBy("release_year")


def _top_genres(shares: DataFrame, k: int) -> DataFrame:
    """The ``k`` genres with the largest summed share, in order; null is a genre too."""
    exact = F.col("genre_share_pct").cast("decimal(20,2)")
    summed = shares.groupBy("genre").agg(F.sum(exact).alias("summed"))
    return summed.orderBy(F.desc("summed"), "genre").limit(k).select("genre")


def top_genres_other(shares: DataFrame, k: int = K.TOP_GENRES) -> DataFrame:
    """Share per decade of the top ``k`` genres and of all others together.

    Long form, one row per decade and label, 0 where a decade lacks the genre. A
    genre that has the name of the rest is counted with it.
    """
    top = _top_genres(shares, k).select(F.col("genre").alias("top"), F.lit(True).alias("is_top"))
    label = F.when(F.col("is_top"), F.col("genre")).otherwise(K.OTHER_GENRES)
    exact = F.col("genre_share_pct").cast("decimal(20,2)")
    labelled = (
        shares.select("decade", "genre", exact.alias("share"))
        .join(top, F.col("genre").eqNullSafe(F.col("top")), "left")
        .groupBy("decade", label.alias("label"))
        .agg(F.sum("share").cast("double").alias("share_pct"))
    )
    # At most k + 1 labels per decade from here on; structs carry a null label.
    every = F.collect_set(F.struct("label")).over(Window.partitionBy())
    by_decade = (
        labelled.withColumn("every", every)
        .groupBy("decade")
        .agg(
            F.collect_list(F.struct("label", "share_pct")).alias("held"),
            F.first("every").alias("every"),
        )
        .withColumn(
            "every", F.array_union("every", F.array(F.struct(F.lit(K.OTHER_GENRES).alias("label"))))
        )
    )
    shown = by_decade.select("decade", "held", F.explode("every").alias("shown"))
    own = F.filter("held", lambda h: h["label"].eqNullSafe(F.col("shown.label")))
    return shown.select(
        "decade",
        F.col("shown.label").alias("label"),
        F.coalesce(F.get(own, F.lit(0))["share_pct"], F.lit(0.0)).alias("share_pct"),
    ).orderBy("decade", "label")


def decade_genre_matrix(shares: DataFrame, k: int = K.TOP_GENRES) -> DataFrame:
    """:func:`top_genres_other` with one column per label, ``null`` for no genre.

    A genre that is called so is added to that column. Column names come from the data, so the ``k`` top names are looked up first.
    """
    named = [row["genre"] for row in _top_genres(shares, k).collect()]
    columns = dict.fromkeys([*("null" if n is None else n for n in named), K.OTHER_GENRES])
    return (
        top_genres_other(shares, k)
        .withColumn("label", F.coalesce("label", F.lit("null")))
        .groupBy("decade")
        .pivot("label", list(columns))
        .agg(F.sum("share_pct"))
        .orderBy("decade")
    )


def rating_histogram(ratings: DataFrame) -> DataFrame:
    """Films per half-point bin of the weighted rating."""
    floor = F.floor(F.col("weighted_rating") * 2) / 2
    return (
        ratings.groupBy(floor.alias("bin"))
        .agg(F.count(F.lit(1)).alias("film_count"))
        .orderBy("bin")
    )


def escapism_pivot(index: DataFrame) -> DataFrame:
    """Share of each genre in the first stable and the first crisis year it has."""
    return (
        index.groupBy("genre")
        .pivot("era_type", K.ERA_LABELS)
        .agg(F.min_by("market_share_pct", "release_year"))
        .fillna(0.0, subset=K.ERA_LABELS)
        .orderBy("genre")
    )


def budget_tier_pivot(dilemma: DataFrame) -> DataFrame:
    """Releases per year, one column per budget tier."""
    return (
        dilemma.groupBy(F.col("release_year").alias("year"))
        .pivot("budget_tier", K.BUDGET_TIERS)
        .agg(F.first("film_count"))
        .fillna(0, subset=K.BUDGET_TIERS)
        .orderBy("year")
    )
