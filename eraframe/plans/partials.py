"""Mergeable partial aggregates of a star, kept at load, and the reports read from them.

A report over the fact reads every release; the partials hold one row per year and class of
releases, so a report over them reads thousands of rows whatever the size of the fact. All
measures are counts and sums, or the first rows of an order, so the partials of a new
load are just added to the stored ones: reports sum over loads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eraframe import constants as K
from eraframe import schemas
from eraframe.functions import classify
from eraframe.functions.rounding import round_half_up
from eraframe.functions.text import mentions_genre, primary_genre
from eraframe.operators.era import in_era, with_calendar
from eraframe.operators.joins import film_groups, group_mean
from eraframe.operators.quantile import quantile_of_counts
from eraframe.operators.series import trailing_rows, with_share
from eraframe.sources import commits
from eraframe.sources.star import Star

_MEASURES = ("budget", "revenue", "roi", "vote_average", "popularity")
_TOTALS = ("budget", "revenue")
# Keys of the tables; a key of classes is there once per year.
_YEARLY = ["date_key", "has_revenue", "has_budget", "profitability_tier", "budget_tier"]
_GENRES = ["date_key", "has_revenue", "has_budget", "genre", "is_comedy", "analyzed_genre"]


@dataclass(frozen=True)
class Partials:
    """The partial tables, beside the small dimensions that reports add.

    ``yearly`` has a row per year and class of money and return, ``genres`` per year and class of
    genre, ``runtimes`` per year, ``leaders`` the highest-grossing films of a year with their
    runtime, ``votes`` a row per vote count.
    """

    yearly: DataFrame
    genres: DataFrame
    runtimes: DataFrame
    leaders: DataFrame
    votes: DataFrame
    dates: DataFrame
    macro: DataFrame
    events: DataFrame


TABLES = ("yearly", "genres", "runtimes", "leaders", "votes")


def _above_zero(name: str) -> Column:
    return F.coalesce(F.col(name) > 0, F.lit(False))


def _with_classes(fact: DataFrame) -> DataFrame:
    return fact.withColumns(
        {"has_revenue": _above_zero("revenue"), "has_budget": _above_zero("budget")}
    )


def _sums() -> list[Column]:
    return [
        *[F.sum(c).alias(f"{c}_total") for c in _TOTALS],
        *[F.sum(F.col(c).cast("double")).alias(f"{c}_sum") for c in _MEASURES],
        *[F.count(c).alias(f"{c}_known") for c in _MEASURES],
    ]


def _leaders(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of every year by revenue, then key; cut in every task before the shuffle."""
    order = Window.partitionBy("date_key").orderBy(F.desc("revenue"), "movie_key")
    ranked = rows.withColumn("revenue_rank", F.row_number().over(order))
    return ranked.filter(F.col("revenue_rank") <= top).drop("revenue_rank")


def build_partials(star: Star, top: int = K.TOP_FILMS_PER_YEAR) -> Partials:
    """Partials of all releases of a star, lazily."""
    fact = _with_classes(star.fact)
    yearly = (
        fact.withColumns(
            {
                "profitability_tier": classify.profitability_tier(F.col("roi")),
                "budget_tier": classify.budget_tier(F.col("budget")),
            }
        )
        .groupBy(*_YEARLY)
        .agg(
            F.count(F.lit(1)).alias("films"),
            F.count("movie_key").alias("movies"),
            F.count_if(F.col("roi") > K.HIGH_ROI).alias("high_roi"),
            *_sums(),
        )
    )
    kinds = star.movies.select(
        "movie_key",
        primary_genre(F.col("genre")).alias("genre"),
        F.coalesce(mentions_genre(F.col("genre"), "comedy"), F.lit(False)).alias("is_comedy"),
        classify.comedy_or_horror(F.col("genre")).alias("analyzed_genre"),
    )
    in_genres = film_groups(
        fact, kinds, _GENRES[:3], totals=_TOTALS, means=_MEASURES[:4]
    )
    sums = [f"{c}_total" for c in _TOTALS]
    sums += [f"{c}_{part}" for c in _MEASURES[:4] for part in ("sum", "known")]
    genres = in_genres.groupBy(*_GENRES).agg(
        F.sum("films").alias("films"), *[F.sum(c).alias(c) for c in sums]
    )
    timed = star.movies.filter("runtime > 0").select("movie_key", "runtime")
    runtimes = (
        film_groups(star.fact, timed, ["date_key"])
        .groupBy("date_key")
        .agg(
            F.sum(F.col("runtime").cast("bigint") * F.col("films")).alias("minutes"),
            F.sum("films").alias("films"),
        )
    )
    sold = star.fact.select("movie_key", "date_key", "revenue").join(timed, "movie_key")
    votes = (
        star.fact.filter("vote_count > 0")
        .groupBy("vote_count")
        .agg(
            F.count(F.lit(1)).alias("films"),
            F.sum("vote_average").alias("rating_sum"),
            F.count("vote_average").alias("rated"),
        )
    )
    leaders = _leaders(sold, top)
    return Partials(
        yearly, genres, runtimes, leaders, votes, star.dates, star.macro, star.events
    )


def together(*parts: Partials) -> Partials:
    """The partials of several loads; the dimensions are those of the last."""

    def union(table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(p, table) for p in parts])

    last = parts[-1]
    return Partials(*[union(t) for t in TABLES], last.dates, last.macro, last.events)


def add_partials(spark: SparkSession, path: str, load: Partials) -> commits.Version:
    """Adds the partials of a load to the stored ones, all tables in one commit."""
    written = {t: commits.write_rows(getattr(load, t), path, t).folders for t in TABLES}

    def make(base: commits.Version) -> commits.Change:
        return {t: [*base.folders(t), *written[t]] for t in TABLES}, {}

    return commits.retried(spark, path, make)


def read_partials(spark: SparkSession, path: str, star: Star) -> Partials:
    """Stored partials with the dimensions of a star."""
    version = commits.latest(spark, path)
    tables = [
        commits.read_rows(spark, path, t, getattr(schemas, f"PARTIAL_{t.upper()}"), version)
        for t in TABLES
    ]
    return Partials(*tables, star.dates, star.macro, star.events)


def _rows(p: Partials, table: str, *positive: str, era: str = "All") -> DataFrame:
    flags = reduce(and_, (F.col(f"has_{c}") for c in positive), F.lit(True))
    return in_era(getattr(p, table).filter(flags), p, era)


def _by_year(rows: DataFrame, *measures: Column) -> DataFrame:
    return rows.groupBy(F.col("date_key").alias("release_year")).agg(*measures)


def _mean(name: str, digits: int) -> Column:
    return round_half_up(group_mean(name), digits)


def _whole_mean(name: str) -> Column:
    known = F.nullif(F.sum(f"{name}_known"), F.lit(0))
    return F.call_function("div", F.sum(f"{name}_total"), known)


def _total(name: str) -> Column:
    return F.sum(f"{name}_total")


def industry_baseline_trends(p: Partials, era: str = "All") -> DataFrame:
    yearly = _by_year(
        _rows(p, "yearly", "revenue", "budget", era=era),
        F.sum("movies").alias("movies_released"),
        _total("budget").alias("total_industry_budget"),
        _total("revenue").alias("total_box_office"),
        (_total("revenue") - _total("budget")).alias("net_profit"),
        _mean("roi", 2).alias("avg_roi"),
    )
    return with_calendar(yearly, p, "era_type").orderBy("release_year")


def profitability_split(p: Partials) -> DataFrame:
    return (
        _rows(p, "yearly", "budget", "revenue")
        .groupBy("profitability_tier")
        .agg(F.sum("films").alias("movie_count"), _mean("vote_average", 2).alias("avg_rating"))
        .orderBy("profitability_tier")
    )


def genre_baselines(p: Partials, min_films: int = K.MIN_GENRE_FILMS) -> DataFrame:
    return (
        _rows(p, "genres", "budget", "revenue")
        .groupBy("genre")
        .agg(
            F.sum("films").alias("total_movies"),
            _mean("budget", 0).alias("avg_budget"),
            _mean("revenue", 0).alias("avg_revenue"),
            _mean("roi", 2).alias("avg_roi"),
        )
        .filter(F.col("total_movies") > min_films)
        .orderBy(F.desc("avg_revenue"), "genre")
    )


def escapism_index(p: Partials, era: str = "All") -> DataFrame:
    genres = (
        _rows(p, "genres", "revenue", era=era)
        .groupBy(F.col("date_key").alias("release_year"), "genre")
        .agg(_total("revenue").alias("total_revenue"))
    )
    shares = with_share(
        genres, ["release_year"], "total_revenue", "year_total_revenue", "market_share_pct"
    )
    return (
        with_calendar(shares, p, "era_type")
        .select(
            "release_year",
            "genre",
            "era_type",
            "total_revenue",
            "year_total_revenue",
            "market_share_pct",
        )
        .orderBy("release_year", "era_type", F.desc("market_share_pct"), "genre")
    )


def budget_dilemma(p: Partials, era: str = "All") -> DataFrame:
    tiers = (
        _rows(p, "yearly", "budget", era=era)
        .groupBy(F.col("date_key").alias("release_year"), "budget_tier")
        .agg(
            F.sum("films").alias("film_count"),
            _mean("budget", 0).alias("avg_budget"),
            _mean("revenue", 0).alias("avg_revenue"),
            _mean("roi", 2).alias("avg_roi"),
        )
    )
    return (
        with_calendar(tiers, p, "era_type", "gdp_growth_rate")
        .select(
            "release_year",
            "budget_tier",
            "era_type",
            "film_count",
            "avg_budget",
            "avg_revenue",
            "avg_roi",
            "gdp_growth_rate",
        )
        .orderBy("release_year", "budget_tier")
    )


def comedy_paradox(p: Partials, era: str = "All") -> DataFrame:
    yearly = _by_year(
        _rows(p, "genres", "revenue", era=era).filter("is_comedy"),
        F.sum("films").alias("comedy_film_count"),
        _total("revenue").alias("total_revenue"),
        _mean("vote_average", 3).alias("avg_vote_average"),
    )
    five = trailing_rows("release_year")
    rating = F.col("avg_vote_average").cast("decimal(18,3)")
    return (
        with_calendar(yearly, p, "unemployment_rate")
        .withColumns(
            {
                "ma5_revenue": F.avg(F.col("total_revenue").cast("double")).over(five),
                "ma5_rating": F.try_divide(
                    F.sum(rating).over(five).cast("double"), F.count(rating).over(five)
                ),
            }
        )
        .orderBy("release_year")
    )


def runtime_paradox(
    p: Partials, era: str = "All", top: int = K.TOP_FILMS_PER_YEAR
) -> DataFrame:
    """``top`` must be no more than the partials were built with."""
    every = _by_year(
        in_era(p.runtimes, p, era),
        F.sum("minutes").alias("all_sum"),
        F.sum("films").alias("all_films"),
    )
    best = _by_year(
        _leaders(in_era(p.leaders, p, era), top),
        F.sum(F.col("runtime").cast("bigint")).alias("top_sum"),
        F.count("runtime").alias("top_films"),
    )
    five = trailing_rows("release_year")

    def mean(total: Column, films: Column) -> Column:
        return round_half_up(F.try_divide(total.cast("double"), films), 2)

    def moving(total: str, films: str) -> Column:
        return mean(F.sum(total).over(five), F.sum(films).over(five))

    return (
        with_calendar(every.join(best, "release_year"), p, "era_type")
        .select(
            "release_year",
            mean(F.col("all_sum"), F.col("all_films")).alias("avg_runtime_all"),
            mean(F.col("top_sum"), F.col("top_films")).alias("avg_runtime_top100"),
            moving("all_sum", "all_films").alias("ma5_runtime_all"),
            moving("top_sum", "top_films").alias("ma5_runtime_top100"),
            classify.streaming_era(F.col("release_year")).alias("streaming_era_flag"),
            "era_type",
        )
        .orderBy("release_year")
    )


def financial_kpis(p: Partials) -> DataFrame:
    yearly = _by_year(
        _rows(p, "yearly", "budget", "revenue"),
        F.sum("films").alias("total_films"),
        _total("budget").alias("total_budget"),
        _total("revenue").alias("total_revenue"),
        _mean("roi", 2).alias("avg_roi_pct"),
        F.sum("high_roi").alias("high_roi_films"),
    )
    return with_calendar(yearly, p, "gdp_growth_rate", "inflation_rate").orderBy("release_year")


def vote_statistics(p: Partials, q: float = K.VOTE_QUANTILE) -> DataFrame:
    sums = ["films", "rating_sum", "rated"]
    counts = p.votes.groupBy("vote_count").agg(*[F.sum(c).alias(c) for c in sums])
    return quantile_of_counts(counts, "vote_count", "films", q, sums[1:]).select(
        F.try_divide("total_rating_sum", "total_rated").alias("global_mean"),
        F.col("quantile").alias("min_votes"),
    )


def decade_genre_share(p: Partials) -> DataFrame:
    genres = (
        p.genres.join(p.dates.select("date_key", "decade"), "date_key")
        .groupBy("decade", "genre")
        .agg(F.sum("films").alias("film_count"))
    )
    return with_share(
        genres, ["decade"], "film_count", "decade_total_films", "genre_share_pct"
    ).orderBy("decade", F.desc("genre_share_pct"), "genre")


def production_density(p: Partials, era: str = "All") -> DataFrame:
    yearly = _by_year(
        _rows(p, "yearly", era=era),
        F.sum("films").alias("total_films"),
        _mean("budget", 0).alias("avg_budget"),
        _mean("revenue", 0).alias("avg_revenue"),
    )
    return with_calendar(yearly, p, "gdp_growth_rate", "unemployment_rate", "era_type").orderBy(
        "release_year"
    )


def budget_elasticity(p: Partials) -> DataFrame:
    yearly = _by_year(
        _rows(p, "yearly", "budget"),
        F.sum("budget_sum").alias("total_industry_investment"),
        _mean("budget", 0).alias("avg_movie_budget"),
    )
    return with_calendar(yearly, p, "gdp_growth_rate", "unemployment_rate").orderBy("release_year")


def comedy_horror_paradox(p: Partials) -> DataFrame:
    rows = p.genres.filter("analyzed_genre IS NOT NULL").withColumnRenamed("date_key", "release_year")
    return (
        with_calendar(rows, p, "economic_climate")
        .groupBy("economic_climate", "analyzed_genre")
        .agg(
            F.sum("films").alias("movies_produced"),
            _total("revenue").alias("total_genre_revenue"),
            _whole_mean("budget").alias("avg_production_budget"),
            _mean("vote_average", 2).alias("avg_audience_rating"),
            _mean("roi", 2).alias("avg_roi"),
        )
        .orderBy(F.desc("economic_climate"), "analyzed_genre")
    )


def gdp_vs_movie_revenue(p: Partials, era: str = "All") -> DataFrame:
    yearly = _by_year(
        _rows(p, "yearly", "revenue", "budget", era=era),
        _total("revenue").alias("total_box_office"),
        F.sum("movies").alias("movies_released"),
        _whole_mean("revenue").alias("avg_movie_revenue"),
        (_total("revenue") - _total("budget")).alias("total_net_profit"),
    )
    return (
        with_calendar(yearly, p, "gdp_growth_rate")
        .select("release_year", "gdp_growth_rate", *yearly.columns[1:])
        .orderBy("release_year")
    )


def crisis_timeline_overlay(p: Partials, era: str = "All") -> DataFrame:
    yearly = _by_year(
        _rows(p, "yearly", "revenue", "budget", era=era),
        F.sum("movies").alias("movies_released"),
        _total("budget").alias("total_budget"),
        _total("revenue").alias("total_box_office"),
        _mean("roi", 2).alias("avg_movie_roi"),
        _mean("popularity", 2).alias("avg_voter_popularity"),
    )
    events = p.events.select(
        F.col("event_year").alias("release_year"),
        F.col("event_name").alias("historical_event"),
        F.col("event_type").alias("event_category"),
    )
    return (
        yearly.join(events, "release_year", "left")
        .select("release_year", *events.columns[1:], *yearly.columns[1:])
        .fillna({"historical_event": K.NO_EVENT_NAME, "event_category": K.NO_EVENT_CATEGORY})
        .orderBy("release_year")
    )


def genre_performance_summary(p: Partials) -> DataFrame:
    return (
        _rows(p, "genres", "budget", "revenue")
        .groupBy(F.col("genre").alias("primary_genre"))
        .agg(
            F.sum("films").alias("film_count"),
            _mean("budget", 0).alias("avg_budget"),
            _mean("revenue", 0).alias("avg_revenue"),
            _mean("roi", 2).alias("avg_roi"),
            _mean("vote_average", 2).alias("avg_audience_rating"),
        )
    )


def inflation_adjusted_profit(p: Partials, era: str = "All") -> DataFrame:
    yearly = _by_year(
        _rows(p, "yearly", "revenue", "budget", era=era),
        _total("revenue").alias("total_revenue"),
        _total("budget").alias("total_budget"),
    )
    profit = (F.col("total_revenue") - F.col("total_budget")).cast("double")
    return (
        with_calendar(yearly, p, "inflation_rate")
        .withColumn("inflation_adjusted_profit", F.try_divide(profit, F.col("inflation_rate")))
        .orderBy("release_year")
    )


# Reports that partials answer, under the names of the reports over the star. The others return
# rows of single films.
REPORTS: dict[str, Callable[..., DataFrame]] = {
    report.__name__: report
    for report in (
        industry_baseline_trends,
        profitability_split,
        genre_baselines,
        escapism_index,
        budget_dilemma,
        comedy_paradox,
        runtime_paradox,
        financial_kpis,
        vote_statistics,
        decade_genre_share,
        production_density,
        budget_elasticity,
        comedy_horror_paradox,
        gdp_vs_movie_revenue,
        crisis_timeline_overlay,
        genre_performance_summary,
        inflation_adjusted_profit,
    )
}
