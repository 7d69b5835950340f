"""Dimensions and fact out of the staged films and the macro table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eraframe import constants as K
from eraframe import schemas
from eraframe.functions.classify import decade_label
from eraframe.functions.rounding import round_half_even
from eraframe.operators.keyed import keep_first, only_new
from eraframe.operators.numbering import numbered
from eraframe.plans.reload import Reload, reload_star
from eraframe.sources import commits, sinks
from eraframe.sources.star import TABLES, Star


def loadable(staged: DataFrame) -> DataFrame:
    """Staged films with enough votes; an unknown year counts as 0."""
    votes = F.coalesce(F.col("imdb_votes").try_cast("bigint"), F.lit(0))
    return staged.withColumns(
        {
            "imdb_votes": votes,
            "imdb_rating": F.col("imdb_rating").try_cast("double"),
            "year": F.coalesce(F.col("year").cast("int"), F.lit(0)),
        }
    ).filter(F.col("imdb_votes") >= K.MIN_LOADED_VOTES)


def dim_date(staged: DataFrame) -> DataFrame:
    """Release years with their decade."""
    years = loadable(staged).filter("year > 0").select(F.col("year").alias("date_key")).distinct()
    return years.select(
        "date_key",
        F.col("date_key").alias("release_year"),
        decade_label(F.col("date_key")).alias("decade"),
    )


def dim_macroeconomics(macro: DataFrame) -> DataFrame:
    """Rates per year; rows of one year differ in their event only."""
    return keep_first(macro, "year", "seq").select(
        "year",
        F.col("gdp_growth").alias("gdp_growth_rate"),
        "unemployment_rate",
        "inflation_rate",
    )


def dim_events(macro: DataFrame) -> DataFrame:
    """The first event of every year, by source order."""
    return keep_first(macro, "year", "seq").select(
        F.col("year").alias("event_year"),
        F.coalesce("event_name", F.lit(K.NO_EVENT_NAME)).alias("event_name"),
        F.coalesce("event_type", F.lit(K.NO_EVENT_NAME)).alias("event_type"),
    )


def dim_movies(staged: DataFrame) -> DataFrame:
    """One row per film id, the first by source order; the id is the key."""
    first = keep_first(
        loadable(staged).select("seq", "id", "title", "genres", "runtime", "overview"),
        "id",
        "seq",
        "runtime",
    )
    return first.select(
        F.col("id").alias("movie_key"),
        F.col("id").alias("movie_id"),
        "title",
        F.col("genres").alias("genre"),
        "runtime",
        F.coalesce("overview", F.lit("")).alias("overview"),
    )


def popularity(rating: Column, votes: Column, mean_rating: Column) -> Column:
    """Rating drawn towards the mean, the more so the fewer the votes."""
    prior = F.lit(float(K.POPULARITY_VOTES))
    weighted = votes / (votes + prior) * rating + prior / (votes + prior) * mean_rating
    return F.when(votes + prior > 0, round_half_even(weighted, 3)).otherwise(F.lit(0.0))


def fact_box_office(staged: DataFrame, movies: DataFrame) -> DataFrame:
    """One row per loadable film whose year and film key are known."""
    films = loadable(staged)
    mean_rating = films.agg(F.avg("imdb_rating")).scalar()
    budget = F.coalesce(F.col("budget"), F.lit(0)).cast("double")
    revenue = F.coalesce(F.col("revenue"), F.lit(0)).cast("double")
    rating = F.coalesce(F.col("imdb_rating"), F.lit(0.0))
    return (
        films.filter("year > 0")
        .join(movies.select("movie_key", F.col("movie_id").alias("id")), "id")
        .select(
            "movie_key",
            F.col("year").alias("date_key"),
            budget.cast("bigint").alias("budget"),
            revenue.cast("bigint").alias("revenue"),
            F.when(budget > 0, (revenue - budget) / budget).otherwise(F.lit(0.0)).alias("roi"),
            rating.alias("vote_average"),
            F.col("imdb_votes").cast("int").alias("vote_count"),
            popularity(rating, F.col("imdb_votes").cast("double"), mean_rating).alias("popularity"),
        )
    )


def load_counters(staged: DataFrame, movies: DataFrame) -> DataFrame:
    """Fact rows inserted and staged rows skipped.

    Films are counted per id before the key lookup, so the join sees every id
    once however many rows it has.
    """
    per_id = (
        loadable(staged)
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("films"), F.count_if(F.col("year") > 0).alias("dated"))
    )
    keys = movies.select(F.col("movie_id").alias("id"), "movie_key")
    inserted = F.sum(F.when(F.col("movie_key").isNotNull(), F.col("dated")).otherwise(0))
    return per_id.join(keys, "id", "left").agg(
        F.coalesce(inserted, F.lit(0)).alias("inserted"),
        (F.coalesce(F.sum("films"), F.lit(0)) - F.coalesce(inserted, F.lit(0))).alias("skipped"),
    )


def load_star(staged: DataFrame, macro: DataFrame) -> Star:
    """All five tables, lazily. Several of them read ``staged``: store it first."""
    movies = dim_movies(staged)
    return Star(
        fact=fact_box_office(staged, movies),
        movies=movies,
        dates=dim_date(staged),
        macro=dim_macroeconomics(macro),
        events=dim_events(macro),
    )


_MOVIES = TABLES["movies"][0]


def append_movies(spark: SparkSession, path: str, staged: DataFrame) -> commits.Version:
    """Adds the films that a stored dimension lacks, under generated keys.

    Keys go on without gaps after the greatest stored one, in the order of the film ids; a
    film that is there keeps its key and its row. An unknown id is one film. A load that comes
    second looks again at what the first has added, so no key is given twice.
    """
    films = dim_movies(staged).drop("movie_key")

    def make(base: commits.Version) -> commits.Change | None:
        there = commits.read_rows(spark, path, _MOVIES, schemas.DIM_MOVIES, base)
        greatest = there.agg(F.coalesce(F.max("movie_key"), F.lit(0)))
        new = only_new(films, there, "movie_id")
        keyed = numbered(new, ["movie_id"], "movie_key", after=greatest)
        load = commits.write_rows(keyed.select(*schemas.DIM_MOVIES.fieldNames()), path, _MOVIES)
        notes = {"added": str(load.rows)}
        return ({_MOVIES: [*base.folders(_MOVIES), *load.folders]}, notes) if load.rows else None

    return commits.retried(spark, path, make)


def load_increment(
    spark: SparkSession, path: str, staged: DataFrame, macro: DataFrame
) -> Reload:
    """Brings a stored star with generated film keys to the state of the staged films.

    New films are added first, then the fact looks up its keys and the years that changed are
    written again. Hand in a stored ``staged``: it is read several times.
    """
    append_movies(spark, path, staged)
    movies = commits.read_rows(spark, path, _MOVIES, schemas.DIM_MOVIES)
    star = load_star(staged, macro)
    fact = sinks.hand_off(fact_box_office(staged, movies), "fact")
    return reload_star(
        spark,
        path,
        Star(fact, movies, star.dates, star.macro, star.events),
        untouched=("movies",),
    )
