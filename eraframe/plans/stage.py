"""Integration of cleaned films with title runtimes and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraframe import constants as K
from eraframe.functions.rounding import round_half_even
from eraframe.functions.text import imdb_number, strip_blanks


def movie_titles(basics: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rated titles of type movie: id, runtime text, rating and votes."""
    movies = basics.filter(strip_blanks(F.col("titleType")) == "movie").select(
        imdb_number(F.col("tconst")).alias("imdb_id_cleaned"), "runtimeMinutes"
    )
    rated = ratings.select(
        imdb_number(F.col("tconst")).alias("imdb_id_cleaned"),
        F.col("averageRating").try_cast("double").alias("averageRating"),
        F.col("numVotes").try_cast("bigint").alias("numVotes"),
    )
    return movies.join(rated, "imdb_id_cleaned")


def _whole(value: Column, default: int) -> Column:
    return round_half_even(F.coalesce(value, F.lit(float(default))), 0).cast("bigint")


def stage_films(films: DataFrame, titles: DataFrame) -> DataFrame:
    """Cleaned films with title ratings; unmatched films stay, rarely rated ones go.

    A missing runtime is taken from the title, then from a default.
    """
    runtime = F.coalesce(F.col("runtime"), F.col("runtimeMinutes").try_cast("double"))
    joined = films.filter(F.col("imdb_id_cleaned").isNotNull()).join(
        titles, "imdb_id_cleaned", "left"
    )
    return (
        joined.filter((F.col("numVotes") >= K.MIN_STAGED_VOTES) | F.col("numVotes").isNull())
        .withColumns(
            {
                "id": F.col("id").cast("bigint"),
                "year": F.col("year").cast("int"),
                "budget": _whole(F.col("budget"), 0),
                "revenue": _whole(F.col("revenue"), 0),
                "runtime": _whole(runtime, K.DEFAULT_RUNTIME).cast("int"),
            }
        )
        .drop("runtimeMinutes")
        .withColumnsRenamed(
            {
                "vote_average": "tmdb_rating",
                "vote_count": "tmdb_votes",
                "averageRating": "imdb_rating",
                "numVotes": "imdb_votes",
            }
        )
        .select(
            *[c for c in films.columns if c not in ("vote_average", "vote_count")],
            "tmdb_rating",
            "tmdb_votes",
            "imdb_rating",
            "imdb_votes",
        )
    )
