from __future__ import annotations

import pytest

from eraframe.plans import load
from eraframe.plans.stage import movie_titles, stage_films
from tests.conftest import tuples

FILMS = (
    "seq int, id bigint, imdb_id_cleaned bigint, title string, year int, budget double, "
    "revenue double, runtime double, vote_average double, vote_count bigint, overview string, genres string"
)
STAGED = (
    "seq int, id bigint, title string, year int, budget bigint, revenue bigint, runtime int, "
    "overview string, genres string, imdb_rating double, imdb_votes bigint"
)


def _titles(spark, basics, ratings):
    return movie_titles(
        spark.createDataFrame(basics, "tconst string, titleType string, runtimeMinutes string"),
        spark.createDataFrame(ratings, "tconst string, averageRating string, numVotes string"),
    )


def test_titles_keep_rated_movies_only(spark):
    titles = _titles(
        spark,
        [("tt1", " movie ", "90"), ("tt2", "tvSeries", "20"), ("tt3", "movie", None), ("x", "movie", "1")],
        [("tt1", "7.5", "100"), ("tt2", "8", "50"), ("'tt3'", None, "n/a"), ("tt9", "1", "1")],
    )
    assert sorted(tuples(titles)) == [(1, "90", 7.5, 100), (3, None, None, None)]


def test_staging_rounds_fills_and_filters(spark):
    films = spark.createDataFrame(
        [
            (1, 1, 1, "a", 2000, 2.5, 3.5, None, 5.0, 9, "o", "g"),
            (2, 2, 2, "b", 2000, None, 0.5, None, 5.0, 9, None, "g"),
            (3, 3, 3, "c", 2000, 1.5, 1.0, 99.5, 5.0, 9, None, "g"),
            (4, 4, None, "d", 2000, 1.5, 1.0, 99.5, 5.0, 9, None, "g"),
            (5, 5, 5, "e", 2000, 1.0, 1.0, 1.0, 5.0, 9, None, "g"),
        ],
        FILMS,
    )
    titles = _titles(
        spark,
        [("tt1", "movie", "90.5"), ("tt3", "movie", "10"), ("tt5", "movie", "10")],
        [("tt1", "7", "10"), ("tt3", "7", None), ("tt5", "7", "9")],
    )
    staged = {r["id"]: r for r in stage_films(films, titles).collect()}
    assert sorted(staged) == [1, 2, 3]
    assert [(r["budget"], r["revenue"], r["runtime"]) for _, r in sorted(staged.items())] == [
        (2, 4, 90), (0, 0, 120), (2, 1, 100),
    ]
    assert staged[1]["tmdb_rating"] == 5.0 and staged[1]["imdb_votes"] == 10
    assert staged[2]["imdb_votes"] is None


@pytest.fixture(scope="module")
def staged(spark):
    return spark.createDataFrame(
        [
            (2, 7, "second", 1999, 10, 30, 100, None, "G", 8.0, 3000),
            (1, 7, "first", 1998, 0, 30, 90, None, "G", None, 1000),
            (3, 8, "low", 1999, 10, 30, 100, "o", "G", 1.0, 999),
            (4, 9, "undated", None, 10, 30, 100, "o", "G", 6.0, 1000),
            (5, 5, "no votes", 1999, 10, 30, 100, "o", "G", 1.0, None),
        ],
        STAGED,
    )


def test_dimensions_keep_the_first_film(staged):
    movies = load.dim_movies(staged)
    assert sorted(tuples(movies)) == [
        (7, 7, "first", "G", 90, ""), (9, 9, "undated", "G", 100, "o"),
    ]
    assert sorted(tuples(load.dim_date(staged))) == [(1998, 1998, "1990s"), (1999, 1999, "1990s")]


def test_fact_rows(staged):
    fact = load.fact_box_office(staged, load.dim_movies(staged))
    # The mean rating covers all loadable films, the undated one included: (8 + 6) / 2.
    assert sorted(tuples(fact)) == [
        (7, 1998, 0, 30, 0.0, 0.0, 1000, 3.5),
        (7, 1999, 10, 30, 2.0, 8.0, 3000, 7.75),
    ]


def test_counters(staged):
    movies = load.dim_movies(staged)
    assert tuples(load.load_counters(staged, movies)) == [(2, 1)]
    assert tuples(load.load_counters(staged, movies.filter("movie_id = 9"))) == [(0, 3)]
    assert tuples(load.load_counters(staged.limit(0), movies)) == [(0, 0)]
