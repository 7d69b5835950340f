from __future__ import annotations

from dataclasses import replace

import pytest

from eraframe import read_star, schemas
from eraframe.plans import checks, quarantine, reports
from eraframe.sources import commits, testdata
from eraframe.sources.star import read_bucketed_star, write_bucketed_star
from tests.conftest import SMALL, tuples


@pytest.fixture(scope="module")
def odd_star(make_star):
    star = make_star(
        [
            {"movie_key": 1, "date_key": 2000}, {"movie_key": 1, "date_key": 2000},
            {"movie_key": 5, "date_key": 2000}, {"movie_key": 1, "date_key": 1800},
            {"movie_key": None, "date_key": 2000}, {"movie_key": 2, "date_key": None},
            {"movie_key": 3, "date_key": 2000}, {"movie_key": 5, "date_key": 1800},
        ],
        [{"movie_key": 1}, {"movie_key": 2}, {"movie_key": 3, "title": None}],
        [{"year": 2000, "gdp_growth_rate": 1.0, "unemployment_rate": 1.0, "inflation_rate": 1.0}],
        [{"event_year": 2000, "event_name": "a", "event_type": "b"}] * 2,
    )
    return replace(star, dates=star.dates.filter("date_key = 2000"))


def test_rows_are_dealt_by_what_they_break(spark, tmp_path, odd_star):
    path = str(tmp_path)
    version = quarantine.load_checked(spark, path, odd_star)
    stored = read_star(spark, path)
    assert sorted(tuples(stored.fact.select("movie_key", "date_key"))) == [(1, 2000), (1, 2000)]
    rejected = quarantine.read_rejected(spark, path, "fact").collect()
    years = [f"date_key not in {t}" for t in ("dim_date", "dim_macroeconomics", "dim_geopolitical_events")]
    assert {(r["movie_key"], r["date_key"]): r["reasons"] for r in rejected} == {
        (5, 2000): ["movie_key not in dim_movies"],
        (1, 1800): years,
        (None, 2000): ["movie_key is null"],
        (2, None): ["date_key is null"],
        (3, 2000): ["movie_key not in dim_movies"],
        (5, 1800): ["movie_key not in dim_movies", *years],
    }
    films = quarantine.read_rejected(spark, path, "movies").collect()
    assert [(r["movie_key"], r["reasons"]) for r in films] == [(3, ["title is null"])]
    events = quarantine.read_rejected(spark, path, "events").collect()
    assert [r["reasons"] for r in events] == [["event_year repeated"]]
    assert version.number == 1 and version.notes["fact_box_office"] == "8"


def test_what_is_let_in_breaks_nothing(spark, tmp_path, odd_star):
    quarantine.load_checked(spark, str(tmp_path), odd_star)
    stored = read_star(spark, str(tmp_path))
    assert checks.repeated_keys(stored).collect() == []
    assert checks.broken_references(stored).collect() == []
    assert {r["nulls"] for r in checks.missing_values(stored).collect()} == {0}


def test_nothing_rejected_and_nothing_there(spark, tmp_path, make_star):
    star = make_star([{"date_key": 2000}])
    empty = replace(star, fact=star.fact.limit(0))
    quarantine.load_checked(spark, str(tmp_path), empty)
    assert read_star(spark, str(tmp_path)).fact.collect() == []
    assert quarantine.read_rejected(spark, str(tmp_path), "fact").collect() == []
    assert commits.read_rows(spark, str(tmp_path), "dim_movies", schemas.DIM_MOVIES).count() == 1


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bucketed"))
    write_bucketed_star(testdata.star(spark, SMALL), "bucketed_star", path, buckets=4)
    return read_bucketed_star(spark, "bucketed_star")


@pytest.mark.parametrize("name", ["genre_baselines", "comedy_horror_paradox", "budget_vs_revenue"])
def test_bucketed_star_joins_films_without_a_shuffle(spark, bucketed, no_auto_broadcast, name):
    report = getattr(reports, name)(bucketed)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [movie_key" in plan
    assert "hashpartitioning(movie_key" not in plan
    wanted = getattr(reports, name)(testdata.star(spark, SMALL))
    assert sorted(tuples(report)) == sorted(tuples(wanted))


def test_bloom_filter_of_the_wanted_films(spark, tmp_path, no_auto_broadcast):
    """Where the fact is shuffled, it is filtered by a sketch of the wanted films first."""
    limits = {
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100MB",
    }
    from eraframe import write_star

    write_star(testdata.star(spark, SMALL), str(tmp_path))
    stored = read_star(spark, str(tmp_path))
    before = {key: spark.conf.get(key) for key in limits}
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        for report in (reports.comedy_paradox, reports.comedy_horror_paradox):
            plan = report(stored)._jdf.queryExecution().optimizedPlan().toString()
            assert "might_contain" in plan, report.__name__
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
