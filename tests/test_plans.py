"""The plans are the intended ones."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest

from eraframe import read_star, run_report, write_star
from eraframe.operators.series import with_share_of_large
from eraframe.plans import reports
from eraframe.sources import testdata
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    write_star(testdata.star(spark, SMALL, overviews=True), path)
    return read_star(spark, path)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ALL = [
    "industry_baseline_trends", "escapism_index", "comedy_paradox", "runtime_paradox",
    "rating_kpis", "sentiment_corpus", "top_movies_by_rating", "comedy_horror_paradox",
]


@pytest.mark.parametrize("name", ALL)
def test_no_nested_loops(stored, no_auto_broadcast, name):
    plan = _plan(run_report(name, stored, "Stable"))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(stored):
    plan = _plan(run_report("gdp_vs_movie_revenue", stored))
    assert "GreaterThan(revenue,0)" in plan
    assert "ReadSchema: struct<movie_key:bigint,budget:bigint,revenue:bigint>" in plan


def test_crisis_years_prune_fact_partitions(stored):
    plan = _plan(run_report("industry_baseline_trends", stored, "Crisis"))
    assert "dynamicpruning" in plan


def test_top_lists_gather_a_few_rows(stored):
    plan = _plan(run_report("top_blockbusters", stored))
    assert "TakeOrderedAndProject(limit=10" in plan


def test_yearly_ranks_are_limited_before_the_shuffle(stored, no_auto_broadcast):
    plan = _plan(run_report("runtime_paradox", stored))
    assert "row_number(), 100, Partial" in plan


@pytest.mark.parametrize("name", ["genre_baselines", "escapism_index", "comedy_horror_paradox"])
def test_large_film_dimension_shuffles_the_fact_once(stored, no_auto_broadcast, name):
    plan = _plan(run_report(name, stored))
    assert "HashAggregate(keys=[movie_key" not in plan and "SortMergeJoin [movie_key" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(movie_key", plan)) == 2  # fact and films


def test_small_film_dimension_is_broadcast(stored):
    plan = _plan(run_report("genre_baselines", stored))
    assert "BroadcastHashJoin [movie_key" in plan and "HashAggregate(keys=[movie_key" not in plan


def test_rating_statistics_run_once(stored):
    rows = run_report("rating_kpis", stored, ordered=False)
    assert _plan(rows).count("Subquery subquery") == 2  # the column and its plan


def test_rating_statistics_count_the_votes_once(stored):
    statistics = reports.vote_statistics(stored.fact)
    statistics.collect()
    assert "ReusedExchange" in _plan(statistics)


@pytest.fixture
def small_skew_limits(spark, no_auto_broadcast):
    """Limits at which a test-sized partition counts as skewed."""
    limits = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key) for key in limits}
    for key, value in limits.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_join_of_a_hot_film_is_split(spark, tmp_path, small_skew_limits):
    star = testdata.star(spark, SMALL)
    hot = star.fact.selectExpr("CAST(7 AS BIGINT) AS movie_key", "* EXCEPT (movie_key)")
    write_star(replace(star, fact=star.fact.unionByName(hot)), str(tmp_path))
    stored = read_star(spark, str(tmp_path))
    rows = run_report("macro_impact_data", stored, ordered=False)
    assert len(rows.collect()) == 2 * star.fact.count()
    assert "skew=true" in _plan(rows)


@pytest.mark.parametrize("name", ["comedy_paradox", "comedy_horror_paradox"])
def test_wanted_films_filter_the_fact_before_its_shuffle(spark, stored, no_auto_broadcast, name):
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    spark.conf.set(key, "0")
    try:
        plan = _plan(run_report(name, stored))
    finally:
        spark.conf.unset(key)
    fact = [line for line in plan.splitlines() if "might_contain" in line]
    assert len(fact) == 1 and "movie_key" in fact[0]


def test_corpus_sorts_a_text_once_per_film_and_year(spark, make_star, no_auto_broadcast):
    facts = [
        {"movie_key": key, "date_key": year, "revenue": n}
        for key, year, copies in ((1, 2000, 2500), (1, 2001, 1), (2, 2000, 1024))
        for n in range(copies)
    ]
    films = [{"movie_key": key, "overview": f"{key} {'word ' * 20}"} for key in (1, 2)]
    macro = [{"year": y, "gdp_growth_rate": 1.0, "unemployment_rate": 5.0, "inflation_rate": 2.0} for y in (2000, 2001)]
    corpus = run_report("sentiment_corpus", make_star(facts, films, macro))
    sort = corpus._jdf.queryExecution().optimizedPlan().toString().split("Sort [", 1)
    assert "Generate explode" in sort[0] and "Aggregate [movie_key" in sort[1]
    rows = [(r.release_year, r.movie_id, r.overview[0]) for r in corpus.collect()]
    assert rows == [(2000, 1, "1")] * 2500 + [(2000, 2, "2")] * 1024 + [(2001, 1, "1")]


@pytest.fixture
def whole_partitions(spark):
    """Small partitions stay apart, so that the order over tasks shows."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def _releases(film: int, year: int) -> int:
    """Film 3 outgrows a row of the corpus in one year and has none in another."""
    if film == 3:
        return {2001: 0, 2002: 2500}.get(year, 1)
    return (film + year) % 4


@pytest.mark.parametrize("stores", [True, False])
def test_corpus_moves_a_text_once_for_all_years(
    spark, make_star, no_auto_broadcast, whole_partitions, monkeypatch, stores
):
    if not stores:
        monkeypatch.setattr(reports.sinks, "shared_folder", lambda spark: None)
    years, keys = range(2000, 2006), range(60)
    facts = [
        {"movie_key": key, "date_key": year, "revenue": n}
        for key in keys
        for year in years
        for n in range(_releases(key, year))
    ]
    films = [{"movie_key": key, "overview": f"{key} {'word ' * (key % 20 + 1)}"} for key in keys]
    macro = [
        {"year": y, "gdp_growth_rate": y - 2001.0, "unemployment_rate": 5.0, "inflation_rate": 2.0} for y in years[1:]
    ]
    star = make_star(facts, films, macro)
    # A year that the calendar has twice brings its releases twice.
    star = replace(star, dates=star.dates.union(star.dates.filter("date_key = 2004")))
    expected = [
        (year, key, year - 2001.0, "Crisis" if year < 2001 else "Stable")
        for year in years[1:]
        for key in keys
        for _ in range(_releases(key, year) * (2 if year == 2004 else 1))
        if len(films[key]["overview"].rstrip()) > 50
    ]
    corpus = run_report("sentiment_corpus", star)
    rows = corpus.collect()
    assert [(r.release_year, r.movie_id, r.gdp_growth_rate, r.era_type) for r in rows] == expected
    assert all(r.overview == films[r.movie_id]["overview"] and r.title == f"film {r.movie_id}" for r in rows)
    final = _plan(corpus).split("== Initial Plan ==")[0]
    ranges = [line for line in final.splitlines() if "Exchange rangepartitioning" in line and "ReusedExchange" not in line]
    assert len(ranges) == 1 and "movie_key" in ranges[0]
    assert final.count("ReusedExchange") >= len(years) - 2
    unordered = run_report("sentiment_corpus", star, ordered=False).collect()
    assert sorted(map(tuple, unordered)) == sorted(map(tuple, rows))


def test_corpus_meets_the_calendar_without_texts(stored, no_auto_broadcast):
    """Texts moved by year would pile up in as many tasks as there are years."""
    plan = _plan(run_report("sentiment_corpus", stored, ordered=False))
    assert "BroadcastHashJoin [release_year" in plan and "SortMergeJoin [movie_key" in plan


def _shares(spark, rows: int):
    """A hot group with most of the rows, and two others; one group is null."""
    df = spark.range(rows).selectExpr(
        "IF(id % 50 = 0, NULL, IF(id % 50 = 1, 1990, 2000)) AS year",
        "CONCAT('genre ', id) AS genre",
        "id % 7 AS revenue",
    )
    return with_share_of_large(df, ["year"], "revenue", "total", "share")


@pytest.mark.parametrize("name", ["escapism_index", "decade_genre_share"])
def test_shares_of_many_genres_need_no_window(stored, name):
    rows = run_report(name, stored, many_genres=True)
    assert rows.collect() == run_report(name, stored).collect()
    assert "Window" not in _plan(rows) and "ReusedExchange" in _plan(rows)


def test_share_of_a_hot_group_is_split(spark, small_skew_limits):
    rows = _shares(spark, 60_000)
    got = rows.collect()
    assert "skew=true" in _plan(rows) and "Window" not in _plan(rows)
    want = {}
    for i in range(60_000):
        year = {0: None, 1: 1990}.get(i % 50, 2000)
        want[year] = want.get(year, 0) + i % 7
    assert len(got) == 60_000
    assert all(r.total == want[r.year] for r in got)
