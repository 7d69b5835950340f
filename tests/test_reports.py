from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eraframe import REPORTS, describe_reports, run_report
from eraframe.plans import dashboard, reports
from eraframe.plans.catalog import applies_era
from eraframe.sources import testdata
from tests.conftest import SMALL, tuples

CALM = [(y, 1.0, 5.0, 2.0) for y in range(1990, 2025)]


@pytest.fixture(scope="module")
def star(spark):
    return testdata.star(spark, SMALL, overviews=True)


def test_shares_add_up(star):
    index = reports.escapism_index(star)
    sums = index.groupBy("release_year").agg(
        F.sum("market_share_pct").alias("s"), F.count("*").alias("n"),
        F.sum("total_revenue").alias("r"), F.max("year_total_revenue").alias("t"),
    )
    for row in sums.collect():
        assert abs(row["s"] - 100) <= 0.01 * row["n"] and row["r"] == row["t"]


@pytest.mark.parametrize(
    "name", ["industry_baseline_trends", "production_density", "crisis_timeline_overlay"]
)
def test_eras_split_the_years(star, name):
    crisis, stable, every = (set(tuples(run_report(name, star, era))) for era in ("Crisis", "Stable", "All"))
    assert crisis | stable == every and not crisis & stable and crisis and stable


def test_unknown_era_means_all_years(star):
    assert tuples(run_report("gdp_vs_movie_revenue", star, "crisis")) == tuples(
        run_report("gdp_vs_movie_revenue", star)
    )


def test_reports_without_era_ignore_it(star):
    assert sum(map(applies_era, REPORTS)) == 10
    assert tuples(run_report("financial_kpis", star, "Crisis")) == tuples(run_report("financial_kpis", star))


def test_tiers_split_the_films(star):
    films = star.fact.filter("budget > 0 AND revenue > 0").count()
    split = reports.profitability_split(star)
    assert split.agg(F.sum("movie_count")).collect()[0][0] == films
    assert reports.budget_dilemma(star).agg(F.sum("film_count")).collect()[0][0] == films


FILM_DIMENSION_REPORTS = [
    "genre_baselines", "escapism_index", "comedy_paradox", "runtime_paradox", "decade_genre_share",
    "comedy_horror_paradox", "genre_performance_summary",
]


@pytest.fixture(scope="module")
def broadcast_results(star):
    return {name: tuples(run_report(name, star)) for name in FILM_DIMENSION_REPORTS}


@pytest.mark.parametrize("name", FILM_DIMENSION_REPORTS)
def test_same_result_without_broadcast(star, broadcast_results, no_auto_broadcast, name):
    assert tuples(run_report(name, star)) == broadcast_results[name]


def test_one_film_with_a_third_of_the_rows(spark, make_star, no_auto_broadcast):
    facts = [{"movie_key": i, "date_key": 2000 + i % 3, "revenue": 10 + i} for i in range(400)]
    facts += [{"movie_key": 0, "date_key": 2001, "revenue": 7}] * 200
    movies = [{"movie_key": i, "genre": "Comedy, X" if i % 2 else "Drama"} for i in range(400)]
    star = make_star(facts, movies, CALM)
    expected: dict = {}
    for f in facts:
        key = (f["date_key"], "Comedy" if f["movie_key"] % 2 else "Drama")
        expected[key] = expected.get(key, 0) + f["revenue"]
    rows = reports.escapism_index(star).collect()
    assert {(r["release_year"], r["genre"]): r["total_revenue"] for r in rows} == expected


def test_totals_beyond_bigint_fail(make_star):
    huge = 4_000_000_000_000_000_000
    facts = [{"movie_key": i, "budget": huge // 2, "revenue": huge} for i in range(5)]
    with pytest.raises(Exception, match="OVERFLOW"):
        reports.industry_baseline_trends(make_star(facts, macro=CALM)).collect()


def test_years_outside_of_any_calendar(make_star):
    """Years 0 and 10000 have an economy and events like others."""
    facts = [{"movie_key": i, "date_key": year} for i, year in enumerate((0, 10000, 2000))]
    macro = [
        {"year": y, "gdp_growth_rate": g, "unemployment_rate": 5.0, "inflation_rate": 2.0}
        for y, g in ((0, -1.0), (10000, 1.0), (2000, 1.0))
    ]
    events = [
        {"event_year": 0, "event_name": "Flood", "event_type": "Disaster"},
        {"event_year": 10000, "event_name": "Bug", "event_type": "Disaster"},
    ]
    star = make_star(facts, macro=macro, events=events)
    trends = reports.industry_baseline_trends(star).collect()
    assert [(r["release_year"], r["era_type"]) for r in trends] == [
        (0, "Crisis"), (2000, "Stable"), (10000, "Stable"),
    ]
    shown = reports.crisis_timeline_overlay(star, "Stable").collect()
    assert [(r["release_year"], r["historical_event"]) for r in shown][-1] == (10000, "Bug")
    assert 0 not in {r["release_year"] for r in shown}
    assert {r["decade"] for r in reports.decade_genre_share(star).collect()} >= {"0s", "10000s"}


def test_top_lists_skip_releases_without_a_film(make_star):
    facts = [
        {"movie_key": 1, "revenue": 900, "vote_average": 9.0},
        {"movie_key": 2, "revenue": 500, "vote_average": 5.0},
    ]
    star = make_star(facts, movies=[{"movie_key": 2}], macro=CALM)
    assert [r["revenue"] for r in reports.top_blockbusters(star, 1).collect()] == [500]
    assert [r["revenue"] for r in reports.top_movies_by_rating(star, n=1).collect()] == [500]


def test_top_genres_with_a_null_and_a_genre_called_other(spark):
    shares = spark.createDataFrame(
        [("1990s", "A", 60.0), ("1990s", "Other", 30.0), ("1990s", "C", 10.0), ("2000s", None, 99.0)],
        "decade string, genre string, genre_share_pct double",
    )
    got = {(r["decade"], r["label"]): r["share_pct"] for r in dashboard.top_genres_other(shares, 2).collect()}
    assert got == {
        ("1990s", "A"): 60.0, ("1990s", None): 0.0, ("1990s", "Other"): 40.0,
        ("2000s", "A"): 0.0, ("2000s", None): 99.0, ("2000s", "Other"): 0.0,
    }
    matrix = dashboard.decade_genre_matrix(shares, 3).collect()
    assert [r.asDict() for r in matrix] == [
        {"decade": "1990s", "null": 0.0, "A": 60.0, "Other": 40.0},
        {"decade": "2000s", "null": 99.0, "A": 0.0, "Other": 0.0},
    ]


def test_moving_means_span_rows_not_years(make_star):
    facts = [
        {"movie_key": i, "date_key": y, "revenue": r, "vote_average": v}
        for i, (y, r, v) in enumerate([(2000, 10, 1.0), (2005, 20, 2.0), (2010, 60, 6.0)])
    ]
    movies = [{"movie_key": i, "genre": "Comedy", "runtime": 10 * (i + 1)} for i in range(3)]
    rows = reports.comedy_paradox(make_star(facts, movies, CALM)).collect()
    assert [(r["ma5_revenue"], r["ma5_rating"]) for r in rows] == [(10.0, 1.0), (15.0, 1.5), (30.0, 3.0)]


def test_runtime_mean_is_weighted_by_films(make_star):
    facts = [{"movie_key": 1, "date_key": 2000}] * 3 + [{"movie_key": 2, "date_key": 2001}]
    movies = [{"movie_key": 1, "runtime": 100}, {"movie_key": 2, "runtime": 200}]
    rows = reports.runtime_paradox(make_star(facts, movies, CALM)).collect()
    assert [r["ma5_runtime_all"] for r in rows] == [100.0, 125.0]


def test_top_films_of_a_year_break_ties_by_key(make_star):
    facts = [{"movie_key": i, "revenue": 50} for i in (3, 1, 2)]
    movies = [{"movie_key": i, "runtime": 100 * i} for i in (1, 2, 3)]
    rows = reports.runtime_paradox(make_star(facts, movies, CALM), top=2).collect()
    assert [r["avg_runtime_top100"] for r in rows] == [150.0]


def test_films_without_runtime_are_left_out(make_star):
    facts = [{"movie_key": 1, "revenue": 900}, {"movie_key": 2}, {"movie_key": 3}]
    movies = [{"movie_key": 1, "runtime": 0}, {"movie_key": 2, "runtime": None}, {"movie_key": 3, "runtime": 80}]
    rows = reports.runtime_paradox(make_star(facts, movies, CALM)).collect()
    assert [(r["avg_runtime_all"], r["avg_runtime_top100"]) for r in rows] == [(80.0, 80.0)]


def test_small_genres_are_left_out_of_the_baselines_only(make_star):
    facts = [{"movie_key": 1}] * 30 + [{"movie_key": 2}] * 31
    movies = [{"movie_key": 1, "genre": "Small"}, {"movie_key": 2, "genre": "Large, Small"}]
    star = make_star(facts, movies)
    assert [r["genre"] for r in reports.genre_baselines(star).collect()] == ["Large"]
    assert len(reports.genre_performance_summary(star).collect()) == 2


def test_inflation_of_zero_gives_null(make_star):
    star = make_star([{}], macro=[(2000, 1.0, 1.0, 0.0)])
    assert reports.inflation_adjusted_profit(star).collect()[0]["inflation_adjusted_profit"] is None


def test_year_without_macro_stays_in_the_event_overlay_only(make_star):
    star = make_star([{"date_key": 1950}, {"date_key": 2000}], macro=CALM)
    assert [r["release_year"] for r in reports.crisis_timeline_overlay(star, "Stable").collect()] == [1950, 2000]
    assert [r["release_year"] for r in reports.production_density(star).collect()] == [2000]
    overlay = reports.crisis_timeline_overlay(star).collect()[0]
    assert (overlay["historical_event"], overlay["event_category"]) == ("Stable Period", "N/A")


def test_whole_means_are_cut(make_star):
    star = make_star([{"revenue": 3}, {"revenue": 4}], macro=CALM)
    assert reports.gdp_vs_movie_revenue(star).collect()[0]["avg_movie_revenue"] == 3


def test_film_rows_sort_or_not(star):
    ordered = tuples(reports.budget_vs_revenue(star))
    assert [(-r[0], -r[3]) for r in ordered] == sorted((-r[0], -r[3]) for r in ordered)
    assert sorted(map(str, ordered)) == sorted(map(str, tuples(reports.budget_vs_revenue(star, ordered=False))))


def test_runtime_premium_needs_both_means(spark):
    df = spark.createDataFrame(
        [(2000, 100.0, 110.5), (2001, 0.0, 5.0), (2002, None, 5.0), (2003, 5.0, None)],
        "release_year int, ma5_runtime_all double, ma5_runtime_top100 double",
    )
    assert [r["runtime_premium"] for r in dashboard.runtime_premium(df).collect()] == [10.5, None, None, None]


def test_top_genres_fill_missing_decades(spark):
    shares = spark.createDataFrame(
        [("1990s", "A", 60.0), ("1990s", "B", 30.0), ("1990s", "C", 10.0), ("2000s", "A", 100.0)],
        "decade string, genre string, genre_share_pct double",
    )
    assert tuples(dashboard.top_genres_other(shares, 2)) == [
        ("1990s", "A", 60.0), ("1990s", "B", 30.0), ("1990s", "Other", 10.0),
        ("2000s", "A", 100.0), ("2000s", "B", 0.0), ("2000s", "Other", 0.0),
    ]
    wide = dashboard.decade_genre_matrix(shares, 2)
    assert wide.columns == ["decade", "A", "B", "Other"]
    assert tuples(wide) == [("1990s", 60.0, 30.0, 10.0), ("2000s", 100.0, 0.0, 0.0)]


def test_escapism_pivot_takes_the_first_year(spark):
    index = spark.createDataFrame(
        [(2001, "A", "Stable", 7.0), (2000, "A", "Stable", 5.0), (2002, "A", "Crisis", 9.0), (2003, "B", "Crisis", 1.0)],
        "release_year int, genre string, era_type string, market_share_pct double",
    )
    assert tuples(dashboard.escapism_pivot(index)) == [("A", 5.0, 9.0), ("B", 0.0, 1.0)]


def test_executive_kpis_of_nothing(star):
    empty = reports.industry_baseline_trends(star).limit(0)
    assert tuples(dashboard.executive_kpis(empty)) == [(0, 0, 0, 0, 0.0)]


def test_catalog(spark):
    rows = describe_reports(spark).collect()
    assert len(rows) == 22 and all(r["description"] for r in rows)


def test_top_genres_are_cut_without_a_window_over_all_rows(spark):
    shares = spark.createDataFrame(
        [(1980, "A", 5.0), (1980, None, 9.0), (1990, "B", 7.0)],
        "decade int, genre string, genre_share_pct double",
    )
    top = dashboard.top_genres_other(shares, 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "dense_rank" not in plan and "TakeOrderedAndProject" in plan
    got = {(r["decade"], r["label"]): r["share_pct"] for r in top.collect()}
    assert got[1980, None] == 9.0 and got[1990, "B"] == 7.0 and got[1980, "Other"] == 5.0


def test_genre_called_null_is_added_to_no_genre(spark):
    shares = spark.createDataFrame(
        [("1990s", None, 40.0), ("1990s", "null", 30.0), ("1990s", "Drama", 20.0)],
        "decade string, genre string, genre_share_pct double",
    )
    row = dashboard.decade_genre_matrix(shares, k=3).first()
    assert (row["null"], row["Drama"], row["Other"]) == (70.0, 20.0, 0.0)
