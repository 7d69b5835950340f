from __future__ import annotations

import inspect
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from eraframe import run_report
from eraframe.plans import partials, reports
from eraframe.sources import testdata
from tests.conftest import SMALL, tuples


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    derived = testdata.star(spark, SMALL)
    dates = spark.createDataFrame(derived.dates.collect(), derived.dates.schema)
    return replace(derived, dates=dates)


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    """Partials of three loads, added one after the other."""
    path = str(tmp_path_factory.mktemp("partials"))
    for third in range(3):
        part = F.pmod("movie_key", F.lit(3)) == third
        load = replace(star, fact=star.fact.filter(part))
        partials.add_partials(spark, path, partials.build_partials(load))
    return partials.read_partials(spark, path, star)


def _over_star(name: str, star, era: str):
    if name == "vote_statistics":
        return reports.vote_statistics(star.fact)
    return run_report(name, star, era)


@pytest.mark.parametrize("name", partials.REPORTS)
def test_stored_partials_give_the_reports(star, stored, name):
    report = partials.REPORTS[name]
    eras = ("All", "Stable") if "era" in inspect.signature(report).parameters else ("All",)
    for era in eras:
        got = report(stored, era) if era != "All" else report(stored)
        wanted = _over_star(name, star, era)
        assert got.columns == wanted.columns
        rows, expected = tuples(got), tuples(wanted)
        if name == "genre_performance_summary":  # has no order
            rows, expected = sorted(rows, key=repr), sorted(expected, key=repr)
        # Sums of parts may differ in the last bits.
        for own, other in zip(rows, expected, strict=True):
            assert own == pytest.approx(other)


@pytest.mark.parametrize("name", partials.REPORTS)
def test_reports_scan_no_fact(stored, name):
    plan = _plan(partials.REPORTS[name](stored))
    assert "l_partkey" not in plan and "movie_id" not in plan


def test_odd_releases(make_star):
    """Null, zero and negative money, films without genre or runtime, years without macro row."""
    facts = [
        {"movie_key": 1, "date_key": 2000, "budget": None, "revenue": 5, "roi": None},
        {"movie_key": 2, "date_key": 2000, "budget": 0, "revenue": None, "vote_average": None},
        {"movie_key": 3, "date_key": 2001, "budget": 7, "revenue": -1, "vote_count": 0},
        {"movie_key": 4, "date_key": 2001, "budget": 7, "revenue": 9, "popularity": None},
        {"movie_key": 4, "date_key": 2001, "budget": 7, "revenue": 9},
        {"movie_key": 9, "date_key": 1999, "budget": 7, "revenue": 9},
    ]
    films = [
        {"movie_key": 1, "genre": None}, {"movie_key": 2, "genre": "Horror", "runtime": 0},
        {"movie_key": 3, "genre": "Comedy, Drama"}, {"movie_key": 4, "genre": "", "runtime": None},
    ]
    macro = [
        {"year": y, "gdp_growth_rate": None, "unemployment_rate": 9.0, "inflation_rate": 0.0}
        for y in (2000, 2001)
    ]
    star = make_star(facts, films, macro)
    built = partials.build_partials(star)
    for name, report in partials.REPORTS.items():
        got, wanted = tuples(report(built)), tuples(_over_star(name, star, "All"))
        assert sorted(got, key=repr) == sorted(wanted, key=repr), name


def test_empty_star(make_star):
    star = make_star([{"date_key": 2000}])
    none = partials.build_partials(replace(star, fact=star.fact.limit(0)))
    assert partials.industry_baseline_trends(none).collect() == []
    assert partials.genre_baselines(none).collect() == []
