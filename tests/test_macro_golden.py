from __future__ import annotations

import pytest

from eraframe import constants as K
from eraframe import schemas
from eraframe.operators.era import calendar
from eraframe.plans import dashboard, load, macro, reports
from eraframe.sources import readers
from eraframe.sources.star import Star
from tests import golden
from tests.conftest import tuples


@pytest.fixture(scope="module")
def enriched(spark):
    """Landed series without the unemployment rates before 1991 and with an empty 2025."""
    rows = []
    for year, *rates in [*golden.RATES, (2025, None, None, None)]:
        for name, rate in zip(K.INDICATOR_CODES, rates, strict=True):
            known = rate if name != "unemployment_rate" or year > 1990 else None
            rows.append((K.INDICATOR_CODES[name], year, known))
    series = spark.createDataFrame(rows, schemas.INDICATORS)
    return macro.enrich_macro(series, readers.curated_events(spark))


def _yearly_star(make_star, enriched, years) -> Star:
    star = make_star([{"movie_key": y, "date_key": y} for y in years])
    return Star(
        star.fact, star.movies, star.dates, load.dim_macroeconomics(enriched), load.dim_events(enriched)
    )


def test_rates_are_restored(enriched):
    rows = {r["year"]: r for r in enriched.collect()}
    for year, inflation, growth, unemployment in golden.RATES:
        row = rows[year]
        assert (row["inflation_rate"], row["gdp_growth"], row["unemployment_rate"]) == (
            inflation, growth, unemployment,
        )
    last = rows[2025]
    assert (last["inflation_rate"], last["gdp_growth"], last["unemployment_rate"]) == golden.BENCHMARK


def test_two_events_make_two_rows_and_the_first_is_kept(enriched):
    rows = enriched.filter("year = 2022").orderBy("seq").collect()
    assert [r["event_type"] for r in rows] == ["Economic Crisis", "War"]
    assert enriched.count() == 57
    kept = load.dim_events(enriched).filter("event_year = 2022").collect()
    assert [r["event_type"] for r in kept] == ["Economic Crisis"]
    assert load.dim_macroeconomics(enriched).count() == 56


def test_crisis_years(make_star, enriched):
    rows = calendar(_yearly_star(make_star, enriched, [2000])).collect()
    strict = sorted(r["release_year"] for r in rows if r["era_type"] == "Crisis")
    loose = [r["release_year"] for r in rows if r["economic_climate"] == "Crisis Period"]
    assert strict == golden.STRICT_CRISIS_YEARS
    assert len(loose) == golden.LOOSE_CRISIS_YEAR_COUNT


def test_crisis_blocks(make_star, enriched):
    star = _yearly_star(make_star, enriched, range(1970, 2025))
    assert tuples(dashboard.crisis_blocks(reports.production_density(star))) == golden.CRISIS_BLOCKS
    # With the era filter only crisis rows are left, so they form one run.
    only = reports.production_density(star, "Crisis")
    assert tuples(dashboard.crisis_blocks(only)) == [(1973, 2022)]
    assert tuples(dashboard.crisis_blocks(reports.production_density(star, "Stable"))) == []


def test_streaming_blocks(make_star, enriched):
    star = _yearly_star(make_star, enriched, [2005, 2006, 2007, 2019, 2020, 2024])
    assert tuples(dashboard.streaming_blocks(reports.runtime_paradox(star))) == [(2007, 2024)]


def test_benchmark_without_stable_years_is_null(spark):
    series = spark.createDataFrame(
        [("FP.CPI.TOTL.ZG", 2024, 1.0), ("FP.CPI.TOTL.ZG", 2025, 2.0)], schemas.INDICATORS
    )
    rows = macro.enrich_macro(series, readers.curated_events(spark)).orderBy("year").collect()
    assert [r["inflation_rate"] for r in rows] == [1.0, None]
