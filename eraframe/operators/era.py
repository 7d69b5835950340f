"""The economic calendar: one row per year, and filters built on it.

The macro and event dimensions hold one row per year (the load step keeps the
first, ``dq_duplicate_keys`` checks it). How a calendar is joined is left to the
optimizer, which broadcasts it as long as it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eraframe.constants import CRISIS, STABLE
from eraframe.functions.classify import economic_climate, era_type
from eraframe.sources.star import Star


def calendar(star: Star) -> DataFrame:
    """Macro rates, event and both classifications of every macro year."""
    macro, events = star.macro, star.events
    gdp, unemployment = F.col("gdp_growth_rate"), F.col("unemployment_rate")
    return macro.join(events, macro["year"] == events["event_year"], "left").select(
        F.col("year").alias("release_year"),
        gdp,
        unemployment,
        "inflation_rate",
        "event_name",
        "event_type",
        era_type(gdp, unemployment, F.col("event_type")).alias("era_type"),
        economic_climate(gdp, unemployment, F.col("event_name")).alias("economic_climate"),
    )


def with_calendar(frame: DataFrame, star: Star, *columns: str) -> DataFrame:
    """Add calendar columns by ``release_year``; years without macro data drop out."""
    years = calendar(star).select("release_year", *columns)
    return frame.join(years, "release_year")


def in_era(fact: DataFrame, star: Star, era: str) -> DataFrame:
    """Fact rows of one era; any label but Crisis and Stable keeps all rows.

    Applied before grouping, so that a fact partitioned by ``date_key`` is
    read for the wanted years only.
    """
    if era not in (CRISIS, STABLE):
        return fact
    crisis_years = (
        calendar(star).filter(F.col("era_type") == CRISIS).select(F.col("release_year").alias("date_key"))
    )
    how = "left_semi" if era == CRISIS else "left_anti"
    return fact.join(crisis_years, "date_key", how)
