"""The reports by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eraframe.plans import reports
from eraframe.sources.readers import constant_table
from eraframe.sources.star import Star

REPORTS: dict[str, Callable[..., DataFrame]] = {
    report.__name__: report
    for report in (
        reports.industry_baseline_trends,
        reports.top_blockbusters,
        reports.profitability_split,
        reports.genre_baselines,
        reports.escapism_index,
        reports.budget_dilemma,
        reports.comedy_paradox,
        reports.runtime_paradox,
        reports.sentiment_corpus,
        reports.financial_kpis,
        reports.rating_kpis,
        reports.decade_genre_share,
        reports.production_density,
        reports.macro_impact_data,
        reports.budget_elasticity,
        reports.comedy_horror_paradox,
        reports.gdp_vs_movie_revenue,
        reports.budget_vs_revenue,
        reports.crisis_timeline_overlay,
        reports.top_movies_by_rating,
        reports.genre_performance_summary,
        reports.inflation_adjusted_profit,
    )
}


def applies_era(name: str) -> bool:
    """Does the report filter by era, or always cover all years?"""
    return "era" in inspect.signature(REPORTS[name]).parameters


def run_report(name: str, star: Star, era: str = "All", **parameters: Any) -> DataFrame:
    """Run a report; reports without an era filter ignore ``era``."""
    if applies_era(name):
        parameters["era"] = era
    return REPORTS[name](star, **parameters)


def describe_reports(spark: SparkSession) -> DataFrame:
    """Name, description and era support of every report."""
    rows = [
        (name, (inspect.getdoc(report) or "").split("\n\n")[0], applies_era(name))
        for name, report in REPORTS.items()
    ]
    schema = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("applies_era", T.BooleanType()),
        ]
    )
    return constant_table(spark, rows, schema)
