"""Classifiers, each defined once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eraframe import constants as K
from eraframe.functions.text import mentions_genre


def era_type(gdp: Column, unemployment: Column, event_type: Column) -> Column:
    """Strict rule: shrinking economy, high unemployment or an economic crisis.

    A comparison with a null indicator does not count as a crisis.
    """
    crisis = (
        (gdp < 0)
        | (unemployment > K.STRICT_UNEMPLOYMENT)
        | (event_type == K.CRISIS_EVENT_TYPE)
    )
    return F.when(crisis, K.CRISIS).otherwise(K.STABLE)


def economic_climate(gdp: Column, unemployment: Column, event_name: Column) -> Column:
    """Loose rule: no growth, raised unemployment or any named event."""
    named = F.lower(F.coalesce(event_name, F.lit(K.NO_EVENT_NAME))) != K.NO_EVENT_NAME.lower()
    crisis = (gdp <= 0) | (unemployment >= K.LOOSE_UNEMPLOYMENT) | named
    return F.when(crisis, K.CRISIS_CLIMATE).otherwise(K.STABLE_CLIMATE)


def crisis_event_flag(event_type: Column) -> Column:
    """1 in a year with an economic-crisis event, else 0."""
    return F.when(event_type == K.CRISIS_EVENT_TYPE, 1).otherwise(0)


def comedy_or_horror(genre: Column) -> Column:
    """Comedy wins over Horror; null for films that are neither."""
    return F.when(mentions_genre(genre, "comedy"), "Comedy").when(
        mentions_genre(genre, "horror"), "Horror"
    )


def profitability_tier(roi: Column) -> Column:
    """Four return tiers; an unknown return lands in the top one."""
    return (
        F.when(roi < K.MARGINAL_ROI, K.LOSS_TIER)
        .when(roi < K.PROFIT_ROI, K.MARGINAL_TIER)
        .when(roi < K.BLOCKBUSTER_ROI, K.PROFIT_TIER)
        .otherwise(K.BLOCKBUSTER_TIER)
    )


def budget_tier(budget: Column) -> Column:
    """Three budget tiers."""
    return (
        F.when(budget >= K.HIGH_BUDGET, K.HIGH_BUDGET_TIER)
        .when(budget >= K.MEDIUM_BUDGET, K.MEDIUM_BUDGET_TIER)
        .otherwise(K.LOW_BUDGET_TIER)
    )


def streaming_era(year: Column) -> Column:
    """Home-viewing era of a release year."""
    return (
        F.when(year >= K.SHORT_FORM_START, K.SHORT_FORM)
        .when(year >= K.STREAMING_START, K.STREAMING)
        .otherwise(K.PRE_STREAMING)
    )


def decade_label(year: Column) -> Column:
    """``1994`` -> ``1990s``."""
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def has_overview(overview: Column, min_chars: int = K.MIN_OVERVIEW_CHARS) -> Column:
    """Longer than ``min_chars``, trailing blanks not counted."""
    return F.length(F.rtrim(overview)) > min_chars
