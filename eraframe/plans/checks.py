"""Constraint checks of a star schema: keys, required columns, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from eraframe.operators import quality
from eraframe.sources.star import Star

# Unique columns, required columns and references of the schema.
UNIQUE = [
    ("movies", "dim_movies", "movie_key"),
    ("movies", "dim_movies", "movie_id"),
    ("dates", "dim_date", "date_key"),
    ("macro", "dim_macroeconomics", "year"),
    ("events", "dim_geopolitical_events", "event_year"),
]
REQUIRED = [
    ("movies", "dim_movies", ["movie_id", "title"]),
    ("dates", "dim_date", ["release_year", "decade"]),
    ("events", "dim_geopolitical_events", ["event_name", "event_type"]),
    ("fact", "fact_box_office", ["movie_key", "date_key"]),
]
REFERENCES = [
    ("movie_key", "movies", "movie_key", "dim_movies"),
    ("date_key", "dates", "date_key", "dim_date"),
    ("date_key", "macro", "year", "dim_macroeconomics"),
    ("date_key", "events", "event_year", "dim_geopolitical_events"),
]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(star: Star) -> DataFrame:
    """Values that break a unique column; empty for a sound star."""
    return _all(
        [quality.duplicate_keys(getattr(star, part), table, key) for part, table, key in UNIQUE]
    )


def missing_values(star: Star) -> DataFrame:
    """Nulls per required column; all zero for a sound star."""
    return _all(
        [quality.null_counts(getattr(star, part), table, cols) for part, table, cols in REQUIRED]
    )


def broken_references(star: Star) -> DataFrame:
    """Fact keys without a dimension row, with the fact rows they hold."""
    return _all(
        [
            quality.orphans(star.fact, key, getattr(star, part), dim_key, table)
            for key, part, dim_key, table in REFERENCES
        ]
    )
