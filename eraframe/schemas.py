"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_LONG, _INT, _TEXT, _REAL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
_FLAG = T.BooleanType()

RAW_FILMS = _schema(
    ("id", _LONG),
    ("title", _TEXT),
    ("vote_average", _REAL),
    ("vote_count", _LONG),
    ("release_date", _TEXT),
    ("revenue", _REAL),
    ("runtime", _REAL),
    ("budget", _REAL),
    ("imdb_id", _TEXT),
    ("overview", _TEXT),
    ("genres", _TEXT),
)

TITLE_BASICS = [
    "tconst",
    "titleType",
    "primaryTitle",
    "originalTitle",
    "isAdult",
    "startYear",
    "endYear",
    "runtimeMinutes",
    "genres",
]
TITLE_RATINGS = ["tconst", "averageRating", "numVotes"]

INDICATORS = _schema(("indicator", _TEXT), ("year", _INT), ("value", _REAL))

EVENTS = _schema(("seq", _INT), ("year", _INT), ("event_name", _TEXT), ("event_type", _TEXT))

MACRO = _schema(
    ("year", _INT),
    ("inflation_rate", _REAL),
    ("gdp_growth", _REAL),
    ("unemployment_rate", _REAL),
    ("event_name", _TEXT),
    ("event_type", _TEXT),
)

DIM_MOVIES = _schema(
    ("movie_key", _LONG),
    ("movie_id", _LONG),
    ("title", _TEXT),
    ("genre", _TEXT),
    ("runtime", _INT),
    ("overview", _TEXT),
)
DIM_DATE = _schema(("date_key", _INT), ("release_year", _INT), ("decade", _TEXT))
DIM_MACROECONOMICS = _schema(
    ("year", _INT),
    ("gdp_growth_rate", _REAL),
    ("unemployment_rate", _REAL),
    ("inflation_rate", _REAL),
)
DIM_GEOPOLITICAL_EVENTS = _schema(
    ("event_year", _INT), ("event_name", _TEXT), ("event_type", _TEXT)
)
FACT_BOX_OFFICE = _schema(
    ("movie_key", _LONG),
    ("date_key", _INT),
    ("budget", _LONG),
    ("revenue", _LONG),
    ("roi", _REAL),
    ("vote_average", _REAL),
    ("vote_count", _INT),
    ("popularity", _REAL),
)
FACT_DIGESTS = _schema(
    ("date_key", _INT), ("row_count", _LONG), ("digest_1", _TEXT), ("digest_2", _TEXT)
)


def _sums(*measures: str, totals: tuple[str, ...] = ("budget", "revenue")) -> list:
    """Fields of partial sums: whole totals, real sums, and the counts of known values."""
    return [
        *[(f"{m}_total", _LONG) for m in totals],
        *[(f"{m}_sum", _REAL) for m in measures],
        *[(f"{m}_known", _LONG) for m in measures],
    ]


PARTIAL_YEARLY = _schema(
    ("date_key", _INT),
    ("has_revenue", _FLAG),
    ("has_budget", _FLAG),
    ("profitability_tier", _TEXT),
    ("budget_tier", _TEXT),
    ("films", _LONG),
    ("movies", _LONG),
    ("high_roi", _LONG),
    *_sums("budget", "revenue", "roi", "vote_average", "popularity"),
)
PARTIAL_GENRES = _schema(
    ("date_key", _INT),
    ("has_revenue", _FLAG),
    ("has_budget", _FLAG),
    ("genre", _TEXT),
    ("is_comedy", _FLAG),
    ("analyzed_genre", _TEXT),
    ("films", _LONG),
    *_sums("budget", "revenue", "roi", "vote_average"),
)
PARTIAL_RUNTIMES = _schema(("date_key", _INT), ("minutes", _LONG), ("films", _LONG))
PARTIAL_LEADERS = _schema(
    ("movie_key", _LONG), ("date_key", _INT), ("revenue", _LONG), ("runtime", _INT)
)
PARTIAL_VOTES = _schema(
    ("vote_count", _INT), ("films", _LONG), ("rating_sum", _REAL), ("rated", _LONG)
)

FUNNEL = _schema(("step_no", _INT), ("step", _TEXT), ("row_count", _LONG))
