"""Loading a star under its constraints: rows that break one go to a table beside, with the reason.

Each table is read once: its rows get the list of constraints that they break, and one write
deals them to a valid and a rejected folder. All tables become visible by one commit, so a
star that readers open never holds a row that breaks a constraint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraframe.plans.checks import REFERENCES, REQUIRED, UNIQUE
from eraframe.sources import commits
from eraframe.sources.star import TABLES, Star

VALID, REJECTED = "valid", "rejected"
_REASONS = T.StructField("reasons", T.ArrayType(T.StringType()))


def _broken(*checks: tuple[Column, str]) -> Column:
    """Reasons of the checks that are true, in their order."""
    reasons = [F.when(broken, reason) for broken, reason in checks]
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")


def _missing(field: str) -> list[tuple[Column, str]]:
    columns = [c for part, _, required in REQUIRED if part == field for c in required]
    return [(F.col(c).isNull(), f"{c} is null") for c in columns]


def checked_dimension(rows: DataFrame, field: str, order: list[str] | None = None) -> DataFrame:
    """Rows of a dimension with ``reasons``; of rows with one key all but the first are rejected.

    ``order`` decides which row is first, else all columns do. Rows of one key meet in one task,
    and only the first is accepted: a dimension's keys are unique but for mistakes.
    """
    keys = [key for part, _, key in UNIQUE if part == field]
    order = order or rows.columns
    repeated = [
        (F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1, f"{key} repeated")
        for key in keys
    ]
    return rows.withColumn("reasons", _broken(*_missing(field), *repeated))


def checked_fact(star: Star) -> DataFrame:
    """Fact rows with ``reasons``: required columns that are null, keys without a dimension row.

    Films are looked up in one join; the keys of the dimensions by year are put together first, so
    the fact meets them in a second one, which is broadcast.
    """
    fact = star.fact
    by_year = [(dim, key, table) for own, dim, key, table in REFERENCES if own == "date_key"]
    years = reduce(
        lambda a, b: a.join(b, "year_key", "full"),
        [
            getattr(star, dim)
            .select(F.col(key).alias("year_key"), F.lit(True).alias(f"in_{table}"))
            .distinct()
            for dim, key, table in by_year
        ],
    )
    films = star.movies.select(F.col("movie_key").alias("film_key"), F.lit(True).alias("in_films"))
    rows = fact.join(films.distinct(), fact["movie_key"] == F.col("film_key"), "left")
    rows = rows.join(years, fact["date_key"] == F.col("year_key"), "left")
    orphans = [(F.col("movie_key").isNotNull() & F.col("in_films").isNull(), "movie_key not in dim_movies")]
    orphans += [
        (F.col("date_key").isNotNull() & F.col(f"in_{table}").isNull(), f"date_key not in {table}")
        for _, _, table in by_year
    ]
    return rows.select(*fact.columns, _broken(*_missing("fact"), *orphans).alias("reasons"))


def load_checked(
    spark: SparkSession, path: str, star: Star, order: dict[str, list[str]] | None = None
) -> commits.Version:
    """Stores the valid rows of a star and, beside them, the rejected ones with their reasons.

    The fact is checked against the accepted rows of the dimensions, so a release of a rejected film
    is rejected, too. The notes of the version have the rows of each table.
    """
    changed: dict[str, list[str]] = {}
    notes: dict[str, str] = {}

    def store(field: str, rows: DataFrame, *by: str) -> None:
        table = TABLES[field][0]
        verdict = F.when(F.size("reasons") == 0, VALID).otherwise(REJECTED)
        load = commits.write_rows(rows.withColumn("verdict", verdict), path, table, ["verdict", *by])
        notes[table] = str(load.rows)
        for kind in (VALID, REJECTED):
            folders = [f for f in load.folders if f.endswith(f"verdict={kind}")]
            changed[table if kind == VALID else f"{table}.{REJECTED}"] = folders

    dimensions = {}
    for field, (table, schema) in TABLES.items():
        if field != "fact":
            store(field, checked_dimension(getattr(star, field), field, (order or {}).get(field)))
            written = commits.Version(1, changed)
            dimensions[field] = commits.read_rows(spark, path, table, schema, written)
    store("fact", checked_fact(Star(fact=star.fact, **dimensions)), "date_key")
    return commits.retried(spark, path, lambda base: (changed, notes))


def read_rejected(
    spark: SparkSession, path: str, field: str, version: commits.Version | None = None
) -> DataFrame:
    """Rejected rows of a table (a field of the star) with their ``reasons``."""
    table, schema = TABLES[field]
    return commits.read_rows(
        spark,
        path,
        table,
        T.StructType([*schema.fields, _REASONS]),
        version,
        listed=f"{table}.{REJECTED}",
    )
