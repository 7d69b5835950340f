"""The star schema: one release fact and four dimensions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from eraframe import schemas
from eraframe.sources import commits


@dataclass(frozen=True)
class Star:
    """Five lazy frames; the schemas are those in :mod:`eraframe.schemas`.

    Films are unique by key, and ``macro``, ``events`` and ``dates`` have one row per
    year: the load step sees to that. Money totals are BIGINT at any size; a sum beyond
    it fails, it never wraps.
    """

    fact: DataFrame
    movies: DataFrame
    dates: DataFrame
    macro: DataFrame
    events: DataFrame


TABLES = {
    "fact": ("fact_box_office", schemas.FACT_BOX_OFFICE),
    "movies": ("dim_movies", schemas.DIM_MOVIES),
    "dates": ("dim_date", schemas.DIM_DATE),
    "macro": ("dim_macroeconomics", schemas.DIM_MACROECONOMICS),
    "events": ("dim_geopolitical_events", schemas.DIM_GEOPOLITICAL_EVENTS),
}


def read_star(spark: SparkSession, path: str, version: commits.Version | None = None) -> Star:
    """Open a published version of a stored star, the last one by default."""
    version = version or commits.latest(spark, path)
    if not version.number:
        raise FileNotFoundError(f"no star in {path}")
    tables = {
        field: commits.read_rows(spark, path, table, schema, version)
        for field, (table, schema) in TABLES.items()
    }
    return Star(**tables)


def write_star(star: Star, path: str) -> commits.Version:
    """Store a star schema as Parquet, replacing what is there.

    All tables become visible by one commit, so a reader never meets a new fact beside
    old dimensions, and a load that fails changes nothing. The fact is partitioned by year.
    ``rebalance`` lets the engine split a year that holds much of the data and merge
    the small ones into one file.
    """
    frames: dict[str, tuple[DataFrame, str | None]] = {}
    for field, (table, _) in TABLES.items():
        frame: DataFrame = getattr(star, field)
        if field == "fact":
            frames[table] = (frame.hint("rebalance", "date_key"), "date_key")
        elif field == "movies":
            frames[table] = (frame, None)
        else:
            frames[table] = (frame.coalesce(1), None)
    return commits.replace_tables(star.fact.sparkSession, path, frames)


def write_bucketed_star(star: Star, name: str, path: str, buckets: int = 512) -> None:
    """Store a star as catalog tables ``<name>_<table>`` with files below ``path``, replacing them.

    Fact and films are dealt to buckets by film key and sorted by it, so joins of the two on
    the key need neither a shuffle nor, with a file per bucket, a sort. Choose ``buckets`` so that
    a bucket of the fact fits a task. A film that outweighs a bucket makes its bucket as large:
    with such films keep :func:`write_star`, where joins split them at run time.
    """
    for field, (table, _) in TABLES.items():
        frame: DataFrame = getattr(star, field)
        writer = frame.coalesce(1).write
        if field in ("fact", "movies"):
            # One task per bucket, so one file; the hash is that of the buckets.
            dealt = frame.repartition(buckets, "movie_key")
            writer = dealt.write.bucketBy(buckets, "movie_key").sortBy("movie_key")
        target = f"{path}/{name}-{uuid.uuid4().hex}/{table}"
        writer.mode("overwrite").option("path", target).saveAsTable(f"{name}_{table}")


def read_bucketed_star(spark: SparkSession, name: str) -> Star:
    """Open the tables of :func:`write_bucketed_star`."""
    return Star(**{field: spark.table(f"{name}_{table}") for field, (table, _) in TABLES.items()})
