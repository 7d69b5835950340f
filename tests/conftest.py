from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from eraframe import schemas
from eraframe.functions.classify import decade_label
from eraframe.session import build_session
from eraframe.sources.star import Star

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "eraframe-tests",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def no_auto_broadcast(spark):
    """The plans a film dimension too large to broadcast gets."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="session")
def make_star(spark):
    """Star out of short fact, film, macro and event rows."""

    def make(facts, movies=(), macro=(), events=(), **options) -> Star:
        fact = spark.createDataFrame(
            [
                {
                    "movie_key": 1, "date_key": 2000, "budget": 100, "revenue": 300, "roi": 2.0,
                    "vote_average": 5.0, "vote_count": 2000, "popularity": 5.0, **row,
                }
                for row in facts
            ],
            schemas.FACT_BOX_OFFICE,
        )
        films = [
            {"title": f"film {m['movie_key']}", "genre": "Drama", "runtime": 100, "overview": None, **m}
            | {"movie_id": m["movie_key"]}
            for m in (movies or [{"movie_key": row.get("movie_key", 1)} for row in facts])
        ]
        years = fact.select("date_key").distinct()
        return Star(
            fact=fact,
            movies=spark.createDataFrame(films, schemas.DIM_MOVIES).dropDuplicates(["movie_key"]),
            dates=years.selectExpr("date_key", "date_key AS release_year").withColumn(
                "decade", decade_label(years["date_key"])
            ),
            macro=spark.createDataFrame(list(macro), schemas.DIM_MACROECONOMICS),
            events=spark.createDataFrame(list(events), schemas.DIM_GEOPOLITICAL_EVENTS),
            **options,
        )

    return make


def tuples(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
