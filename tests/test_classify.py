from __future__ import annotations

from pyspark.sql import functions as F

from eraframe import constants as K
from eraframe.functions import classify
from tests.conftest import tuples


def _era(spark, rows, rule, third):
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], "i int, g double, u double, e string"
    )
    out = df.select("i", rule(F.col("g"), F.col("u"), F.col("e")).alias(third)).orderBy("i")
    return [value for _, value in tuples(out)]


def test_strict_rule_limits_and_nulls(spark):
    rows = [
        (0.0, 8.0, None), (-0.1, 1.0, None), (1.0, 8.1, None), (None, None, "Economic Crisis"),
        (None, None, None), (None, 8.1, "War"), (-1.0, None, None), (2.0, 4.0, "War"),
    ]
    assert _era(spark, rows, classify.era_type, "era") == [
        "Stable", "Crisis", "Crisis", "Crisis", "Stable", "Crisis", "Crisis", "Stable",
    ]


def test_loose_rule_limits_and_nulls(spark):
    rows = [
        (0.0, 1.0, None), (0.1, 7.0, None), (0.1, 6.9, None), (0.1, 6.9, "STABLE period"),
        (0.1, 6.9, "War"), (None, None, None), (None, None, "War"),
    ]
    assert _era(spark, rows, classify.economic_climate, "climate") == [
        "Crisis Period", "Crisis Period", "Stable Period", "Stable Period",
        "Crisis Period", "Stable Period", "Crisis Period",
    ]


def test_profitability_tier(spark):
    df = spark.createDataFrame([(1.99,), (2.0,), (2.5,), (4.0,), (None,)], "roi double")
    tiers = [t for (t,) in tuples(df.select(classify.profitability_tier(F.col("roi"))))]
    assert [t[0] for t in tiers] == ["1", "2", "3", "4", "4"]


def test_budget_tier(spark):
    df = spark.createDataFrame([(19_999_999,), (20_000_000,), (99_999_999,), (100_000_000,)], "b bigint")
    tiers = [t for (t,) in tuples(df.select(classify.budget_tier(F.col("b"))))]
    low, medium, high = reversed(K.BUDGET_TIERS)
    assert tiers == [low, medium, medium, high]


def test_streaming_era_and_decade(spark):
    df = spark.createDataFrame([(2006,), (2007,), (2019,), (2020,), (1999,)], "y int")
    rows = tuples(df.select(classify.streaming_era(F.col("y")), classify.decade_label(F.col("y"))))
    assert [era.split()[0] for era, _ in rows] == [
        "Pre-Streaming", "Streaming", "Streaming", "Short-Form", "Pre-Streaming",
    ]
    assert [decade for _, decade in rows] == ["2000s", "2000s", "2010s", "2020s", "1990s"]


def test_overview_length_ignores_trailing_blanks(spark):
    df = spark.createDataFrame([("x" * 50 + "   ",), ("x" * 51,), ("",), (None,)], "o string")
    assert [v for (v,) in tuples(df.select(classify.has_overview(F.col("o"))))] == [
        False, True, False, None,
    ]


def test_comedy_wins_over_horror(spark):
    df = spark.createDataFrame([("Horror, COMEDY",), ("horror",), ("Drama",), (None,)], "g string")
    assert [v for (v,) in tuples(df.select(classify.comedy_or_horror(F.col("g"))))] == [
        "Comedy", "Horror", None, None,
    ]
