from __future__ import annotations

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eraframe.operators import keyed, quality
from eraframe.operators.quantile import quantile_of_counts
from eraframe.operators.series import year_blocks
from tests.conftest import tuples


def _quantile(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return quantile_of_counts(counts, "v", "n", q, ["n"]).collect()[0]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(
        st.one_of(st.integers(0, 5), st.integers(-(2**31), 2**31 - 1)), min_size=1, max_size=40
    ),
    q=st.sampled_from([0.0, 0.3, 0.5, 0.7, 1.0]),
)
def test_quantile_against_brute_force(spark, values, q):
    row = _quantile(spark, values, q)
    assert np.isclose(row["quantile"], np.quantile(np.array(values, dtype="float64"), q), rtol=1e-12)
    assert row["total_n"] == len(values)


def test_quantile_with_one_hot_value(spark):
    values = [1] * 700 + [65_536] * 299 + [2_000_000_000]
    for q in (0.0, 0.5, 0.6999, 0.7, 0.9985, 1.0):
        assert np.isclose(_quantile(spark, values, q)["quantile"], np.quantile(values, q))


def test_quantile_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "v int, n bigint")
    assert quantile_of_counts(empty, "v", "n", 0.5).collect()[0]["quantile"] is None


def test_year_blocks(spark):
    rows = [(2000, "C"), (2001, "C"), (2002, "S"), (2003, "C"), (2010, "C"), (2011, None)]
    df = spark.createDataFrame(rows, "release_year int, e string")
    assert tuples(year_blocks(df, F.col("e") == "C")) == [(2000, 2001), (2003, 2010)]


def test_keep_first_of_a_hot_key(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") > 10_000, 0).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("seq")
    )
    kept = keyed.keep_first(df, "k", "seq")
    assert kept.count() == 10_001
    assert tuples(kept.filter("k = 0")) == [(0, -29_999)]


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None), (None, "b")], "k int, v string")
    dim = spark.createDataFrame([(1,)], "id int")
    assert tuples(quality.duplicate_keys(df, "t", "k")) == [("t", "k", "1", 2)]
    assert tuples(quality.null_counts(df, "t", ["k", "v"])) == [("t", "k", 1), ("t", "v", 2)]
    assert tuples(quality.orphans(df.dropna(), "k", dim, "id", "d")) == []
    assert tuples(quality.orphans(df.filter("k = 2"), "k", dim, "id", "d")) == [("d", "k", "2", 1)]
