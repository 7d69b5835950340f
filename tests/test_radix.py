from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eraframe.operators.radix import ordered_bits, quantile_by


def _expected(values: list, q: float) -> float:
    values = sorted((float(v) for v in values), key=lambda v: (math.isnan(v), v))
    position = (len(values) - 1) * q
    low, high = values[math.floor(position)], values[math.ceil(position)]
    if low == high or position == math.floor(position):
        return low
    return low + (position - math.floor(position)) * (high - low)


def _check(spark, rows: list[tuple], kind: str, q: float) -> None:
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(4)
    got = {r["g"]: r["quantile"] for r in quantile_by(df, ["g"], "v", q).collect()}
    wanted: dict = {}
    for group, value in rows:
        if value is not None:
            wanted.setdefault(group, []).append(value)
    assert set(got) == set(wanted)
    for group, values in wanted.items():
        expected = _expected(values, q)
        assert got[group] == expected or (math.isnan(got[group]) and math.isnan(expected)), group


DOUBLES = [
    0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
    -1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1, 1 / 3, 2.0, math.nextafter(2.0, 1), 1024.0,
    math.nextafter(1024.0, 0), math.nextafter(1024.0, 9e9), 2.0**1023, math.nextafter(2.0**1023, 0),
]


def test_bits_have_the_order_of_doubles(spark):
    rng = random.Random(1)
    values = DOUBLES + [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(2000)]
    values += [float(2.0**e) for e in range(-1074, 1024)]
    values += [math.nextafter(2.0**e, s) for e in range(-1070, 1023, 7) for s in (0, math.inf)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bits, width = ordered_bits(F.col("v"), df.schema["v"].dataType)
    got = df.select("v", bits.alias("bits")).collect()
    raw = np.array([abs(r["v"]) for r in got]).view(np.int64)
    for row, own in zip(got, raw.tolist(), strict=True):
        if not math.isnan(row["v"]):
            assert row["bits"] == (-own if row["v"] < 0 else own), row["v"]
        else:
            assert row["bits"] == 2**63 - 1
    assert width == 64


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 1.0])
def test_doubles_by_group(spark, q):
    rng = random.Random(2)
    rows = [("odd", v) for v in DOUBLES if math.isfinite(v) and abs(v) < 1e300]
    rows += [("many", rng.gauss(0, 1e9)) for _ in range(500)] + [(None, 7.5), ("none", None)]
    rows += [("equal", 0.1)] * 300 + [("two", 1.0), ("two", 2.0), ("end", math.inf), ("end", math.inf)]
    rows += [("nan", math.nan), ("nan", math.nan), ("nan", 1.0)] if q in (0.0, 1.0) else []
    _check(spark, rows, "double", q)


@pytest.mark.parametrize(
    ("kind", "low", "high"),
    [("bigint", -(2**63), 2**63 - 1), ("int", -(2**31), 2**31 - 1), ("smallint", -300, 300), ("decimal(9,2)", -900, 900)],
)
def test_whole_numbers_by_group(spark, kind, low, high):
    import decimal

    rng = random.Random(3)
    make = decimal.Decimal if kind.startswith("decimal") else int
    rows = [(f"g{i % 3}", make(rng.randint(low, high))) for i in range(300)]
    rows += [("ends", make(low)), ("ends", make(high)), ("hot", make(high))] * 50 + [(None, None)]
    _check(spark, rows, kind, 0.5)


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "v bigint")
    assert [tuple(r) for r in quantile_by(df, [], "v", 0.25).collect()] == [(2.25,)]
    assert quantile_by(df.filter("v < 0"), [], "v", 0.25).dropna().collect() == []
    with pytest.raises(ValueError, match="range"):
        quantile_by(df, [], "v", 1.5)
    with pytest.raises(TypeError, match="string"):
        quantile_by(df.selectExpr("CAST(v AS string) AS v"), [], "v", 0.5)


def test_rows_are_read_once(spark):
    found = quantile_by(spark.range(1000).selectExpr("id % 3 AS g", "id AS v"), ["g"], "v", 0.5)
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
