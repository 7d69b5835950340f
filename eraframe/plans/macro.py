"""Macro indicators joined with the curated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eraframe import constants as K

RATES = list(K.INDICATOR_CODES)


def indicators_by_year(series: DataFrame) -> DataFrame:
    """Long ``(indicator, year, value)`` series as one row per year."""
    codes = {code: name for name, code in K.INDICATOR_CODES.items()}
    return (
        series.groupBy("year")
        .pivot("indicator", list(codes))
        .agg(F.max("value"))
        .withColumnsRenamed(codes)
        .select(F.col("year").cast("int").alias("year"), *RATES)
        .orderBy("year")
    )


def add_events(by_year: DataFrame, events: DataFrame) -> DataFrame:
    """Attach events, one row per event, and fill gaps in rates and labels."""
    fallback = F.create_map(
        *[F.lit(x) for year, rate in K.UNEMPLOYMENT_FALLBACK.items() for x in (year, rate)]
    )
    return by_year.join(events, "year", "left").select(
        "year",
        "inflation_rate",
        "gdp_growth",
        F.coalesce("unemployment_rate", F.try_element_at(fallback, F.col("year"))).alias(
            "unemployment_rate"
        ),
        F.coalesce("event_name", F.lit(K.NO_EVENT_NAME)).alias("event_name"),
        F.coalesce("event_type", F.lit(K.NO_EVENT_NAME)).alias("event_type"),
        "seq",
    )


def benchmark(enriched: DataFrame) -> DataFrame:
    """Mean rates of the last fully known stable years, as one row."""
    complete = F.col("event_name") == K.NO_EVENT_NAME
    for rate in RATES:
        complete = complete & F.col(rate).isNotNull()
    return (
        enriched.filter(complete & (F.col("year") < K.BENCHMARK_YEAR))
        .orderBy(F.desc("year"))
        .limit(K.BENCHMARK_SPAN)
        .agg(*[F.bround(F.avg(rate), 14).alias(rate) for rate in RATES])
    )


def enrich_macro(series: DataFrame, events: DataFrame) -> DataFrame:
    """The full macro table; the benchmark year takes the benchmark rates."""
    enriched = add_events(indicators_by_year(series), events)
    # A column of its own, so that the one-row subquery runs once.
    means = benchmark(enriched).select(F.struct(*RATES)).scalar()
    in_benchmark_year = F.col("year") == K.BENCHMARK_YEAR
    return (
        enriched.withColumn("means", means)
        .withColumns(
            {
                rate: F.when(in_benchmark_year, F.col(f"means.{rate}")).otherwise(F.col(rate))
                for rate in RATES
            }
        )
        .drop("means")
    )
