"""Registered queries and the SQL that checks them.

Every query reads the given tables through ``eraframe.sources.testdata``.
"""

from __future__ import annotations

import importlib
import inspect
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraframe import run_report, schemas
from eraframe.constants import INDICATOR_CODES
from eraframe.functions import classify
from eraframe.functions.rounding import round_half_up
from eraframe.functions.text import format_currency, mentions_genre, primary_genre
from eraframe.operators import quality, radix
from eraframe.operators.era import calendar
from eraframe.plans import (
    checks,
    clean,
    dashboard,
    load,
    macro,
    partials,
    quarantine,
    reload,
    reports,
    stage,
)
from eraframe.plans.catalog import REPORTS, applies_era
from eraframe.schemas import TITLE_BASICS, TITLE_RATINGS
from eraframe.sources import commits, readers, sinks, testdata
from eraframe.sources.star import (
    Star,
    read_bucketed_star,
    read_star,
    write_bucketed_star,
    write_star,
)

Query = Callable[[SparkSession, str], DataFrame]

# The text operators are an optional part: without their files, or a package that they need, the
# rest works.
try:
    text_queries = importlib.import_module("eraframe.llm.queries")
except ImportError:
    text_queries = None

_SMOKE_DIR = "/root/testdata/sf0.001"


def _report(name: str, era: str = "All") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = testdata.star(spark, sf_dir, overviews=name == "sentiment_corpus")
        return run_report(name, star, era)

    return query


def _reshaped(
    operator: Callable[..., DataFrame], name: str, era: str = "All", shift: int = 0, **parameters
) -> Query:
    """A dashboard operator over a report result."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Bins are counted, so the rows behind them need no order.
        options = {"ordered": False} if name == "rating_kpis" else {}
        result = run_report(name, testdata.star(spark, sf_dir, shift=shift), era, **options)
        return operator(result, **parameters)

    return query


# Reports that need a little around them ------------------------------------


def _vote_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = reports.vote_statistics(testdata.star(spark, sf_dir).fact)
    return stats.select(round_half_up(F.col("global_mean"), 6).alias("global_mean"), "min_votes")


def _economic_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both classifications of every year that has releases."""
    star = testdata.star(spark, sf_dir)
    years = star.fact.select(F.col("date_key").alias("release_year")).distinct()
    return years.join(calendar(star), "release_year").select(
        "release_year",
        "era_type",
        "economic_climate",
        classify.crisis_event_flag(F.col("event_type")).alias("is_crisis_year"),
    )


def _film_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases per combination of all film-level classifiers."""
    star = testdata.star(spark, sf_dir, overviews=True)
    genre = F.col("genre")
    movies = star.movies.select(
        "movie_key",
        "genre",
        primary_genre(genre).alias("primary_genre"),
        mentions_genre(genre, "comedy").alias("is_comedy"),
        classify.comedy_or_horror(genre).alias("analyzed_genre"),
        F.coalesce(classify.has_overview(F.col("overview")), F.lit(False)).alias("has_overview"),
    )
    per_film = star.fact.groupBy(
        "movie_key",
        classify.profitability_tier(F.col("roi")).alias("profitability_tier"),
        classify.budget_tier(F.col("budget")).alias("budget_tier"),
        classify.streaming_era(F.col("date_key")).alias("streaming_era"),
    ).agg(F.count(F.lit(1)).alias("n"))
    keys = [c for c in (*movies.columns, *per_film.columns) if c not in ("movie_key", "n")]
    return per_film.join(movies, "movie_key").groupBy(*keys).agg(F.sum("n").alias("films"))


def _format_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = testdata.star(spark, sf_dir)
    grossed = star.fact.groupBy("movie_key").agg(F.sum("revenue").alias("total_box_office"))
    return grossed.withColumn("money_label", format_currency(F.col("total_box_office")))


def _known_genres(spark: SparkSession, sf_dir: str) -> Star:
    """A star whose film dimension lacks the films of unknown genre, and whose calendar
    lacks the years from 2000 on: releases of either have no dimension row."""
    star = testdata.star(spark, sf_dir)
    return replace(
        star, movies=star.movies.filter("genre <> 'Unknown'"), dates=star.dates.filter("date_key < 2000")
    )


def _title_genres(spark: SparkSession, sf_dir: str) -> Star:
    """Every title a genre of its own: many genres, some with few releases."""
    star = testdata.star(spark, sf_dir)
    return replace(star, movies=star.movies.withColumn("genre", F.col("title")))


def _odd_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top genres where one genre is unknown and one has the name of the rest."""
    star = testdata.star(spark, sf_dir)
    word = F.split_part("title", F.lit(" "), F.lit(2))
    genre = F.when(word == "bolt", "Other").when(word != "ring", word)
    odd = replace(star, movies=star.movies.withColumn("genre", genre))
    return dashboard.top_genres_other(run_report("decade_genre_share", odd), k=4)


def _unknown_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = testdata.star(spark, sf_dir)
    roi = F.when(F.col("vote_average") >= 6, F.col("roi"))
    return run_report("profitability_split", replace(star, fact=star.fact.withColumn("roi", roi)))


# Cleaning, staging, loading --------------------------------------------------


# The raw inputs are landed as files first, as they are in use. Read directly,
# the long expressions that spell them would be run again for every condition.

_LANDED: dict[tuple[str, str, str], str] = {}


def _landed(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of an input, written once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LANDED:
        path = sinks.scratch_path(spark, name)
        write(path)
        _LANDED[key] = path
    return _LANDED[key]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    films = testdata.raw_films(spark, sf_dir)
    return spark.read.schema(films.schema).parquet(
        _landed(spark, sf_dir, "raw-films", films.write.parquet)
    )


def _basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testdata.basics_lines(spark, sf_dir)
    path = _landed(spark, sf_dir, "title-basics", lines.write.text)
    return readers.read_titles(spark, path, TITLE_BASICS)


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_films(_raw(spark, sf_dir))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testdata.ratings_lines(spark, sf_dir)
    path = _landed(spark, sf_dir, "title-ratings", lines.write.text)
    return stage.movie_titles(
        _basics(spark, sf_dir), readers.read_titles(spark, path, TITLE_RATINGS)
    )


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage.stage_films(_clean(spark, sf_dir), _titles(spark, sf_dir))


def _stored_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged films, computed and stored by each job that reads them several times."""
    return sinks.hand_off(_staged(spark, sf_dir), "staged-films")


def land_inputs(spark: SparkSession, sf_dir: str) -> None:
    """Lands the raw inputs of the jobs, once per session and table folder."""
    _raw(spark, sf_dir)
    _titles(spark, sf_dir)
    _macro_by_year(spark, sf_dir)


def _macro_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators landed as CSV files, read back and spread by year."""
    series = testdata.indicator_series(spark, sf_dir)
    path = _landed(spark, sf_dir, "indicators", lambda path: sinks.write_csv(series, path))
    return macro.indicators_by_year(readers.read_indicators(spark, path))


def _macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.enrich_macro(
        testdata.indicator_series(spark, sf_dir), readers.curated_events(spark)
    )


def _rounded_rates(df: DataFrame) -> DataFrame:
    rates = [c for c in df.columns if c in INDICATOR_CODES or c == "gdp_growth_rate"]
    return df.withColumns({c: round_half_up(F.col(c), 8) for c in rates})


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_year = macro.indicators_by_year(testdata.indicator_series(spark, sf_dir))
    return _rounded_rates(macro.benchmark(macro.add_events(by_year, readers.curated_events(spark))))


def _film_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw films written as CSV and read back."""
    path = sinks.scratch_path(spark, "films-csv")
    columns = [f.name for f in readers.schemas.RAW_FILMS]
    sinks.write_csv(testdata.raw_films(spark, sf_dir).select(*columns), path)
    return readers.read_films(spark, path).drop("seq")


def _film_csv_scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, its blocks parsed side by side."""
    path = sinks.scratch_path(spark, "films-csv-split")
    columns = [f.name for f in readers.schemas.RAW_FILMS]
    sinks.write_csv(testdata.raw_films(spark, sf_dir).select(*columns), path)
    return readers.read_films_split(spark, path).drop("seq")


def _clean_funnel_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel as the write of the clean films counts it."""
    return clean.write_clean(_raw(spark, sf_dir), sinks.scratch_path(spark, "clean-films"))


def _title_tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title lines written as text and read back."""
    return _basics(spark, sf_dir).select(
        "tconst", "titleType", "primaryTitle", "runtimeMinutes", "genres"
    )


def _known_films(staged: DataFrame) -> DataFrame:
    """The film dimension of an earlier load: releases before 1998."""
    return load.dim_movies(staged.filter("year < 1998"))


def _dim_movies_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier load, then the full one adding what is new."""
    staged = _stored_stage(spark, sf_dir)
    path = sinks.scratch_path(spark, "dim-movies")
    commits.append_absent(_known_films(staged), path, "dim_movies", "movie_id")
    commits.append_absent(load.dim_movies(staged), path, "dim_movies", "movie_id")
    return commits.read_rows(spark, path, "dim_movies", load.dim_movies(staged).schema)


def _grown(spark: SparkSession, earlier: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """A dimension after an earlier and a later load."""
    path = sinks.scratch_path(spark, f"dim-{key}")
    commits.append_absent(earlier, path, "dimension", key)
    commits.append_absent(later, path, "dimension", key)
    return commits.read_rows(spark, path, "dimension", later.schema)


def _dim_movies_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Films under generated keys: releases before 1998 first, then all."""
    staged = _stored_stage(spark, sf_dir)
    path = sinks.scratch_path(spark, "keyed-films")
    load.append_movies(spark, path, staged.filter("year < 1998"))
    load.append_movies(spark, path, staged)
    return commits.read_rows(spark, path, "dim_movies", schemas.DIM_MOVIES)


def _fact_box_office_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of a star that was loaded in two increments, with generated film keys."""
    staged = _stored_stage(spark, sf_dir)
    path = sinks.scratch_path(spark, "keyed-star")
    load.load_increment(spark, path, staged.filter("year < 1998"), _macro(spark, sf_dir))
    load.load_increment(spark, path, staged, _macro(spark, sf_dir))
    return read_star(spark, path).fact


def _fact_reload_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star reloaded: even years had other votes, 1999 was missing, 1900 is gone."""
    star = testdata.star(spark, sf_dir)
    fact = sinks.hand_off(star.fact, "fact")
    even = F.col("date_key") % 2 == 0
    votes = F.when(even, F.col("vote_count") + 1).otherwise(F.col("vote_count"))
    before = fact.filter("date_key <> 1999").withColumn("vote_count", votes)
    gone = fact.filter("date_key = 1997").withColumn("date_key", F.lit(1900))
    path = sinks.scratch_path(spark, "reloaded-star")
    first = reload.reload_star(spark, path, replace(star, fact=before.unionByName(gone)))
    reload.reload_star(spark, path, replace(star, fact=fact))
    return reload.fact_origin(spark, path, first.version)


def _dim_date_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _stored_stage(spark, sf_dir)
    earlier = load.dim_date(staged.filter("year < 1998")).withColumn("decade", F.lit("earlier"))
    return _grown(spark, earlier, load.dim_date(staged), "date_key")


def _dim_macro_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = _rounded_rates(load.dim_macroeconomics(_macro(spark, sf_dir)))
    earlier = later.filter("year < 1990").withColumn("inflation_rate", F.lit(-1.0))
    return _grown(spark, earlier, later, "year")


def _dim_events_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = load.dim_events(_macro(spark, sf_dir))
    earlier = later.filter("event_year < 1990").withColumn("event_type", F.lit("earlier"))
    return _grown(spark, earlier, later, "event_year")


def _load_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _stored_stage(spark, sf_dir)
    return load.load_counters(staged, load.dim_movies(staged))


def _load_counters_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _stored_stage(spark, sf_dir)
    return load.load_counters(staged, _known_films(staged))


def _loaded_star_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw rows to a report."""
    star = load.load_star(_stored_stage(spark, sf_dir), _macro(spark, sf_dir))
    return reports.industry_baseline_trends(star)


def _stored_star_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star written as Parquet, opened again and reported on."""
    path = sinks.scratch_path(spark, "star")
    write_star(testdata.star(spark, sf_dir), path)
    return reports.industry_baseline_trends(read_star(spark, path), "Crisis")


# Integrity ------------------------------------------------------------------


def _dq_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the star, which are sound, and of staged films, which repeat."""
    films = _staged(spark, sf_dir).withColumnRenamed("id", "movie_id")
    staged = quality.duplicate_keys(films, "master_staging", "movie_id")
    return staged.unionByName(checks.repeated_keys(testdata.star(spark, sf_dir)))


def _load_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star without some films and years, loaded under its constraints: all fact rows, those
    that were let in without reasons."""
    path = sinks.scratch_path(spark, "checked-star")
    quarantine.load_checked(spark, path, _known_genres(spark, sf_dir))
    rejected = quarantine.read_rejected(spark, path, "fact")
    valid = read_star(spark, path).fact.withColumn("reasons", F.array().cast("array<string>"))
    return valid.unionByName(rejected).withColumn("reasons", F.array_join("reasons", "; "))


def _quarantine_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged films as a dimension: one row per id is let in, the others wait."""
    films = _staged(spark, sf_dir).select(
        F.col("id").alias("movie_key"), F.col("id").alias("movie_id"), "title", "seq"
    )
    checked = quarantine.checked_dimension(films, "movies", ["seq"])
    return checked.withColumn("reasons", F.array_join("reasons", "; "))


def _bucketed_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns by genre from a star whose fact and films are stored in buckets."""
    name = f"star_{uuid.uuid4().hex}"
    path = sinks.scratch_path(spark, "bucketed-star")
    write_bucketed_star(testdata.star(spark, sf_dir), name, path, buckets=8)
    return reports.genre_baselines(read_bucketed_star(spark, name))


def _partial(name: str, era: str = "All") -> Query:
    """A report from the partials of two loads, of odd and of even films."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = testdata.star(spark, sf_dir)
        odd = F.col("movie_key") % 2 == 1
        loads = [replace(star, fact=star.fact.filter(half)) for half in (odd, ~odd)]
        both = partials.together(*[partials.build_partials(load) for load in loads])
        report = partials.REPORTS[name](both, *([era] if era != "All" else []))
        if name == "vote_statistics":
            return report.withColumn("global_mean", round_half_up(F.col("global_mean"), 6))
        return report

    return query


def _partials_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials of two loads, stored one after the other and read back."""
    star = testdata.star(spark, sf_dir)
    path = sinks.scratch_path(spark, "partials")
    early = F.col("date_key") < 1998
    for part in (early, ~early):
        load = partials.build_partials(replace(star, fact=star.fact.filter(part)))
        partials.add_partials(spark, path, load)
    return partials.runtime_paradox(partials.read_partials(spark, path, star))


def _votes_by_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quantiles per decade: of whole numbers, of large ones and of real ones."""
    star = testdata.star(spark, sf_dir)
    rows = star.fact.join(star.dates.select("date_key", "decade"), "date_key")
    rows = sinks.hand_off(rows.select("decade", "vote_count", "revenue", "roi"), "decades")
    found = radix.quantile_by(rows, ["decade"], "vote_count", 0.6, "vote_quantile")
    for column, q in (("revenue", 0.25), ("roi", 0.9)):
        found = found.join(
            radix.quantile_by(rows, ["decade"], column, q, f"{column}_quantile"), "decade"
        )
    return found


def _roi_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median return per year and budget tier."""
    fact = testdata.star(spark, sf_dir).fact
    tiers = fact.withColumn("budget_tier", classify.budget_tier(F.col("budget")))
    return radix.quantile_by(tiers, ["date_key", "budget_tier"], "roi", 0.5, "median_roi")


def _dq_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns, and the optional ones that do have nulls."""
    star = testdata.star(spark, sf_dir, overviews=True)
    rates = ["gdp_growth_rate", "unemployment_rate", "inflation_rate"]
    return (
        checks.missing_values(star)
        .unionByName(quality.null_counts(star.movies, "dim_movies", ["genre", "overview"]))
        .unionByName(quality.null_counts(star.macro, "dim_macroeconomics", rates))
    )


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: yearly industry trends by economic era."""
    return _report("industry_baseline_trends")(spark, _SMOKE_DIR)


def queries() -> dict[str, Query]:
    """Every operator under its name."""
    registered: dict[str, Query] = {}
    for name in REPORTS:
        registered[name] = _report(name)
        if applies_era(name):
            registered[f"{name}_crisis"] = _report(name, "Crisis")
            registered[f"{name}_stable"] = _report(name, "Stable")
    registered |= {
        "vote_statistics": _vote_statistics,
        "economic_calendar": _economic_calendar,
        "film_flags": _film_flags,
        "format_currency": _format_currency,
        "executive_kpis": _reshaped(dashboard.executive_kpis, "industry_baseline_trends"),
        "crisis_blocks": _reshaped(dashboard.crisis_blocks, "production_density"),
        "crisis_blocks_crisis": _reshaped(dashboard.crisis_blocks, "production_density", "Crisis"),
        "streaming_blocks": _reshaped(dashboard.streaming_blocks, "runtime_paradox", shift=8),
        "runtime_premium": _reshaped(dashboard.runtime_premium, "runtime_paradox"),
        "top_genres_other": _reshaped(dashboard.top_genres_other, "decade_genre_share"),
        "top_genres_other_top3": _reshaped(dashboard.top_genres_other, "decade_genre_share", k=3),
        "decade_genre_matrix": _reshaped(dashboard.decade_genre_matrix, "decade_genre_share"),
        "top_genres_other_odd": _odd_genres,
        "profitability_split_unknown": _unknown_returns,
        "runtime_paradox_late": _reshaped(lambda report: report, "runtime_paradox", shift=20),
        "streaming_blocks_late": _reshaped(dashboard.streaming_blocks, "runtime_paradox", shift=20),
        "top_blockbusters_orphans": lambda spark, sf_dir: run_report(
            "top_blockbusters", _known_genres(spark, sf_dir)
        ),
        "top_movies_by_rating_orphans": lambda spark, sf_dir: run_report(
            "top_movies_by_rating", _known_genres(spark, sf_dir)
        ),
        "genre_baselines_rare": lambda spark, sf_dir: run_report(
            "genre_baselines", _title_genres(spark, sf_dir)
        ),
        "escapism_index_rare": lambda spark, sf_dir: run_report(
            "escapism_index", _title_genres(spark, sf_dir), many_genres=True
        ),
        "decade_genre_share_rare": lambda spark, sf_dir: run_report(
            "decade_genre_share", _title_genres(spark, sf_dir), many_genres=True
        ),
        "rating_histogram": _reshaped(dashboard.rating_histogram, "rating_kpis"),
        "escapism_pivot": _reshaped(dashboard.escapism_pivot, "escapism_index"),
        "budget_tier_pivot": _reshaped(dashboard.budget_tier_pivot, "budget_dilemma"),
        "film_csv_scan": _film_csv_scan,
        "film_csv_scan_split": _film_csv_scan_split,
        "clean_funnel_written": _clean_funnel_written,
        "title_tsv_scan": _title_tsv_scan,
        "clean_movies": _clean,
        "clean_funnel": lambda spark, sf_dir: clean.clean_funnel(_raw(spark, sf_dir)),
        "movie_titles": _titles,
        "stage_master": _staged,
        "macro_by_year": _macro_by_year,
        "macro_benchmark": _benchmark,
        "macro_enriched": lambda spark, sf_dir: _rounded_rates(_macro(spark, sf_dir)).drop("seq"),
        "dim_date": lambda spark, sf_dir: load.dim_date(_staged(spark, sf_dir)),
        "dim_movies": lambda spark, sf_dir: load.dim_movies(_staged(spark, sf_dir)),
        "dim_macroeconomics": lambda spark, sf_dir: _rounded_rates(
            load.dim_macroeconomics(_macro(spark, sf_dir))
        ),
        "dim_geopolitical_events": lambda spark, sf_dir: load.dim_events(_macro(spark, sf_dir)),
        "dim_movies_incremental": _dim_movies_incremental,
        "dim_movies_keyed": _dim_movies_keyed,
        "fact_box_office_keyed": _fact_box_office_keyed,
        "fact_reload_changed": _fact_reload_changed,
        "dim_date_incremental": _dim_date_incremental,
        "dim_macroeconomics_incremental": _dim_macro_incremental,
        "dim_events_incremental": _dim_events_incremental,
        "fact_box_office": lambda spark, sf_dir: load.load_star(
            _stored_stage(spark, sf_dir), _macro(spark, sf_dir)
        ).fact,
        "load_counters": _load_counters,
        "load_counters_known_films": _load_counters_known,
        "loaded_star_trends": _loaded_star_trends,
        "stored_star_trends": _stored_star_trends,
        "load_quarantine": _load_quarantine,
        "quarantine_films": _quarantine_films,
        "bucketed_genre_baselines": _bucketed_genres,
        "partials_stored_runtime": _partials_stored,
        "vote_statistics_by_decade": _votes_by_decade,
        "median_roi_by_tier": _roi_quantile,
        "dq_duplicate_keys": _dq_duplicate_keys,
        "dq_nulls": _dq_nulls,
        "dq_orphans_partial": lambda spark, sf_dir: checks.broken_references(
            _known_genres(spark, sf_dir)
        ),
        "dq_orphans": lambda spark, sf_dir: checks.broken_references(testdata.star(spark, sf_dir)),
    }
    for name, report in partials.REPORTS.items():
        registered[f"partials_{name}"] = _partial(name)
        if "era" in inspect.signature(report).parameters:
            registered[f"partials_{name}_crisis"] = _partial(name, "Crisis")
    if text_queries:
        registered |= text_queries.queries()
    return {name: _with_folder(query) for name, query in registered.items()}


def _with_folder(query: Query) -> Query:
    """Gives a local session without a shared folder one, for what queries store."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        local = spark.conf.get("spark.master", "").split("[")[0] == "local"
        if local and not sinks.shared_folder(spark):
            spark.conf.set(sinks.SHARED_FOLDER, tempfile.mkdtemp(prefix="eraframe-"))
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every registered query that SQL can express."""
    from oracle import all_sql

    return all_sql() | (text_queries.oracle_sql() if text_queries else {})
