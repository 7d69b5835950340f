"""The report library over the star schema.

Yearly reports group the fact first and meet the calendar afterwards, so the
only shuffle carries one row per task and year. Reports by genre go through
:func:`~eraframe.operators.joins.film_groups`. Top lists are cut after the
film attributes are looked up, so they are complete whatever films the dimension
lacks. Orders are total, so that equal values neither
change a result nor pile up in one sort task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraframe import constants as K
from eraframe.functions import classify
from eraframe.functions.rounding import round_half_up
from eraframe.functions.text import mentions_genre, primary_genre
from eraframe.operators.era import in_era, with_calendar
from eraframe.operators.joins import film_groups, group_mean
from eraframe.operators.quantile import quantile_of_counts
from eraframe.operators.series import trailing_rows, with_share, with_share_of_large
from eraframe.session import shuffle_tasks
from eraframe.sources import sinks
from eraframe.sources.star import Star


def _positive(*columns: str) -> Column:
    return reduce(and_, (F.col(name) > 0 for name in columns), F.lit(True))


def _rows(star: Star, *positive: str, era: str = "All") -> DataFrame:
    """Fact rows of an era with the given columns above zero."""
    return in_era(star.fact.filter(_positive(*positive)), star, era)


def _by_year(fact: DataFrame, *measures: Column) -> DataFrame:
    return fact.groupBy(F.col("date_key").alias("release_year")).agg(*measures)


def _mean(name: str, digits: int) -> Column:
    return round_half_up(F.avg(F.col(name).cast("double")), digits)


def _whole_mean(total: Column, rows: Column) -> Column:
    """Integer mean, cut towards zero."""
    return F.call_function("div", total, F.nullif(rows, F.lit(0)))


def industry_baseline_trends(star: Star, era: str = "All") -> DataFrame:
    """Yearly releases, money, net profit and mean return with the era."""
    fact = _rows(star, "revenue", "budget", era=era)
    yearly = _by_year(
        fact,
        F.count("movie_key").alias("movies_released"),
        F.sum("budget").alias("total_industry_budget"),
        F.sum("revenue").alias("total_box_office"),
        _mean("roi", 2).alias("avg_roi"),
    )
    return (
        with_calendar(yearly, star, "era_type")
        .select(
            "release_year",
            "movies_released",
            "total_industry_budget",
            "total_box_office",
            (F.col("total_box_office") - F.col("total_industry_budget")).alias("net_profit"),
            "avg_roi",
            "era_type",
        )
        .orderBy("release_year")
    )


def top_blockbusters(star: Star, n: int = 10) -> DataFrame:
    """Highest-grossing releases."""
    order = (F.desc("revenue"), "movie_key", "date_key", "budget", "vote_average")
    columns = ("movie_key", "date_key", "budget", "revenue", "roi", "vote_average")
    return (
        star.fact.select(*columns)
        .join(star.movies.select("movie_key", "title", "genre"), "movie_key")
        .orderBy(*order)
        .limit(n)
        .select(
            "title",
            F.col("date_key").alias("release_year"),
            "genre",
            "budget",
            "revenue",
            "roi",
            "vote_average",
        )
    )


def profitability_split(star: Star) -> DataFrame:
    """Releases and mean rating per profitability tier."""
    return (
        star.fact.filter(_positive("budget", "revenue"))
        .groupBy(classify.profitability_tier(F.col("roi")).alias("profitability_tier"))
        .agg(F.count(F.lit(1)).alias("movie_count"), _mean("vote_average", 2).alias("avg_rating"))
        .orderBy("profitability_tier")
    )


def _genres(star: Star) -> DataFrame:
    return star.movies.select("movie_key", primary_genre(F.col("genre")).alias("genre"))


def genre_baselines(star: Star, min_films: int = K.MIN_GENRE_FILMS) -> DataFrame:
    """Money and return per primary genre with more than ``min_films`` releases."""
    fact = star.fact.filter(_positive("budget", "revenue"))
    return (
        film_groups(fact, _genres(star), means=["budget", "revenue", "roi"])
        .groupBy("genre")
        .agg(
            F.sum("films").alias("total_movies"),
            round_half_up(group_mean("budget"), 0).alias("avg_budget"),
            round_half_up(group_mean("revenue"), 0).alias("avg_revenue"),
            round_half_up(group_mean("roi"), 2).alias("avg_roi"),
        )
        .filter(F.col("total_movies") > min_films)
        .orderBy(F.desc("avg_revenue"), "genre")
    )


def escapism_index(star: Star, era: str = "All", many_genres: bool = False) -> DataFrame:
    """Revenue of each primary genre and its share of the year.

    ``many_genres`` is for genres so many that those of a year do not fit into a task.
    """
    # The calendar has no unknown year; said here, it holds for the rows and the totals alike.
    fact = _rows(star, "revenue", era=era).filter(F.col("date_key").isNotNull())
    genres = (
        film_groups(fact, _genres(star), ["date_key"], totals=["revenue"])
        .groupBy(F.col("date_key").alias("release_year"), "genre")
        .agg(F.sum("revenue_total").alias("total_revenue"))
    )
    add_share = with_share_of_large if many_genres else with_share
    shares = add_share(
        genres, ["release_year"], "total_revenue", "year_total_revenue", "market_share_pct"
    )
    return (
        with_calendar(shares, star, "era_type")
        .select(
            "release_year",
            "genre",
            "era_type",
            "total_revenue",
            "year_total_revenue",
            "market_share_pct",
        )
        .orderBy("release_year", "era_type", F.desc("market_share_pct"), "genre")
    )


def budget_dilemma(star: Star, era: str = "All") -> DataFrame:
    """Releases and means per year and budget tier."""
    fact = _rows(star, "budget", era=era)
    tiers = fact.groupBy(
        F.col("date_key").alias("release_year"),
        classify.budget_tier(F.col("budget")).alias("budget_tier"),
    ).agg(
        F.count(F.lit(1)).alias("film_count"),
        _mean("budget", 0).alias("avg_budget"),
        _mean("revenue", 0).alias("avg_revenue"),
        _mean("roi", 2).alias("avg_roi"),
    )
    return (
        with_calendar(tiers, star, "era_type", "gdp_growth_rate")
        .select(
            "release_year",
            "budget_tier",
            "era_type",
            "film_count",
            "avg_budget",
            "avg_revenue",
            "avg_roi",
            "gdp_growth_rate",
        )
        .orderBy("release_year", "budget_tier")
    )


def comedy_paradox(star: Star, era: str = "All") -> DataFrame:
    """Yearly comedy revenue and rating with their plain five-row means."""
    fact = _rows(star, "revenue", era=era)
    comedies = star.movies.filter(mentions_genre(F.col("genre"), "comedy")).select("movie_key")
    yearly = (
        film_groups(fact, comedies, ["date_key"], totals=["revenue"], means=["vote_average"])
        .groupBy(F.col("date_key").alias("release_year"))
        .agg(
            F.sum("films").alias("comedy_film_count"),
            F.sum("revenue_total").alias("total_revenue"),
            round_half_up(group_mean("vote_average"), 3).alias("avg_vote_average"),
        )
    )
    five = trailing_rows("release_year")
    # The yearly rating has three decimals: summed as a decimal, its mean is exact.
    rating = F.col("avg_vote_average").cast("decimal(18,3)")
    return (
        with_calendar(yearly, star, "unemployment_rate")
        .select(
            "release_year",
            "comedy_film_count",
            "total_revenue",
            "avg_vote_average",
            "unemployment_rate",
            F.avg(F.col("total_revenue").cast("double")).over(five).alias("ma5_revenue"),
            F.try_divide(
                F.sum(rating).over(five).cast("double"), F.count(rating).over(five)
            ).alias("ma5_rating"),
        )
        .orderBy("release_year")
    )


def runtime_paradox(
    star: Star, era: str = "All", top: int = K.TOP_FILMS_PER_YEAR
) -> DataFrame:
    """Yearly runtime of all and of the ``top`` films, with film-weighted five-row means.

    Two branches: a plain yearly sum, and a ranking whose limit is applied in
    every task before the shuffle by year.
    """
    fact = in_era(star.fact, star, era)
    movies = star.movies.filter("runtime > 0").select("movie_key", "runtime")
    minutes = F.col("runtime").cast("bigint")
    every = (
        film_groups(fact, movies, ["date_key"])
        .groupBy(F.col("date_key").alias("release_year"))
        .agg(F.sum(minutes * F.col("films")).alias("all_sum"), F.sum("films").alias("all_films"))
    )
    by_revenue = Window.partitionBy("date_key").orderBy(F.desc("revenue"), "movie_key")
    best = (
        fact.select("movie_key", "date_key", "revenue")
        .join(movies, "movie_key")
        .withColumn("revenue_rank", F.row_number().over(by_revenue))
        .filter(F.col("revenue_rank") <= top)
        .groupBy(F.col("date_key").alias("release_year"))
        .agg(F.sum(minutes).alias("top_sum"), F.count("runtime").alias("top_films"))
    )
    five = trailing_rows("release_year")

    def mean(total: Column, films: Column) -> Column:
        return round_half_up(F.try_divide(total.cast("double"), films), 2)

    def moving(total: str, films: str) -> Column:
        return mean(F.sum(total).over(five), F.sum(films).over(five))

    return (
        with_calendar(every.join(best, "release_year"), star, "era_type")
        .select(
            "release_year",
            mean(F.col("all_sum"), F.col("all_films")).alias("avg_runtime_all"),
            mean(F.col("top_sum"), F.col("top_films")).alias("avg_runtime_top100"),
            moving("all_sum", "all_films").alias("ma5_runtime_all"),
            moving("top_sum", "top_films").alias("ma5_runtime_top100"),
            classify.streaming_era(F.col("release_year")).alias("streaming_era_flag"),
            "era_type",
        )
        .orderBy("release_year")
    )


def _film_rows(fact: DataFrame, movies: DataFrame) -> DataFrame:
    """Film attributes on every fact row; a hot film is split by the engine."""
    return fact.join(movies, "movie_key").withColumnRenamed("date_key", "release_year")


# Breaks ties between the rows of one film, so that a sort can split them.
_ROW_ORDER = ("movie_key", "revenue", "budget", "vote_count", "roi")


def _sorted(df: DataFrame, ordered: bool, *order: str | Column) -> DataFrame:
    return df.orderBy(*order, *_ROW_ORDER) if ordered else df


def sentiment_corpus(star: Star, ordered: bool = True) -> DataFrame:
    """Overview texts with year, decade and era for text analysis.

    The releases of a film in a year are equal here, so they are counted first and meet the
    calendar without their texts. A text joins them once per film, with all its years in
    one array, and per 1,024 releases where there are more when rows are ordered; the rows
    of the result are spelled out at the end, in their order.
    """
    movies = star.movies.filter(classify.has_overview(F.col("overview")))
    dates = star.dates.select(
        F.col("date_key").alias("release_year"), "decade"
    )
    counted = star.fact.groupBy("movie_key", F.col("date_key").alias("release_year")).agg(
        F.count(F.lit(1)).alias("releases")
    )
    # A row per year: met by a shuffle, the counts of a year would fill one task.
    years = with_calendar(dates, star, "gdp_growth_rate", "era_type")
    counted = counted.join(F.broadcast(years), "release_year")
    if ordered and sinks.shared_folder(counted.sparkSession):
        counted = sinks.hand_off(counted, "corpus-years")
    per_year = F.struct("release_year", "decade", "gdp_growth_rate", "era_type", "releases")
    of_film = counted.groupBy("movie_key").agg(
        F.max("releases").alias("most"), F.collect_list(per_year).alias("years")
    )
    films = of_film.join(movies, "movie_key").select(
        "movie_key", "movie_id", "title", "genre", "overview", "most", "years"
    )
    rows = _by_year_and_film(films, counted) if ordered else _spread(films)
    held = F.least(
        F.col("releases") - F.col("part") * K.RELEASES_AT_ONCE, F.lit(K.RELEASES_AT_ONCE)
    )
    columns = (
        "movie_id",
        "title",
        "release_year",
        "genre",
        "overview",
        "decade",
        "gdp_growth_rate",
        "era_type",
    )
    # None for a part of a film that this year does not reach.
    each = F.explode(F.array_repeat(F.lit(True), F.greatest(held, F.lit(0)).cast("int")))
    return rows.select(*columns, each.alias("release")).drop("release")


_TEXTS = ("movie_key", "movie_id", "title", "genre", "overview")


def _parts(releases: str) -> Column:
    last = F.floor((F.col(releases) - 1) / K.RELEASES_AT_ONCE)
    return F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")


def _spread(films: DataFrame) -> DataFrame:
    """A row per film and year, and per 1,024 releases where there are more."""
    rows = films.select(*_TEXTS, F.explode("years").alias("of")).select(*_TEXTS, "of.*")
    return rows.select("*", _parts("releases"))


def _by_year_and_film(films: DataFrame, counted: DataFrame) -> DataFrame:
    """The same rows in the order of year, film and part.

    Where films have releases in few of the years, the rows are sorted. Else that would move a text
    once per year: it is dealt out by film once, and every year reads it there.
    """
    pairs, distinct, years = counted.agg(
        F.count(F.lit(1)),
        F.approx_count_distinct("movie_key"),
        F.array_sort(F.collect_set("release_year")),
    ).first()
    few = pairs <= K.SORTED_COPIES * distinct or len(years) * distinct > K.READS_OF_COPY * pairs
    if few:
        return _spread(films).orderBy("release_year", "movie_key", "part")
    # Always true. The random number keeps the optimizer from copying the frame into every year; copies
    # need not look alike to the engine, and each would then deal out its own texts.
    parts = films.select(*_TEXTS, "years", _parts("most")).filter(F.rand(0) >= 0)
    tasks = min(-(-distinct // K.FILMS_AT_ONCE), K.FILM_TASKS)
    number = [tasks] if tasks > shuffle_tasks(films.sparkSession) else []
    dealt = parts.repartitionByRange(*number, "movie_key", "part")
    # Without the key, so that the union appends the tasks of a year to those before. The year is told by an
    # array, not by a filter, which would be moved below the exchange.
    of_year = """SELECT movie_id, title, genre, overview, part, own.* FROM (
      SELECT *, explode(filter(years, own -> own.release_year = {})) AS own FROM dealt
      SORT BY movie_key, part)"""
    every = " UNION ALL ".join(map(of_year.format, years))
    return films.sparkSession.sql(f"WITH dealt AS (SELECT * FROM {{dealt}}) {every}", dealt=dealt)


def financial_kpis(star: Star) -> DataFrame:
    """Yearly money, mean return and number of high returns."""
    yearly = _by_year(
        _rows(star, "budget", "revenue"),
        F.count(F.lit(1)).alias("total_films"),
        F.sum("budget").alias("total_budget"),
        F.sum("revenue").alias("total_revenue"),
        _mean("roi", 2).alias("avg_roi_pct"),
        F.count_if(F.col("roi") > K.HIGH_ROI).alias("high_roi_films"),
    )
    return with_calendar(yearly, star, "gdp_growth_rate", "inflation_rate").orderBy("release_year")


def vote_statistics(fact: DataFrame, q: float = K.VOTE_QUANTILE) -> DataFrame:
    """Mean rating and exact vote-count quantile of rated releases, as one row."""
    counts = (
        fact.filter("vote_count > 0")
        .groupBy("vote_count")
        .agg(
            F.count(F.lit(1)).alias("films"),
            F.sum("vote_average").alias("rating_sum"),
            F.count("vote_average").alias("rated"),
        )
    )
    totals = ["rating_sum", "rated"]
    return quantile_of_counts(counts, "vote_count", "films", q, totals).select(
        F.try_divide("total_rating_sum", "total_rated").alias("global_mean"),
        F.col("quantile").alias("min_votes"),
    )


def rating_kpis(star: Star, q: float = K.VOTE_QUANTILE, ordered: bool = True) -> DataFrame:
    """Weighted rating of every rated release."""
    # A column of its own, so that the one-row subquery runs once.
    stats = vote_statistics(star.fact, q).select(F.struct("min_votes", "global_mean")).scalar()
    rows = with_calendar(
        _film_rows(
            star.fact.filter("vote_count > 0"), star.movies.select("movie_key", "title", "genre")
        ),
        star,
        "era_type",
        "gdp_growth_rate",
    ).withColumn("stats", stats)
    votes, prior = F.col("vote_count").cast("double"), F.col("stats.min_votes")
    weight = votes / (votes + prior)
    mean_weight = prior / (votes + prior)
    weighted = weight * F.col("vote_average") + mean_weight * F.col("stats.global_mean")
    rows = rows.withColumn("weighted_rating", round_half_up(weighted, 3))
    return _sorted(rows, ordered, "release_year", F.desc("weighted_rating")).select(
        "release_year",
        "title",
        "genre",
        "vote_average",
        "vote_count",
        "weighted_rating",
        "era_type",
        "gdp_growth_rate",
    )


def decade_genre_share(star: Star, many_genres: bool = False) -> DataFrame:
    """Releases of each primary genre and their share of the decade.

    ``many_genres`` is for genres so many that those of a decade do not fit into a task.
    """
    dates = star.dates.select("date_key", "decade")
    genres = (
        film_groups(star.fact, _genres(star), ["date_key"])
        .join(dates, "date_key")
        .groupBy("decade", "genre")
        .agg(F.sum("films").alias("film_count"))
    )
    add_share = with_share_of_large if many_genres else with_share
    return add_share(
        genres, ["decade"], "film_count", "decade_total_films", "genre_share_pct"
    ).orderBy("decade", F.desc("genre_share_pct"), "genre")


def production_density(star: Star, era: str = "All") -> DataFrame:
    """Yearly output and means with the economy; every release counts."""
    yearly = _by_year(
        _rows(star, era=era),
        F.count(F.lit(1)).alias("total_films"),
        _mean("budget", 0).alias("avg_budget"),
        _mean("revenue", 0).alias("avg_revenue"),
    )
    return with_calendar(
        yearly, star, "gdp_growth_rate", "unemployment_rate", "era_type"
    ).orderBy("release_year")


def macro_impact_data(star: Star, ordered: bool = True) -> DataFrame:
    """Film rows with a flag for economic-crisis events."""
    rows = with_calendar(
        _film_rows(star.fact, star.movies.select("movie_key", "genre")),
        star,
        "event_type",
        "gdp_growth_rate",
    )
    return _sorted(rows, ordered, "release_year").select(
        "release_year",
        "budget",
        "revenue",
        F.col("genre").alias("genres"),
        classify.crisis_event_flag(F.col("event_type")).alias("is_crisis_year"),
        "gdp_growth_rate",
    )


def budget_elasticity(star: Star) -> DataFrame:
    """Yearly investment beside growth and unemployment."""
    yearly = _by_year(
        star.fact.filter(_positive("budget")),
        F.sum(F.col("budget").cast("double")).alias("total_industry_investment"),
        _mean("budget", 0).alias("avg_movie_budget"),
    )
    return with_calendar(yearly, star, "gdp_growth_rate", "unemployment_rate").orderBy(
        "release_year"
    )


def comedy_horror_paradox(star: Star) -> DataFrame:
    """Comedy against horror in loose crisis and stable years."""
    genre = F.col("genre")
    # Asked for by name, so that the engine sees a choice of films and can filter the fact by it.
    either = mentions_genre(genre, "comedy") | mentions_genre(genre, "horror")
    movies = star.movies.filter(either).select(
        "movie_key", classify.comedy_or_horror(genre).alias("analyzed_genre")
    )
    yearly = film_groups(
        _rows(star),
        movies,
        ["date_key"],
        totals=["revenue", "budget"],
        means=["budget", "vote_average", "roi"],
    ).withColumnRenamed("date_key", "release_year")
    return (
        with_calendar(yearly, star, "economic_climate")
        .groupBy("economic_climate", "analyzed_genre")
        .agg(
            F.sum("films").alias("movies_produced"),
            F.sum("revenue_total").alias("total_genre_revenue"),
            _whole_mean(F.sum("budget_total"), F.sum("budget_known")).alias("avg_production_budget"),
            round_half_up(group_mean("vote_average"), 2).alias("avg_audience_rating"),
            round_half_up(group_mean("roi"), 2).alias("avg_roi"),
        )
        .orderBy(F.desc("economic_climate"), "analyzed_genre")
    )


def gdp_vs_movie_revenue(star: Star, era: str = "All") -> DataFrame:
    """Yearly box office beside economic growth."""
    yearly = _by_year(
        _rows(star, "revenue", "budget", era=era),
        F.sum("revenue").alias("total_box_office"),
        F.count("movie_key").alias("movies_released"),
        _whole_mean(F.sum("revenue"), F.count("revenue")).alias("avg_movie_revenue"),
        (F.sum("revenue") - F.sum("budget")).alias("total_net_profit"),
    )
    return (
        with_calendar(yearly, star, "gdp_growth_rate")
        .select(
            "release_year",
            "gdp_growth_rate",
            "total_box_office",
            "movies_released",
            "avg_movie_revenue",
            "total_net_profit",
        )
        .orderBy("release_year")
    )


def budget_vs_revenue(star: Star, ordered: bool = True) -> DataFrame:
    """Film rows for budget and revenue scatter plots."""
    rows = _film_rows(
        star.fact.filter(_positive("budget", "revenue")), star.movies.select("movie_key", "title")
    )
    return _sorted(rows, ordered, F.desc("release_year"), F.desc("revenue")).select(
        "release_year",
        F.col("title").alias("movie_title"),
        "budget",
        "revenue",
        "roi",
        F.col("vote_average").alias("audience_rating"),
        "popularity",
    )


def crisis_timeline_overlay(star: Star, era: str = "All") -> DataFrame:
    """Yearly money with the event of the year; years without macro data stay."""
    yearly = _by_year(
        _rows(star, "revenue", "budget", era=era),
        F.count("movie_key").alias("movies_released"),
        F.sum("budget").alias("total_budget"),
        F.sum("revenue").alias("total_box_office"),
        _mean("roi", 2).alias("avg_movie_roi"),
        _mean("popularity", 2).alias("avg_voter_popularity"),
    )
    events = star.events.withColumnRenamed("event_year", "release_year")
    return (
        yearly.join(events, "release_year", "left")
        .select(
            "release_year",
            F.coalesce("event_name", F.lit(K.NO_EVENT_NAME)).alias("historical_event"),
            F.coalesce("event_type", F.lit(K.NO_EVENT_CATEGORY)).alias("event_category"),
            "movies_released",
            "total_budget",
            "total_box_office",
            "avg_movie_roi",
            "avg_voter_popularity",
        )
        .orderBy("release_year")
    )


def top_movies_by_rating(
    star: Star, min_votes: int = K.MIN_LOADED_VOTES, era: str = "All", n: int = 20
) -> DataFrame:
    """Best-rated releases with at least ``min_votes`` votes."""
    order = (F.desc("vote_average"), F.desc("vote_count"), *_ROW_ORDER[:3], "date_key", "popularity")
    columns = (
        "movie_key", "date_key", "vote_average", "vote_count", "revenue", "budget", "popularity",
    )
    return (
        in_era(star.fact.filter(F.col("vote_count") >= min_votes), star, era)
        .select(*columns)
        .join(star.movies.select("movie_key", "title", "genre"), "movie_key")
        .orderBy(*order)
        .limit(n)
        .select(
            F.col("title").alias("movie_title"),
            F.col("date_key").alias("release_year"),
            "genre",
            F.col("vote_average").alias("audience_rating"),
            F.col("vote_count").alias("total_votes"),
            "revenue",
            "popularity",
        )
    )


def genre_performance_summary(star: Star) -> DataFrame:
    """Money, return and rating per primary genre, small genres included."""
    fact = star.fact.filter(_positive("budget", "revenue"))
    return (
        film_groups(fact, _genres(star), means=["budget", "revenue", "roi", "vote_average"])
        .groupBy(F.col("genre").alias("primary_genre"))
        .agg(
            F.sum("films").alias("film_count"),
            round_half_up(group_mean("budget"), 0).alias("avg_budget"),
            round_half_up(group_mean("revenue"), 0).alias("avg_revenue"),
            round_half_up(group_mean("roi"), 2).alias("avg_roi"),
            round_half_up(group_mean("vote_average"), 2).alias("avg_audience_rating"),
        )
    )


def inflation_adjusted_profit(star: Star, era: str = "All") -> DataFrame:
    """Yearly profit divided by the inflation rate; null where the rate is 0."""
    yearly = _by_year(
        _rows(star, "revenue", "budget", era=era),
        F.sum("revenue").alias("total_revenue"),
        F.sum("budget").alias("total_budget"),
    )
    profit = (F.col("total_revenue") - F.col("total_budget")).cast("double")
    return (
        with_calendar(yearly, star, "inflation_rate")
        .withColumn("inflation_adjusted_profit", F.try_divide(profit, F.col("inflation_rate")))
        .orderBy("release_year")
    )
