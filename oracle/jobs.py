"""Cleaning, staging, enrichment, loading and integrity checks in SQL.

Only the spelling of the raw inputs is shared with the library; everything
computed from them is written again.
"""

from __future__ import annotations

from eraframe.constants import CURATED_EVENTS, UNEMPLOYMENT_FALLBACK
from eraframe.sources.testdata import (
    BASICS_LINES_SQL,
    INDICATORS_SQL,
    RATINGS_LINES_SQL,
    RAW_FILMS_SQL,
)
from oracle.reports import rounded, star, whole

_TABLES = {t: t for t in ("orders", "lineitem", "documents")}

RAW = f"raw AS ({RAW_FILMS_SQL.format(**_TABLES)})"
BASICS = f"basics AS ({BASICS_LINES_SQL.format(**_TABLES)})"
RATINGS = f"ratings AS ({RATINGS_LINES_SQL.format(**_TABLES)})"
SERIES = f"series AS ({INDICATORS_SQL.format(**_TABLES)})"


def digits(text: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, '[0-9]+'), '') AS BIGINT)"


PREPARED = rf"""{RAW}, prepared AS (
  SELECT * EXCLUDE (release_date), {digits('imdb_id')} AS imdb_id_cleaned,
    CAST(TRY_STRPTIME(release_date, '%Y-%m-%d') AS DATE) AS release_date
  FROM raw
)"""

_CHECKS = [
    "imdb_id_cleaned IS NOT NULL",
    "coalesce(runtime, 0) > 0",
    "least(coalesce(budget, 0), coalesce(revenue, 0)) > 0",
    "greatest(budget, revenue) <= 4000000000",
    "vote_count > 0 AND vote_average > 0",
    "coalesce(year(release_date), 0) BETWEEN 1970 AND 2024",
]
_CHECK_NAMES = [
    "imdb id present",
    "runtime above zero",
    "budget and revenue above zero",
    "budget and revenue within cap",
    "rated",
    "release year in range",
]

# The source has only plain spaces around its values.
CLEAN = rf"""{PREPARED}, clean AS (
  SELECT seq, id, imdb_id_cleaned,
    CASE WHEN trim(title)[1] IN ('"', '''') AND trim(title)[-1] IN ('"', '''')
      THEN trim(trim(title)[2:-2]) ELSE trim(title) END AS title,
    CAST(year(release_date) AS INT) AS year, release_date, budget, revenue, runtime, vote_average,
    vote_count, overview,
    coalesce(
      nullif(array_to_string(list_filter(
        CASE WHEN trim(genres) LIKE '[%]'
          THEN json_extract_string(TRY_CAST(replace(genres, '''', '"') AS JSON), '$[*].name') END,
        lambda n: n IS NOT NULL), ', '), ''),
      nullif(array_to_string(list_filter(list_transform(
        string_split(replace(genres, '|', ','), ','), lambda n: trim(n)), lambda n: n <> ''), ', '), ''),
      'Unknown') AS genres
  FROM prepared WHERE {' AND '.join(f'({c})' for c in _CHECKS)}
)"""


def fields(source: str, names: list[str], width: int) -> str:
    picked = ", ".join(
        f"nullif(p[{position}], concat(chr(92), 'N')) AS {name}"
        for position, name in enumerate(names, start=1)
        if name
    )
    return f"SELECT {picked} FROM (SELECT string_split(value, chr(9)) AS p FROM {source}) WHERE len(p) <= {width}"


BASICS_FIELDS = ["tconst", "titleType", "primaryTitle", "", "", "", "", "runtimeMinutes", "genres"]

TITLES = f"""{BASICS}, {RATINGS},
b AS ({fields('basics', BASICS_FIELDS, 9)}),
r AS ({fields('ratings', ['tconst', 'averageRating', 'numVotes'], 3)}),
titles AS (
  SELECT {digits('b.tconst')} AS imdb_id_cleaned, runtimeMinutes,
    TRY_CAST(averageRating AS DOUBLE) AS rating, TRY_CAST(numVotes AS BIGINT) AS votes
  FROM b JOIN r ON {digits('b.tconst')} = {digits('r.tconst')} WHERE trim(titleType) = 'movie'
)"""


def half_even(value: str) -> str:
    """Whole number, ties to even."""
    return f"""CAST(CASE WHEN {value} - floor({value}) = 0.5 THEN 2 * round(floor({value} + 0.5) / 2 - 0.25)
      ELSE round({value}) END AS BIGINT)"""


STAGED = f"""{CLEAN}, {TITLES}, staged AS (
  SELECT seq, id, c.imdb_id_cleaned, title, year, release_date,
    {half_even('budget')} AS budget, {half_even('revenue')} AS revenue,
    CAST(runtime AS INT) AS runtime, overview, genres, vote_average AS tmdb_rating,
    vote_count AS tmdb_votes, rating AS imdb_rating, votes AS imdb_votes
  FROM clean c LEFT JOIN titles t ON t.imdb_id_cleaned = c.imdb_id_cleaned
  WHERE coalesce(votes, 10) >= 10
)"""

LOADED = f"""{STAGED}, loaded AS (SELECT * FROM staged WHERE imdb_votes >= 1000),
dim_movies AS (
  SELECT id AS movie_key, id AS movie_id, title, genres AS genre, runtime,
    coalesce(overview, '') AS overview
  FROM loaded QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1
), box_office AS (
  SELECT id AS movie_key, year AS date_key, budget, revenue,
    CAST(revenue - budget AS DOUBLE) / budget AS roi, coalesce(imdb_rating, 0) AS vote_average,
    CAST(imdb_votes AS INT) AS vote_count,
    {rounded('''(imdb_votes * coalesce(imdb_rating, 0)
      + 1000 * (SELECT avg(imdb_rating) FROM loaded)) / (imdb_votes + 1000)''', 3)} AS popularity
  FROM loaded
)"""

# Films under generated keys after a load of the releases before 1998 and one of all.
KEYED = f"""{LOADED}, early AS (
  SELECT id AS movie_id, title, genres AS genre, runtime, coalesce(overview, '') AS overview
  FROM loaded WHERE year < 1998 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1
), both_loads AS (
  SELECT 1 AS load_no, * FROM early UNION ALL
  SELECT 2, * EXCLUDE (movie_key) FROM dim_movies WHERE movie_id NOT IN (SELECT movie_id FROM early)
), keyed AS (
  SELECT row_number() OVER (ORDER BY load_no, movie_id) AS movie_key, * EXCLUDE (load_no)
  FROM both_loads
)"""

EVENTS = "events(seq, year, event_name, event_type) AS (VALUES {})".format(
    ", ".join(
        f"({seq}, {year}, '{name}', '{kind}')"
        for seq, (year, name, kind) in enumerate(CURATED_EVENTS, start=1)
    )
)
FALLBACK = "fallback(year, rate) AS (VALUES {})".format(
    ", ".join(f"({year}, CAST({rate} AS DOUBLE))" for year, rate in UNEMPLOYMENT_FALLBACK.items())
)

WIDE = f"""{SERIES}, wide AS (
  SELECT year, i.value AS inflation_rate, g.value AS gdp_growth, u.value AS unemployment_rate
  FROM (FROM series SELECT year, value WHERE indicator LIKE 'FP%') i
    FULL JOIN (FROM series SELECT year, value WHERE indicator LIKE 'NY%') g USING (year)
    FULL JOIN (FROM series SELECT year, value WHERE indicator LIKE 'SL%') u USING (year)
)"""
FILLED = f"""{WIDE}, {EVENTS}, {FALLBACK}, filled AS (
  SELECT year, inflation_rate, gdp_growth, coalesce(unemployment_rate, rate) AS unemployment_rate,
    coalesce(event_name, 'Stable Period') AS event_name,
    coalesce(event_type, 'Stable Period') AS event_type, seq
  FROM wide LEFT JOIN events USING (year) LEFT JOIN fallback USING (year)
), bench AS (
  SELECT {", ".join(f"{rounded(f'avg({c})', 8)} AS {c}" for c in ('inflation_rate', 'gdp_growth', 'unemployment_rate'))}
  FROM (FROM filled WHERE event_name = 'Stable Period' AND year < 2025 AND inflation_rate IS NOT NULL
    AND gdp_growth IS NOT NULL AND unemployment_rate IS NOT NULL ORDER BY year DESC LIMIT 5)
), enriched AS (
  SELECT year, if(year = 2025, b.inflation_rate, f.inflation_rate) AS inflation_rate,
    if(year = 2025, b.gdp_growth, f.gdp_growth) AS gdp_growth,
    if(year = 2025, b.unemployment_rate, f.unemployment_rate) AS unemployment_rate,
    event_name, event_type, seq
  FROM filled f CROSS JOIN bench b
)"""


def _null_counts(table: str, source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM {source}"
        for c in columns
    )


def _orphans(table: str, dim: str, key: str, foreign_key: str) -> str:
    return f"""SELECT '{table}' AS dim_table, '{foreign_key}' AS foreign_key,
  CAST({foreign_key} AS VARCHAR) AS key_value, count(*) AS row_count
FROM fact WHERE {foreign_key} NOT IN (SELECT {key} FROM {dim}) GROUP BY {foreign_key}"""


def job_sql() -> dict[str, str]:
    funnel = [f"SELECT 0 AS step_no, 'source' AS step, count(*) AS row_count FROM prepared"]
    for i, name in enumerate(_CHECK_NAMES, start=1):
        passed = " AND ".join(f"({c})" for c in _CHECKS[:i])
        funnel.append(f"SELECT {i}, '{name}', count(*) FROM prepared WHERE {passed}")
    funnel.append(f"SELECT 7, 'dropped', count(*) - (SELECT count(*) FROM clean) FROM prepared")
    fact_star = f"{star()}, movie_ids AS (SELECT movie_key FROM movies), years AS (SELECT year FROM macro)"
    return {
        "film_csv_scan": f"WITH {RAW} SELECT * EXCLUDE (seq) REPLACE (nullif(genres, '') AS genres) FROM raw",
        "title_tsv_scan": f"WITH {BASICS} " + fields("basics", BASICS_FIELDS, 9),
        "clean_movies": f"WITH {CLEAN} SELECT * FROM clean",
        "clean_funnel": f"WITH {CLEAN} " + " UNION ALL ".join(funnel),
        "movie_titles": f"""WITH {TITLES}
SELECT imdb_id_cleaned, runtimeMinutes, rating AS averageRating, votes AS numVotes FROM titles""",
        "stage_master": f"WITH {STAGED} SELECT * FROM staged",
        "macro_by_year": f"WITH {WIDE} SELECT * FROM wide",
        "macro_benchmark": f"WITH {FILLED} SELECT * FROM bench",
        "macro_enriched": f"""WITH {FILLED}
SELECT * EXCLUDE (seq) REPLACE ({rounded('inflation_rate', 8)} AS inflation_rate,
  {rounded('gdp_growth', 8)} AS gdp_growth, {rounded('unemployment_rate', 8)} AS unemployment_rate)
FROM enriched""",
        "dim_date": f"""WITH {LOADED}
SELECT DISTINCT year AS date_key, year AS release_year,
  concat(CAST(year // 10 AS VARCHAR), '0s') AS decade FROM loaded""",
        "dim_movies": f"WITH {LOADED} SELECT * FROM dim_movies",
        "dim_macroeconomics": f"""WITH {FILLED}
SELECT DISTINCT year, {rounded('gdp_growth', 8)} AS gdp_growth_rate,
  {rounded('unemployment_rate', 8)} AS unemployment_rate, {rounded('inflation_rate', 8)} AS inflation_rate
FROM enriched""",
        "dim_geopolitical_events": f"""WITH {FILLED}
SELECT year AS event_year, arg_min(event_name, coalesce(seq, 0)) AS event_name,
  arg_min(event_type, coalesce(seq, 0)) AS event_type FROM enriched GROUP BY year""",
        "fact_box_office": f"WITH {LOADED} SELECT * FROM box_office",
        "load_counters": f"""WITH {LOADED}
SELECT count(*) FILTER (year > 0 AND id IN (SELECT movie_id FROM dim_movies)) AS inserted,
  count(*) FILTER (NOT coalesce(year > 0 AND id IN (SELECT movie_id FROM dim_movies), false)) AS skipped
FROM loaded""",
        "load_counters_known_films": f"""WITH {LOADED}, known AS (
  SELECT DISTINCT id FROM loaded WHERE year < 1998)
SELECT count(*) FILTER (id IN (FROM known)) AS inserted,
  count(*) FILTER (id NOT IN (FROM known)) AS skipped FROM loaded""",
        "dim_movies_incremental": f"""WITH {LOADED}, early AS (
  SELECT id AS movie_key, id AS movie_id, title, genres AS genre, runtime,
    coalesce(overview, '') AS overview
  FROM loaded WHERE year < 1998 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)
FROM early UNION ALL FROM dim_movies WHERE movie_id NOT IN (SELECT movie_id FROM early)""",
        "dim_movies_keyed": f"""WITH {KEYED} SELECT * FROM keyed""",
        "fact_box_office_keyed": f"""WITH {KEYED}
SELECT b.* REPLACE (k.movie_key AS movie_key)
FROM box_office b JOIN keyed k ON k.movie_id = b.movie_key""",
        "fact_reload_changed": f"""{star()}
SELECT movie_key, date_key, budget, revenue, roi, vote_average, vote_count, popularity,
  date_key % 2 = 0 OR date_key = 1999 AS reloaded FROM fact""",
        "loaded_star_trends": f"""WITH {LOADED}, {FILLED}, cal AS (
  SELECT year, any_value(gdp_growth) AS gdp, any_value(unemployment_rate) AS unemp,
    bool_or(event_type = 'Economic Crisis') AS crisis FROM enriched GROUP BY year)
SELECT date_key AS release_year, count(*) AS movies_released,
  {whole('sum(budget)')} AS total_industry_budget, {whole('sum(revenue)')} AS total_box_office,
  {whole('sum(revenue) - sum(budget)')} AS net_profit, {rounded('avg(roi)', 2)} AS avg_roi,
  if(any_value(gdp) < 0 OR any_value(unemp) > 8 OR any_value(crisis), 'Crisis', 'Stable') AS era_type
FROM box_office JOIN cal ON cal.year = date_key WHERE revenue > 0 AND budget > 0 GROUP BY date_key""",
        "dq_duplicate_keys": f"""WITH {STAGED}
SELECT 'master_staging' AS table_name, 'movie_id' AS key_column, CAST(id AS VARCHAR) AS key_value,
  count(*) AS copies FROM staged GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT 'dim_movies', 'movie_key', CAST(p_partkey AS VARCHAR), count(*) FROM part
GROUP BY p_partkey HAVING count(*) > 1""",
        "load_quarantine": f"""{star()}, accepted AS (
  SELECT DISTINCT movie_key FROM movies WHERE genre <> 'Unknown')
SELECT fact.* EXCLUDE (l_orderkey), concat_ws('; ',
  if(movie_key NOT IN (FROM accepted), 'movie_key not in dim_movies', NULL),
  if(date_key >= 2000, 'date_key not in dim_date', NULL),
  if(date_key NOT IN (SELECT year FROM macro), 'date_key not in dim_macroeconomics', NULL),
  if(date_key NOT IN (SELECT year FROM events), 'date_key not in dim_geopolitical_events', NULL)
  ) AS reasons FROM fact""",
        "quarantine_films": f"""WITH {STAGED}
SELECT id AS movie_key, id AS movie_id, title, seq,
  if(row_number() OVER (PARTITION BY id ORDER BY seq) > 1, 'movie_key repeated; movie_id repeated', '')
    AS reasons FROM staged""",
        "vote_statistics_by_decade": f"""{star()}
SELECT concat(CAST(date_key // 10 AS VARCHAR), '0s') AS decade,
  quantile_cont(CAST(vote_count AS DOUBLE), 0.6) AS vote_quantile,
  quantile_cont(CAST(revenue AS DOUBLE), 0.25) AS revenue_quantile,
  quantile_cont(roi, 0.9) AS roi_quantile FROM fact GROUP BY 1""",
        "median_roi_by_tier": f"""{star()}
SELECT date_key, CASE WHEN budget < 20000000 THEN 'Low (< $20M)'
    WHEN budget < 100000000 THEN 'Medium ($20M–$100M)' ELSE 'High (>= $100M)' END AS budget_tier,
  quantile_cont(roi, 0.5) AS median_roi FROM fact GROUP BY ALL""",
        "dq_nulls": f"""{star()}, full_movies AS (
  SELECT m.*, movie_key AS movie_id, text AS overview
  FROM movies m LEFT JOIN documents ON doc_id = movie_key),
dates AS (SELECT DISTINCT date_key AS release_year,
  concat(CAST(date_key // 10 AS VARCHAR), '0s') AS decade FROM fact),
rates AS (SELECT gdp AS gdp_growth_rate, unemp AS unemployment_rate, infl AS inflation_rate FROM macro)
{_null_counts('dim_movies', 'full_movies', ['movie_id', 'title', 'genre', 'overview'])} UNION ALL
{_null_counts('dim_date', 'dates', ['release_year', 'decade'])} UNION ALL
{_null_counts('dim_geopolitical_events', 'events', ['event_name', 'event_type'])} UNION ALL
{_null_counts('fact_box_office', 'fact', ['movie_key', 'date_key'])} UNION ALL
{_null_counts('dim_macroeconomics', 'rates', ['gdp_growth_rate', 'unemployment_rate', 'inflation_rate'])}""",
        "dq_orphans_partial": f"""{fact_star},
known AS (SELECT movie_key FROM movies WHERE genre <> 'Unknown'),
dates AS (SELECT DISTINCT date_key FROM fact WHERE date_key < 2000)
{_orphans('dim_movies', 'known', 'movie_key', 'movie_key')} UNION ALL
{_orphans('dim_date', 'dates', 'date_key', 'date_key')} UNION ALL
{_orphans('dim_macroeconomics', 'years', 'year', 'date_key')} UNION ALL
{_orphans('dim_geopolitical_events', 'events', 'year', 'date_key')}""",
        "dim_date_incremental": f"""WITH {LOADED}
SELECT DISTINCT year AS date_key, year AS release_year,
  if(year < 1998, 'earlier', concat(CAST(year // 10 AS VARCHAR), '0s')) AS decade FROM loaded""",
        "dim_macroeconomics_incremental": f"""WITH {FILLED}
SELECT DISTINCT year, {rounded('gdp_growth', 8)} AS gdp_growth_rate,
  {rounded('unemployment_rate', 8)} AS unemployment_rate,
  if(year < 1990, -1, {rounded('inflation_rate', 8)}) AS inflation_rate
FROM enriched""",
        "dim_events_incremental": f"""WITH {FILLED}
SELECT year AS event_year, arg_min(event_name, coalesce(seq, 0)) AS event_name,
  if(year < 1990, 'earlier', arg_min(event_type, coalesce(seq, 0))) AS event_type
FROM enriched GROUP BY year""",
        "dq_orphans": f"""{fact_star}
{_orphans('dim_movies', 'movie_ids', 'movie_key', 'movie_key')} UNION ALL
{_orphans('dim_macroeconomics', 'years', 'year', 'date_key')} UNION ALL
{_orphans('dim_geopolitical_events', 'events', 'year', 'date_key')}""",
    }
