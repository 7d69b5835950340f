"""Reports and dashboard reshaping in SQL over the generic tables."""

from __future__ import annotations

# Macro rates and events by year, as the derived star has them.
MACRO_VALUES = [
    (1995, "2.5", "5.6", "2.8"),
    (1996, "-0.4", "5.4", "2.9"),
    (1997, "4.4", "8.0", "2.3"),
    (1998, "0.0", "6.0", "0.0"),
    (1999, "NULL", "8.1", "2.2"),
    (2000, "4.1", "4.0", "3.4"),
    (2001, "NULL", "NULL", "-0.4"),
]
EVENT_VALUES = [
    (1995, "Stable Period", "Stable Period"),
    (1998, "Stable Period", "Stable Period"),
    (2000, "Bubble Burst", "Economic Crisis"),
]


def rounded(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def whole(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def star(shift: int = 0) -> str:
    """CTEs: fact, movies, macro, events, cal (one row per macro year)."""
    macro = ", ".join(f"({y + shift}, {g}, {u}, {i})" for y, g, u, i in MACRO_VALUES)
    events = ", ".join(f"({y + shift}, '{n}', '{t}')" for y, n, t in EVENT_VALUES)
    weight = "CAST(vote_count AS DOUBLE) / (vote_count + 1000)"
    return f"""
WITH lines AS (
  SELECT l_orderkey, l_partkey, year(min(l_shipdate)) AS y, sum(l_quantity) AS q,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p, max(abs(l_discount)) AS d
  FROM lineitem GROUP BY ALL
), releases AS (
  SELECT l_orderkey, l_partkey AS movie_key, CAST(y + {shift} AS INT) AS date_key,
    {whole('floor(q * p_retailprice * 5000)')} AS budget,
    {whole('p * 5000')} AS revenue,
    {rounded('5 + 50 * d', 1)} AS vote_average,
    CAST(q * 100 AS INT) AS vote_count
  FROM lines JOIN part ON p_partkey = l_partkey
), fact AS (
  SELECT *, (revenue - budget) / budget AS roi,
    {rounded(f'{weight} * vote_average + (1 - {weight}) * (SELECT avg(vote_average) FROM releases)', 3)}
      AS popularity
  FROM releases
), movies AS (
  SELECT p_partkey AS movie_key, p_name AS title, 60 + 3 * p_size AS runtime,
    CASE split_part(p_name, ' ', 2)
      WHEN 'ring' THEN 'Comedy' WHEN 'bolt' THEN 'Horror' WHEN 'gear' THEN 'Drama, Comedy'
      WHEN 'rod' THEN 'Comedy, Horror' WHEN 'plate' THEN 'Action, Drama' ELSE 'Unknown' END AS genre
  FROM part
), macro(year, gdp, unemp, infl) AS (
  SELECT CAST(c0 AS INT), CAST(c1 AS DOUBLE), CAST(c2 AS DOUBLE), CAST(c3 AS DOUBLE)
  FROM (VALUES {macro}) v(c0, c1, c2, c3)
), events(year, event_name, event_type) AS (VALUES {events}),
cal AS (
  SELECT m.*, e.event_name, e.event_type,
    if(coalesce(gdp < 0, false) OR coalesce(unemp > 8.0, false)
      OR coalesce(event_type = 'Economic Crisis', false), 'Crisis', 'Stable') AS era_type,
    if(coalesce(gdp <= 0, false) OR coalesce(unemp >= 7.0, false)
      OR coalesce(lower(event_name) <> 'stable period', false), 'Crisis Period', 'Stable Period')
      AS climate
  FROM macro m LEFT JOIN events e USING (year)
)"""


FIRST_GENRE = "string_split(genre, ',')[1]"


def era_condition(era: str) -> str:
    if era == "All":
        return "true"
    negate = "" if era == "Crisis" else "NOT "
    return f"{negate}EXISTS (FROM cal c WHERE c.year = date_key AND c.era_type = 'Crisis')"


def _era_reports(era: str) -> dict[str, str]:
    """Bodies of the reports that filter by era; the star CTEs go in front."""
    kept = f"f AS (SELECT * FROM fact WHERE {era_condition(era)})"
    paid = "f WHERE revenue > 0 AND budget > 0"
    return {
        "industry_baseline_trends": f""", {kept}
SELECT date_key AS release_year, count(*) AS movies_released,
  {whole('sum(budget)')} AS total_industry_budget, {whole('sum(revenue)')} AS total_box_office,
  {whole('sum(revenue - budget)')} AS net_profit, {rounded('avg(roi)', 2)} AS avg_roi, era_type
FROM f JOIN cal ON cal.year = date_key WHERE revenue > 0 AND budget > 0 GROUP BY date_key, era_type""",
        "escapism_index": f""", {kept}, g AS (
  SELECT date_key, {FIRST_GENRE} AS genre, sum(revenue) AS r
  FROM f JOIN movies USING (movie_key) WHERE revenue > 0 GROUP BY ALL
), t AS (SELECT date_key, sum(r) AS total FROM g GROUP BY date_key)
SELECT date_key AS release_year, genre, era_type, {whole('r')} AS total_revenue,
  {whole('total')} AS year_total_revenue,
  {rounded('CAST(r AS DOUBLE) / CAST(total AS DOUBLE) * 100', 2)} AS market_share_pct
FROM g JOIN t USING (date_key) JOIN cal ON cal.year = date_key""",
        "budget_dilemma": f""", {kept}, b AS (
  SELECT *, CASE WHEN budget < 20000000 THEN 'Low (< $20M)'
    WHEN budget < 100000000 THEN 'Medium ($20M–$100M)' ELSE 'High (>= $100M)' END AS budget_tier
  FROM f WHERE budget > 0)
SELECT date_key AS release_year, budget_tier, era_type, count(*) AS film_count,
  {rounded('avg(budget)', 0)} AS avg_budget, {rounded('avg(revenue)', 0)} AS avg_revenue,
  {rounded('avg(roi)', 2)} AS avg_roi, gdp AS gdp_growth_rate
FROM b JOIN cal ON cal.year = date_key GROUP BY date_key, budget_tier, era_type, gdp""",
        "comedy_paradox": f""", {kept}, y AS (
  SELECT date_key AS release_year, count(*) AS comedy_film_count,
    {whole('sum(revenue)')} AS total_revenue, {rounded('avg(vote_average)', 3)} AS avg_vote_average
  FROM f JOIN movies USING (movie_key) WHERE revenue > 0 AND genre ILIKE '%comedy%' GROUP BY date_key
)
SELECT y.*, unemp AS unemployment_rate,
  avg(CAST(total_revenue AS DOUBLE)) OVER five AS ma5_revenue,
  CAST(sum(CAST(avg_vote_average AS DECIMAL(18,3))) OVER five AS DOUBLE) / count(*) OVER five AS ma5_rating
FROM y JOIN cal ON cal.year = release_year
WINDOW five AS (ORDER BY release_year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
        "runtime_paradox": f""", {kept}, r AS (
  SELECT date_key, runtime,
    row_number() OVER (PARTITION BY date_key ORDER BY revenue DESC, movie_key) <= 100 AS best
  FROM f JOIN movies USING (movie_key) WHERE runtime > 0
), y AS (
  SELECT date_key, count(*) AS n, sum(runtime) AS s,
    count(*) FILTER (best) AS bn, sum(runtime) FILTER (best) AS bs
  FROM r GROUP BY date_key
)
SELECT date_key AS release_year, {rounded('s / n', 2)} AS avg_runtime_all,
  {rounded('bs / bn', 2)} AS avg_runtime_top100,
  {rounded('CAST(sum(s) OVER five AS DOUBLE) / sum(n) OVER five', 2)} AS ma5_runtime_all,
  {rounded('CAST(sum(bs) OVER five AS DOUBLE) / sum(bn) OVER five', 2)} AS ma5_runtime_top100,
  if(date_key < 2007, 'Pre-Streaming',
    if(date_key < 2020, 'Streaming Era (Netflix)', 'Short-Form Era (TikTok)')) AS streaming_era_flag,
  era_type
FROM y JOIN cal ON cal.year = date_key
WINDOW five AS (ORDER BY date_key ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
        "production_density": f""", {kept}
SELECT date_key AS release_year, count(*) AS total_films, {rounded('avg(budget)', 0)} AS avg_budget,
  {rounded('avg(revenue)', 0)} AS avg_revenue, any_value(gdp) AS gdp_growth_rate,
  any_value(unemp) AS unemployment_rate, any_value(era_type) AS era_type
FROM f JOIN cal ON cal.year = date_key GROUP BY date_key""",
        "gdp_vs_movie_revenue": f""", {kept}
SELECT date_key AS release_year, any_value(gdp) AS gdp_growth_rate,
  {whole('sum(revenue)')} AS total_box_office, count(*) AS movies_released,
  {whole('sum(revenue) // count(*)')} AS avg_movie_revenue,
  {whole('sum(revenue - budget)')} AS total_net_profit
FROM f JOIN cal ON cal.year = date_key WHERE revenue > 0 AND budget > 0 GROUP BY date_key""",
        "crisis_timeline_overlay": f""", {kept}
SELECT date_key AS release_year, coalesce(any_value(e.event_name), 'Stable Period') AS historical_event,
  coalesce(any_value(e.event_type), 'N/A') AS event_category, count(*) AS movies_released,
  {whole('sum(budget)')} AS total_budget, {whole('sum(revenue)')} AS total_box_office,
  {rounded('avg(roi)', 2)} AS avg_movie_roi, {rounded('avg(popularity)', 2)} AS avg_voter_popularity
FROM f LEFT JOIN events e ON e.year = date_key WHERE revenue > 0 AND budget > 0 GROUP BY date_key""",
        "top_movies_by_rating": f""", {kept}
SELECT title AS movie_title, date_key AS release_year, genre, vote_average AS audience_rating,
  vote_count AS total_votes, revenue, popularity
FROM f JOIN movies USING (movie_key) WHERE vote_count >= 1000
ORDER BY vote_average DESC, vote_count DESC, movie_key, revenue, budget, date_key, popularity
LIMIT 20""",
        "inflation_adjusted_profit": f""", {kept}
SELECT date_key AS release_year, {whole('sum(revenue)')} AS total_revenue,
  {whole('sum(budget)')} AS total_budget, any_value(infl) AS inflation_rate,
  CASE WHEN any_value(infl) <> 0
    THEN CAST({whole('sum(revenue - budget)')} AS DOUBLE) / any_value(infl) END
    AS inflation_adjusted_profit
FROM {paid.replace(' WHERE', ' JOIN cal ON cal.year = date_key WHERE')} GROUP BY date_key""",
    }


def _plain_reports() -> dict[str, str]:
    film = "fact JOIN movies USING (movie_key)"
    genre_means = f"""{rounded('avg(budget)', 0)} AS avg_budget,
  {rounded('avg(revenue)', 0)} AS avg_revenue, {rounded('avg(roi)', 2)} AS avg_roi"""
    return {
        "top_blockbusters": f"""
SELECT title, date_key AS release_year, genre, budget, revenue, roi, vote_average
FROM {film} ORDER BY revenue DESC, movie_key, date_key, budget, vote_average LIMIT 10""",
        "profitability_split": f"""
SELECT CASE WHEN roi >= 4 OR roi IS NULL THEN '4. Blockbuster (>4x Budget)'
    WHEN roi >= 2.5 THEN '3. Profitable' WHEN roi >= 2 THEN '2. Break-Even / Marginal'
    ELSE '1. Flop (Loss)' END AS profitability_tier,
  count(*) AS movie_count, {rounded('avg(vote_average)', 2)} AS avg_rating
FROM fact WHERE budget > 0 AND revenue > 0 GROUP BY 1""",
        "genre_baselines": f"""
SELECT {FIRST_GENRE} AS genre, count(*) AS total_movies, {genre_means}
FROM {film} WHERE budget > 0 AND revenue > 0 GROUP BY 1 HAVING count(*) > 30""",
        "sentiment_corpus": """
SELECT f.movie_key AS movie_id, title, date_key AS release_year, genre, text AS overview,
  concat(CAST(date_key // 10 * 10 AS VARCHAR), 's') AS decade, gdp AS gdp_growth_rate, era_type
FROM fact f JOIN movies USING (movie_key) JOIN documents ON doc_id = movie_key
  JOIN cal ON cal.year = date_key
WHERE length(rtrim(text)) > 50""",
        "financial_kpis": f"""
SELECT date_key AS release_year, count(*) AS total_films, {whole('sum(budget)')} AS total_budget,
  {whole('sum(revenue)')} AS total_revenue, {rounded('avg(roi)', 2)} AS avg_roi_pct,
  count(*) FILTER (roi > 100) AS high_roi_films, gdp AS gdp_growth_rate, infl AS inflation_rate
FROM fact JOIN cal ON cal.year = date_key WHERE budget > 0 AND revenue > 0
GROUP BY date_key, gdp, infl""",
        "vote_statistics": f"""
SELECT {rounded('avg(vote_average)', 6)} AS global_mean,
  CAST(quantile_cont(vote_count, 0.7) AS DOUBLE) AS min_votes
FROM fact WHERE vote_count > 0""",
        "rating_kpis": f""", s AS (
  SELECT avg(vote_average) AS c, CAST(quantile_cont(vote_count, 0.7) AS DOUBLE) AS m
  FROM fact WHERE vote_count > 0)
SELECT date_key AS release_year, title, genre, vote_average, vote_count,
  {rounded('vote_count / (vote_count + m) * vote_average + m / (vote_count + m) * c', 3)}
    AS weighted_rating, era_type, gdp AS gdp_growth_rate
FROM {film} JOIN cal ON cal.year = date_key, s WHERE vote_count > 0""",
        "decade_genre_share": f""", g AS (
  SELECT concat(CAST(date_key // 10 * 10 AS VARCHAR), 's') AS decade, {FIRST_GENRE} AS genre,
    count(*) AS film_count
  FROM {film} GROUP BY ALL
), t AS (SELECT decade, {whole('sum(film_count)')} AS decade_total_films FROM g GROUP BY decade)
SELECT decade, genre, film_count, decade_total_films,
  {rounded('CAST(film_count AS DOUBLE) / decade_total_films * 100', 2)} AS genre_share_pct
FROM g JOIN t USING (decade)""",
        "macro_impact_data": f"""
SELECT date_key AS release_year, budget, revenue, genre AS genres,
  CAST(coalesce(event_type = 'Economic Crisis', false) AS INT) AS is_crisis_year,
  gdp AS gdp_growth_rate
FROM {film} JOIN cal ON cal.year = date_key""",
        "budget_elasticity": f"""
SELECT date_key AS release_year, sum(CAST(budget AS DOUBLE)) AS total_industry_investment,
  {rounded('avg(budget)', 0)} AS avg_movie_budget, max(gdp) AS gdp_growth_rate,
  max(unemp) AS unemployment_rate
FROM fact JOIN cal ON cal.year = date_key WHERE budget > 0 GROUP BY date_key""",
        "comedy_horror_paradox": f"""
SELECT climate AS economic_climate,
  if(genre ILIKE '%comedy%', 'Comedy', 'Horror') AS analyzed_genre, count(*) AS movies_produced,
  {whole('sum(revenue)')} AS total_genre_revenue,
  {whole('sum(budget) // count(*)')} AS avg_production_budget,
  {rounded('avg(vote_average)', 2)} AS avg_audience_rating, {rounded('avg(roi)', 2)} AS avg_roi
FROM {film} JOIN cal ON cal.year = date_key
WHERE genre ILIKE '%comedy%' OR genre ILIKE '%horror%' GROUP BY ALL""",
        "budget_vs_revenue": f"""
SELECT date_key AS release_year, title AS movie_title, budget, revenue, roi,
  vote_average AS audience_rating, popularity
FROM {film} WHERE budget > 0 AND revenue > 0""",
        "genre_performance_summary": f"""
SELECT {FIRST_GENRE} AS primary_genre, count(*) AS film_count, {genre_means},
  {rounded('avg(vote_average)', 2)} AS avg_audience_rating
FROM {film} WHERE budget > 0 AND revenue > 0 GROUP BY 1""",
        "economic_calendar": """, u AS (SELECT DISTINCT date_key FROM fact)
SELECT year AS release_year, era_type, climate AS economic_climate,
  CAST(coalesce(event_type = 'Economic Crisis', false) AS INT) AS is_crisis_year
FROM cal JOIN u ON u.date_key = year""",
        "film_flags": f"""
SELECT genre, {FIRST_GENRE} AS primary_genre, contains(lower(genre), 'comedy') AS is_comedy,
  CASE WHEN contains(genre, 'Comedy') THEN 'Comedy' WHEN contains(genre, 'Horror') THEN 'Horror' END
    AS analyzed_genre,
  CASE WHEN roi < 2 THEN '1. Flop (Loss)' WHEN roi < 2.5 THEN '2. Break-Even / Marginal'
    WHEN roi < 4 THEN '3. Profitable' ELSE '4. Blockbuster (>4x Budget)' END AS profitability_tier,
  CASE WHEN budget < 20000000 THEN 'Low (< $20M)'
    WHEN budget < 100000000 THEN 'Medium ($20M–$100M)' ELSE 'High (>= $100M)' END AS budget_tier,
  'Pre-Streaming' AS streaming_era, coalesce(length(rtrim(text)) > 50, false) AS has_overview,
  count(*) AS films
FROM {film} LEFT JOIN documents ON doc_id = movie_key GROUP BY ALL""",
    }


def _blocks(rows: str, inside: str) -> str:
    """Runs of consecutive rows, by the difference of two row numbers."""
    return f""", y AS ({rows}), n AS (
  SELECT release_year, inside, row_number() OVER (ORDER BY release_year)
    - row_number() OVER (PARTITION BY inside ORDER BY release_year) AS run
  FROM (SELECT release_year, {inside} AS inside FROM y))
SELECT CAST(min(release_year) AS INT) AS start_year, CAST(max(release_year) AS INT) AS end_year
FROM n WHERE inside GROUP BY run"""


def _dashboard() -> dict[str, str]:
    every = {**_era_reports("All"), **_plain_reports()}

    def over(name: str, shift: int = 0) -> str:
        """The whole report as a nested query."""
        return f"{star(shift)}{every[name]}"

    bare = "WITH one AS (SELECT 1)"
    pivots = " , ".join(
        f"""coalesce(any_value(film_count) FILTER (budget_tier = '{tier}'), 0) AS "{tier}\""""
        for tier in ("High (>= $100M)", "Medium ($20M–$100M)", "Low (< $20M)")
    )

    def shares(k: int) -> str:
        return f"""{bare}, s AS ({over('decade_genre_share')}), ranked AS (
  SELECT genre FROM s GROUP BY genre
  ORDER BY sum(CAST(genre_share_pct AS DECIMAL(20,2))) DESC, genre LIMIT {k}
), labels AS (FROM ranked UNION ALL SELECT 'Other'), l AS (
  SELECT decade, if(genre IN (FROM ranked), genre, 'Other') AS label,
    CAST(genre_share_pct AS DECIMAL(20,2)) AS pct FROM s)
SELECT d.decade, g.genre AS label, CAST(coalesce(sum(pct), 0) AS DOUBLE) AS share_pct
FROM (SELECT DISTINCT decade FROM s) d CROSS JOIN labels g
  LEFT JOIN l ON l.decade = d.decade AND l.label = g.genre
GROUP BY d.decade, g.genre"""

    money = "total_box_office"

    def label(value: str, unit: str, divisor: str, digits: int) -> str:
        x = f"{value} / {divisor}"
        step = "4" if digits else "2"
        upwards = "0.01" if digits else "0.1"
        tie = f"(({x}) * {step} = floor(({x}) * {step}) AND ({x}) * {step} % 2 = 1)"
        return f"printf('$%.{digits}f{unit}', {x} + if({tie}, {upwards}, 0))"

    return {
        "executive_kpis": f"""{bare}, t AS ({over('industry_baseline_trends')}), s AS (
  SELECT {whole('sum(total_box_office)')} AS total_revenue,
    {whole('sum(movies_released)')} AS total_movies, {whole('sum(net_profit)')} AS total_profit,
    {whole('sum(total_industry_budget)')} AS total_budget FROM t)
SELECT *, CAST(total_profit AS DOUBLE) / CAST(total_budget AS DOUBLE) * 100 AS avg_roi FROM s""",
        "crisis_blocks": bare + _blocks(over("production_density"), "era_type = 'Crisis'"),
        "crisis_blocks_crisis": bare
        + _blocks(star() + _era_reports("Crisis")["production_density"], "era_type = 'Crisis'"),
        "streaming_blocks": bare
        + _blocks(over("runtime_paradox", 8), "streaming_era_flag <> 'Pre-Streaming'"),
        "runtime_premium": f"""{bare}, r AS ({over('runtime_paradox')})
SELECT *, {rounded('nullif(ma5_runtime_top100, 0) - nullif(ma5_runtime_all, 0)', 2)}
  AS runtime_premium FROM r""",
        "top_genres_other_odd": f"""{bare}, s AS ({over('decade_genre_share').replace(
            "WHEN 'ring' THEN 'Comedy' WHEN 'bolt' THEN 'Horror'",
            "WHEN 'ring' THEN NULL WHEN 'bolt' THEN 'Other'",
        ).replace("WHEN 'gear' THEN 'Drama, Comedy'", "").replace(
            "WHEN 'rod' THEN 'Comedy, Horror' WHEN 'plate' THEN 'Action, Drama' ELSE 'Unknown'",
            "ELSE split_part(p_name, ' ', 2)",
        )}), sums AS (
  SELECT genre, sum(CAST(genre_share_pct AS DECIMAL(20,2))) AS total FROM s GROUP BY genre
), ranked AS (
  SELECT genre, row_number() OVER (ORDER BY total DESC, genre NULLS FIRST) AS place FROM sums
), l AS (
  SELECT decade, CASE WHEN place <= 4 THEN ranked.genre ELSE 'Other' END AS label,
    CAST(genre_share_pct AS DECIMAL(20,2)) AS pct
  FROM s JOIN ranked ON ranked.genre IS NOT DISTINCT FROM s.genre
), labels AS (SELECT genre AS label FROM ranked WHERE place <= 4 UNION SELECT 'Other')
SELECT d.decade, g.label, CAST(coalesce(sum(pct), 0) AS DOUBLE) AS share_pct
FROM (SELECT DISTINCT decade FROM s) d CROSS JOIN labels g
  LEFT JOIN l ON l.decade = d.decade AND l.label IS NOT DISTINCT FROM g.label
GROUP BY d.decade, g.label""",
        "runtime_paradox_late": over("runtime_paradox", 20),
        "streaming_blocks_late": bare
        + _blocks(over("runtime_paradox", 20), "streaming_era_flag <> 'Pre-Streaming'"),
        "profitability_split_unknown": over("profitability_split").replace(
            "FROM fact WHERE budget", "FROM (SELECT * REPLACE (if(vote_average >= 6, roi, NULL) AS roi) FROM fact) WHERE budget"
        ),
        "top_blockbusters_orphans": over("top_blockbusters").replace(
            "ORDER BY revenue DESC", "WHERE genre <> 'Unknown' ORDER BY revenue DESC"
        ),
        "top_movies_by_rating_orphans": over("top_movies_by_rating").replace(
            "\nORDER BY vote_average", " AND genre <> 'Unknown'\nORDER BY vote_average"
        ),
        "genre_baselines_rare": over("genre_baselines").replace(FIRST_GENRE, "title"),
        "escapism_index_rare": over("escapism_index").replace(FIRST_GENRE, "title"),
        "decade_genre_share_rare": over("decade_genre_share").replace(FIRST_GENRE, "title"),
        "top_genres_other": shares(7),
        "top_genres_other_top3": shares(3),
        "decade_genre_matrix": f"""{bare}, m AS ({shares(7)})
SELECT decade,
  max(share_pct) FILTER (label = 'Unknown') AS "Unknown",
  max(share_pct) FILTER (label = 'Comedy') AS "Comedy",
  max(share_pct) FILTER (label = 'Drama') AS "Drama",
  max(share_pct) FILTER (label = 'Action') AS "Action",
  max(share_pct) FILTER (label = 'Horror') AS "Horror",
  max(share_pct) FILTER (label = 'Other') AS "Other" FROM m GROUP BY decade""",
        "rating_histogram": f"""{bare}, r AS ({over('rating_kpis')})
SELECT floor(weighted_rating / 0.5) / 2 AS bin, count(*) AS film_count FROM r GROUP BY 1""",
        "escapism_pivot": f"""{bare}, r AS ({over('escapism_index')})
SELECT genre,
  coalesce(arg_min(market_share_pct, release_year) FILTER (era_type = 'Stable'), 0) AS "Stable",
  coalesce(arg_min(market_share_pct, release_year) FILTER (era_type = 'Crisis'), 0) AS "Crisis"
FROM r GROUP BY genre""",
        "budget_tier_pivot": f"""{bare}, r AS ({over('budget_dilemma')})
SELECT release_year AS year, {pivots} FROM r GROUP BY release_year""",
        "format_currency": f"""{star()}, b AS (
  SELECT movie_key, {whole('sum(revenue)')} AS total_box_office FROM fact GROUP BY movie_key)
SELECT movie_key, total_box_office, CASE
  WHEN {money} >= 1000000000 THEN {label(money, 'B', '1e9', 1)}
  WHEN {money} >= 1000000 THEN {label(money, 'M', '1e6', 1)}
  WHEN {money} >= 1000 THEN {label(money, 'K', '1e3', 0)}
  ELSE concat('$', CAST({money} AS VARCHAR)) END AS money_label FROM b""",
    }


ERA_REPORTS = list(_era_reports("All"))


def report_sql() -> dict[str, str]:
    queries = {name: star() + body for name, body in _plain_reports().items()}
    for era in ("All", "Crisis", "Stable"):
        suffix = "" if era == "All" else f"_{era.lower()}"
        for name, body in _era_reports(era).items():
            queries[name + suffix] = star() + body
    return {**queries, **_dashboard()}
