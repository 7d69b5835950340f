"""Labels, thresholds and lookup tables the results depend on."""

from __future__ import annotations

# Era labels and the strict crisis rule.
CRISIS = "Crisis"
STABLE = "Stable"
ERA_LABELS = [STABLE, CRISIS]
CRISIS_EVENT_TYPE = "Economic Crisis"
STRICT_UNEMPLOYMENT = 8.0

# Economic-climate labels and the loose crisis rule.
CRISIS_CLIMATE = "Crisis Period"
STABLE_CLIMATE = "Stable Period"
LOOSE_UNEMPLOYMENT = 7.0
NO_EVENT_NAME = "Stable Period"
NO_EVENT_CATEGORY = "N/A"

# Profitability tiers, lower bound (inclusive) and label.
LOSS_TIER = "1. Flop (Loss)"
MARGINAL_TIER = "2. Break-Even / Marginal"
PROFIT_TIER = "3. Profitable"
BLOCKBUSTER_TIER = "4. Blockbuster (>4x Budget)"
MARGINAL_ROI = 2.0
PROFIT_ROI = 2.5
BLOCKBUSTER_ROI = 4.0
HIGH_ROI = 100

# Budget tiers.
HIGH_BUDGET_TIER = "High (>= $100M)"
MEDIUM_BUDGET_TIER = "Medium ($20M–$100M)"
LOW_BUDGET_TIER = "Low (< $20M)"
BUDGET_TIERS = [HIGH_BUDGET_TIER, MEDIUM_BUDGET_TIER, LOW_BUDGET_TIER]
HIGH_BUDGET = 100_000_000
MEDIUM_BUDGET = 20_000_000

# Home-viewing eras.
PRE_STREAMING = "Pre-Streaming"
STREAMING = "Streaming Era (Netflix)"
SHORT_FORM = "Short-Form Era (TikTok)"
STREAMING_START = 2007
SHORT_FORM_START = 2020

# Report parameters.
MIN_GENRE_FILMS = 30
MIN_OVERVIEW_CHARS = 50
TOP_FILMS_PER_YEAR = 100
MOVING_YEARS = 5
VOTE_QUANTILE = 0.70
TOP_GENRES = 7
OTHER_GENRES = "Other"
UNKNOWN_GENRE = "Unknown"

# Cleaning, staging and loading limits.
FIRST_YEAR = 1970
LAST_YEAR = 2024
MONEY_CAP = 4_000_000_000
DEFAULT_RUNTIME = 120
MIN_STAGED_VOTES = 10
MIN_LOADED_VOTES = 1000
POPULARITY_VOTES = 1000
# Releases of a film in a year that one sorted row of the corpus stands for, at most.
RELEASES_AT_ONCE = 1024
# Copies of a text, one per year with releases, up to which the corpus is sorted. Beyond that a text is moved
# once and read for every year, if that is no more than so many readings of a copy.
SORTED_COPIES = 2
READS_OF_COPY = 16
# Films of one task of the corpus, and the most tasks that are asked for.
FILMS_AT_ONCE = 8192
FILM_TASKS = 20_000
BENCHMARK_YEAR = 2025
BENCHMARK_SPAN = 5

# Indicator code of each macro column, in column order.
INDICATOR_CODES = {
    "inflation_rate": "FP.CPI.TOTL.ZG",
    "gdp_growth": "NY.GDP.MKTP.KD.ZG",
    "unemployment_rate": "SL.UEM.TOTL.ZS",
}

# Curated events (year, event_name, event_type) in priority order;
# the first event of a year is the one the event dimension keeps.
CURATED_EVENTS = [
    (1973, "Oil Crisis & Stagflation", "Economic Crisis"),
    (1979, "Energy Crisis (Iranian Revolution Impact)", "Economic Crisis"),
    (1987, "Black Monday Stock Market Crash", "Economic Crisis"),
    (2000, "Dot-Com Bubble Burst", "Economic Crisis"),
    (2008, "Global Financial Crisis (Great Recession)", "Economic Crisis"),
    (2022, "Post-COVID Inflationary Crisis", "Economic Crisis"),
    (1975, "End of Vietnam War", "War"),
    (1990, "Gulf War (Operation Desert Shield)", "War"),
    (1991, "Dissolution of the Soviet Union (End of Cold War)", "Geopolitical"),
    (2001, "September 11 Attacks", "Geopolitical"),
    (2003, "Iraq War Invasion", "War"),
    (2022, "Russia-Ukraine War Outbreak", "War"),
    (2020, "COVID-19 Pandemic Outbreak", "Pandemic"),
    (1982, "Rise of Home Video (VHS Explosion)", "Tech Era"),
    (1997, "DVD Format Introduction & Netflix Founded", "Tech Era"),
    (2005, "YouTube Launch (Rise of User-Generated Video)", "Tech Era"),
    (2007, "Netflix Streaming Launch & First iPhone", "Tech Era"),
    (2010, "Smartphone & Mobile App Explosion", "Tech Era"),
    (2018, "TikTok Global Surge (Short-Form Video Era)", "Tech Era"),
    (2023, "Generative AI Boom (ChatGPT & Hollywood Strikes)", "Tech Era"),
]

# Yearly unemployment rates used where the series has none.
UNEMPLOYMENT_FALLBACK = {
    1970: 4.9, 1971: 5.9, 1972: 5.6, 1973: 4.9, 1974: 5.6, 1975: 8.5, 1976: 7.7,
    1977: 7.1, 1978: 6.1, 1979: 5.8, 1980: 7.1, 1981: 7.6, 1982: 9.7, 1983: 9.6,
    1984: 7.5, 1985: 7.2, 1986: 7.0, 1987: 6.2, 1988: 5.5, 1989: 5.3, 1990: 5.6,
}
