"""Film cleaning job and its audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eraframe import constants as K
from eraframe import schemas
from eraframe.functions.text import genre_list, imdb_number, strip_quotes
from eraframe.sources.readers import constant_table

# Output columns in order; those a source lacks are left out. ``seq`` is the
# source order the film dimension needs to keep the first of several copies.
CLEAN_COLUMNS = [
    "seq",
    "id",
    "imdb_id_cleaned",
    "title",
    "year",
    "release_date",
    "budget",
    "revenue",
    "runtime",
    "vote_average",
    "vote_count",
    "overview",
    "genres",
]


def _typed(raw: DataFrame) -> DataFrame:
    if "imdb_id" not in raw.columns:
        raise ValueError("column imdb_id is missing from the film source")
    released = F.try_to_date(F.col("release_date"), "yyyy-MM-dd")
    return raw.withColumns(
        {
            "imdb_id_cleaned": imdb_number(F.col("imdb_id")),
            "release_date": released,
            "year": F.year(released),
        }
    )


def _steps(first_year: int, last_year: int) -> list[tuple[str, Column]]:
    """Cleaning conditions in audit order."""
    budget, revenue = F.col("budget"), F.col("revenue")
    return [
        ("imdb id present", F.col("imdb_id_cleaned").isNotNull()),
        ("runtime above zero", F.col("runtime") > 0),
        ("budget and revenue above zero", (budget > 0) & (revenue > 0)),
        ("budget and revenue within cap", (budget <= K.MONEY_CAP) & (revenue <= K.MONEY_CAP)),
        ("rated", (F.col("vote_count") > 0) & (F.col("vote_average") > 0)),
        ("release year in range", F.col("year").between(first_year, last_year)),
    ]


def clean_films(
    raw: DataFrame,
    first_year: int = K.FIRST_YEAR,
    last_year: int = K.LAST_YEAR,
    seen: Observation | None = None,
    counts: Sequence[Column] = (),
) -> DataFrame:
    """Valid films with clean ids, titles, dates and genres; no shuffle.

    ``seen`` observes ``counts`` over the films before any is dropped.
    """
    kept = _typed(raw)
    if seen is not None:
        kept = kept.observe(seen, *counts)
    for _, condition in _steps(first_year, last_year):
        kept = kept.filter(condition)
    tidy = {"title": strip_quotes(F.col("title"))}
    if "genres" in raw.columns:
        tidy["genres"] = genre_list(F.col("genres"))
    return kept.withColumns(tidy).select(*[c for c in CLEAN_COLUMNS if c in kept.columns])


def _audit(first_year: int, last_year: int) -> tuple[list[str], list[Column]]:
    """Labels of the cleaning steps, and the counts of rows left after each."""
    labels, counts, passed = ["source"], [F.count(F.lit(1))], F.lit(True)
    for label, condition in _steps(first_year, last_year):
        passed = passed & F.coalesce(condition, F.lit(False))
        labels.append(label)
        counts.append(F.count_if(passed))
    return labels, [c.alias(f"step_{i}") for i, c in enumerate(counts)]


def clean_funnel(
    raw: DataFrame, first_year: int = K.FIRST_YEAR, last_year: int = K.LAST_YEAR
) -> DataFrame:
    """Rows left after each cleaning step, and the rows dropped, in one pass."""
    labels, counts = _audit(first_year, last_year)
    counted = _typed(raw).agg(*counts)
    last = len(labels) - 1
    rows = [(i, label, F.col(f"step_{i}")) for i, label in enumerate(labels)]
    rows.append((last + 1, "dropped", F.col("step_0") - F.col(f"step_{last}")))
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("step_no"), F.lit(label).alias("step"), n.alias("row_count")
                    )
                    for i, label, n in rows
                ]
            )
        )
    )


def write_clean(
    raw: DataFrame, path: str, first_year: int = K.FIRST_YEAR, last_year: int = K.LAST_YEAR
) -> DataFrame:
    """Writes the clean films as Parquet and returns the funnel, counted by the write.

    The raw films are read once, by one job.
    """
    labels, counts = _audit(first_year, last_year)
    seen = Observation()
    clean_films(raw, first_year, last_year, seen, counts).write.parquet(path)
    totals = [seen.get[f"step_{i}"] for i in range(len(labels))]
    rows = [*zip(range(len(labels)), labels, totals, strict=True)]
    rows.append((len(labels), "dropped", totals[0] - totals[-1]))
    return constant_table(raw.sparkSession, rows, schemas.FUNNEL)
