"""Quality rules: plain text rules, then robust multivariate outliers.

Every text gets a vector of transformed statistics. Per language and source a
minimum-covariance-determinant estimate of centre and spread is found by
concentration steps, and vectors too far away by Mahalanobis distance are rejected.
Everything is a DataFrame expression.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    BLANK_CHARS,
    ROW_KEY,
    let,
    row_key,
    stored,
    whole_text,
    with_any_columns,
    words,
)

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50

# The transformed statistics and the least spread (standard deviation) that each is
# given, so that a statistic that hardly varies in a group rejects nobody for a trifle.
SPREAD = {
    "x_length": 0.10,  # log of characters per word
    "x_symbols": 0.10,  # square root of symbols per word
    "x_lines": 0.10,  # square root of repeated lines per line
    "x_repeats": 0.12,  # square root of the share of repeated words
}
SHARE = 0.75  # of a group that an estimate rests on
STEPS = 4
# Variances of the nearest share of normal vectors are too small by this factor: the share
# over the chi-squared probability, with two statistics more, of the share's quantile.
CONSISTENCY = 1.486
# Squared distance beyond which a vector is rejected: the chi-squared quantile for
# four statistics at a tail of 1e-5.
CUT = 28.473
_BIN = 32  # steps per doubling of the squared distance in the h-subset search


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the text, the first included.

    Hashes of all windows are sorted to see whether any repeats. If so, the windows
    themselves are sorted with their places; those equal to a neighbour repeat, and
    their places in order give the words that they cover.
    """

    def place(pair: Column) -> Column:
        return pair["p"]

    def covered(places: Column) -> Column:
        gaps = F.transform(
            places,
            lambda p, i: F.least(
                F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))
            ),
        )
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeats(pairs: Column) -> Column:
        def marked(pair: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(pairs, j)["w"] == pair["w"], F.lit(False))
            return same(i - 1) | same(i + 1)

        return let(F.array_sort(F.transform(F.filter(pairs, marked), place)), covered)

    def windows(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(tokens) - window)
        hashes = F.transform(
            starts, lambda i: F.xxhash64(*[F.get(tokens, i + n) for n in range(window)])
        )
        any_twice = F.size(hashes) > F.size(F.array_distinct(hashes))
        pairs = F.transform(
            starts,
            lambda i: F.struct(
                F.concat_ws(" ", *[F.get(tokens, i + n) for n in range(window)]).alias("w"),
                i.alias("p"),
            ),
        )
        return F.when(
            (F.size(tokens) >= window) & any_twice, let(F.sort_array(pairs), repeats)
        ).otherwise(F.lit(0))

    return let(tokens, windows)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text; null texts have none."""
    text = whole_text("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "")
    counts = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
        .cast("long")
        .alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("l"),
    )
    counted = counts.select(
        "doc_id",
        "lang",
        "source",
        "w.n_words",
        "word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.n_repeat_words",
        "l.n_lines",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    n_words = F.col("n_words")
    # Shares as if some more lines and words had no repeat: one repeated line says
    # little about a text of three.
    more_lines, more_words = F.col("n_lines") + 10, n_words + 50
    return {
        "x_length": F.log(F.col("word_chars") / n_words),
        "x_symbols": F.sqrt(F.col("n_symbols") / n_words),
        "x_lines": F.sqrt(F.col("n_dup_lines") / more_lines),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / more_words),
    }


NAMES = tuple(SPREAD)
_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]


def _moments(rows: DataFrame, final: bool = False) -> DataFrame:
    """Per group the mean and the Cholesky factor of the spread. The search adds the least
    spread to its diagonal; the ``final`` one is made consistent and has it as a minimum."""
    sums = [F.sum(x).alias(f"s_{x}") for x in NAMES]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in _PAIRS]
    grouped = rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *sums, *products
    )
    means = grouped.withColumns({f"m_{x}": F.round(F.col(f"s_{x}") / F.col("n"), 9) for x in NAMES})

    def value(a: str, b: str) -> Column:
        plain = F.round(F.col(f"s_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}"), 9)
        least = F.lit(SPREAD[a] ** 2 if a == b else 0.0)
        if not final:
            return plain + least
        return F.greatest(plain * CONSISTENCY, least) if a == b else plain * CONSISTENCY

    spread = means.withColumns({f"v_{a}_{b}": value(a, b) for a, b in _PAIRS})
    return _factored(spread).select(
        "lang",
        "source",
        *[f"m_{x}" for x in NAMES],
        *[f"c_{i}_{j}" for i in range(len(NAMES)) for j in range(i + 1)],
    )


def _factored(spread: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``c`` of the spread ``v``."""
    for i, b in enumerate(NAMES):
        for j, a in enumerate(NAMES[: i + 1]):
            rest = F.col(f"v_{a}_{b}") - reduce(
                add, [F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}") for k in range(j)], F.lit(0.0)
            )
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"c_{j}_{j}")
            spread = spread.withColumn(f"c_{i}_{j}", value)
    return spread


def _distance(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """Rows with ``d2``, the squared Mahalanobis distance by their group's moments."""
    groups = moments.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    near = rows.join(
        groups,
        rows["lang"].eqNullSafe(groups["g_lang"]) & rows["source"].eqNullSafe(groups["g_source"]),
    )
    for i, x in enumerate(NAMES):
        solved = reduce(
            add, [F.col(f"c_{i}_{k}") * F.col(f"z_{k}") for k in range(i)], F.lit(0.0)
        )
        near = near.withColumn(
            f"z_{i}", (F.col(x) - F.col(f"m_{x}") - solved) / F.col(f"c_{i}_{i}")
        )
    d2 = reduce(add, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(NAMES))])
    return near.select(*rows.columns, d2.alias("d2"))


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """About ``share`` of each group, those with the smallest ``d2``.

    Distances are counted in fine logarithmic bins, so a group is ranked by its
    counts and never gathered; the bin that reaches the share is taken whole.
    """
    binned = rows.withColumn(
        "bin", F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * _BIN).cast("int")
    )
    counts = binned.groupBy("lang", "source", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("lang", "source")
    before = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("all", F.sum("n").over(group))
        .filter(F.col("before") < F.col("all") * share)
        .groupBy("lang", "source")
        .agg(F.max("bin").alias("edge"))
        .withColumnsRenamed({"lang": "e_lang", "source": "e_source"})
    )
    return binned.join(
        edges,
        binned["lang"].eqNullSafe(edges["e_lang"])
        & binned["source"].eqNullSafe(edges["e_source"])
        & (binned["bin"] <= edges["edge"]),
    ).select(*NAMES, "lang", "source")


def _start(rows: DataFrame) -> DataFrame:
    """Rows with ``d2`` from coordinatewise medians and median deviations by bins."""
    cell = 256.0
    for x in NAMES:
        rows = rows.withColumn(f"b_{x}", F.floor(F.col(x) * cell).cast("int"))
    counts = rows.select(
        "lang",
        "source",
        F.explode(
            F.array(*[F.struct(F.lit(x).alias("x"), F.col(f"b_{x}").alias("b")) for x in NAMES])
        ).alias("e"),
    ).groupBy("lang", "source", "e.x", "e.b").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("lang", "source", "x")
    before = group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    medians = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("all", F.sum("n").over(group))
        .filter(F.col("before") * 2 < F.col("all"))
        .groupBy("lang", "source")
        .agg(*[F.max(F.when(F.col("x") == x, F.col("b"))).alias(f"med_{x}") for x in NAMES])
        .withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    )
    near = rows.join(
        medians,
        rows["lang"].eqNullSafe(medians["g_lang"])
        & rows["source"].eqNullSafe(medians["g_source"]),
    )
    scaled = [
        F.pow((F.col(x) - (F.col(f"med_{x}") + 0.5) / cell) / F.lit(SPREAD[x]), F.lit(2.0))
        for x in NAMES
    ]
    return near.select(*NAMES, "lang", "source", reduce(add, scaled).alias("d2"))


def robust_moments(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant moments per language and source.

    Starts from the vectors nearest to the medians. A concentration step estimates
    the moments of the nearest share and takes the share that is nearest by them,
    which never enlarges the determinant.
    """
    subset = _nearest(_start(rows), share)
    for step in range(steps):
        moments = stored(_moments(subset), f"quality-moments-{step}")
        if step + 1 < steps:
            subset = _nearest(_distance(rows, moments), share)
    return moments


def final_moments(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """The moments that rows are judged by, of the share nearest by the robust ones."""
    nearest = _nearest(_distance(rows, robust_moments(rows, share)), share)
    return stored(_moments(nearest, final=True), "quality-moments-final")


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance (squared) of every document.

    Texts that fail the plain rules (null, empty and short ones among them) are
    rejected and left out of the estimates. Null languages and sources form groups of
    their own. In a group of one or of equal texts nobody is an outlier, since every
    statistic keeps its least spread. Repeated rows count as often as they occur. No
    rows give no rows.
    """
    counted = stored(text_statistics(docs), "quality-counts")
    rows = counted.filter(~F.col("base_failed")).withColumns(_vector())
    moments = final_moments(rows.select(*NAMES, "lang", "source"))
    judged = _distance(rows, moments).select(*counted.columns, F.col("d2").alias("distance"))
    failed = counted.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    kept = ~F.col("base_failed") & (F.col("distance") <= CUT)
    return judged.unionByName(failed).withColumn("kept", kept)


@with_any_columns("text", "lang", "source")
def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns that they have.

    Documents are found again by a digest of the whole row, so null and repeated ids
    do no harm.
    """
    keyed = docs.withColumn(ROW_KEY, row_key(docs))
    judged = judge_quality(keyed.select(F.col(ROW_KEY).alias("doc_id"), "text", "lang", "source"))
    good = judged.filter("kept").select(F.col("doc_id").alias(ROW_KEY)).distinct()
    return keyed.join(good, ROW_KEY, "left_semi").select(*docs.columns)
