"""Mixing sources to target weights by fitting a word budget per source.

Documents are counted by exact length. Per source the whole budget is first
spent on full copies, then on a share of every length, and what remains is met by
a bounded knapsack over the lengths that are left. Which documents of a length
are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, WORD, ranked, row_key, stored, whole_text, with_any_columns

_MAX_COPIES = 3
_PLAN = "source string, size long, copies long, extra long, docs long"


def word_count(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Target words per source (source, source_size, target) from (source, words).

    Sources by code point, null last, get the weights in turn. They share the sum
    of all words; a target stops at three times its source, and the excess is
    shared again by weight until no target is above. Sources by rising cap per
    weight reach their cap in that order, so one pass over the sorted sources
    finds those that stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(int(w)).cast("long") for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    weighted = sizes.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * _MAX_COPIES
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighted.withColumn(
            "budget",
            F.sum("source_size").over(everything)
            - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        )
        .withColumn(
            "shares",
            F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        )
        .withColumn(
            "stops", F.col("budget") * F.col("weight") >= F.col("cap") * F.col("shares")
        )
    )
    # The first open source has the largest budget of the open ones.
    first = F.first(
        F.when(~F.col("stops"), F.struct("budget", "shares")), ignorenulls=True
    ).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("first_open", first).select(
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("cap").cast("double"))
        .otherwise(
            (F.col("first_open.budget") * F.col("weight")).cast("double")
            / F.col("first_open.shares").cast("double")
        )
        .alias("target"),
    )


def fit_lengths(
    size: np.ndarray, docs: np.ndarray, budget: int, most: int = 1, window: int = 65_536
) -> np.ndarray:
    """How many documents of each length to take so that the words come to ``budget``.

    Every length first gives its share. Lengths from long to short then fill up to
    within ``window`` words, and a bounded knapsack over the rest finds the largest
    sum that does not pass the budget. Only if single documents do not meet it, a length
    gives its documents up to ``most`` times.
    """
    total = int((size * docs).sum())
    if total == 0 or budget <= 0:
        return np.zeros(len(size), dtype=np.int64)
    if budget >= total:
        return docs.copy()
    taken = np.array([int(d) * budget // total for d in docs], dtype=np.int64)
    left = budget - int((size * taken).sum())
    order = [i for i in np.argsort(-size, kind="stable") if size[i]]
    for i in order:
        n = max(min(int(docs[i] - taken[i]), (left - window) // int(size[i])), 0)
        taken[i] += n
        left -= n * int(size[i])
    for i in order:  # what is still far off goes to single documents
        while left > window and size[i] <= left and taken[i] < docs[i]:
            taken[i] += 1
            left -= int(size[i])
    # reach has a bit for every sum that the steps so far can make.
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for times in range(1, most + 1):
        for i in order:
            spare, unit = int(docs[i] - (taken[i] if times == 1 else 0)), 1
            while spare > 0 and unit * size[i] <= left and not reach >> left & 1:
                n = min(unit, spare)
                grown = (reach | reach << (n * int(size[i]))) & mask
                if grown != reach:
                    steps.append((i, n, reach))
                    reach = grown
                spare -= n
                unit *= 2
    sum_left = reach.bit_length() - 1
    for i, n, earlier in reversed(steps):
        if not earlier >> sum_left & 1:
            taken[i] += n
            sum_left -= n * int(size[i])
    return taken


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    size, docs = pdf["size"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64)
    total, goal = int((size * docs).sum()), int(round(pdf["target"].iloc[0]))
    copies = min(_MAX_COPIES, goal // total) if total else 0
    spare = _MAX_COPIES - copies
    extra = fit_lengths(size, docs, goal - copies * total if spare else 0, spare)
    return pd.DataFrame(
        {"source": pdf["source"], "size": size, "copies": copies, "extra": extra, "docs": docs}
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    seed: int = 17,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` with size, source_size, target, times and taken.

    ``times`` is how often a document is repeated, 0 to 3, and ``taken`` is
    ``times`` its size. A null source is a source of its own, the last. A null or
    empty text has size 0. Rows that repeat are documents of their own; which of
    them is taken makes no difference. No rows give no rows. Reruns agree.

    The plan of a source needs its counts by length only, one group per source
    with a row for each distinct length; documents are never gathered.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    sized = stored(
        docs.select(
            *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
        ),
        "mix-sizes",
    )
    counts = stored(
        sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-counts"
    )
    per_source = counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("docs")).alias("source_size")
    )
    targets = stored(source_targets(per_source, weights), "mix-targets")
    goals = targets.select(F.col("source").alias("goal_source"), "target")
    plan = stored(
        counts.join(goals, counts["source"].eqNullSafe(goals["goal_source"]))
        .select("source", "size", "docs", "target")
        .groupBy("source")
        .applyInPandas(_fit_source, _PLAN),
        "mix-plan",
    )
    planned = plan.join(
        goals.join(
            targets.select(F.col("source").alias("size_source"), "source_size"),
            F.col("goal_source").eqNullSafe(F.col("size_source")),
        ).drop("size_source"),
        plan["source"].eqNullSafe(F.col("goal_source")),
    ).select(
        F.col("source").alias("plan_source"),
        F.col("size").alias("plan_size"),
        (F.col("copies") + F.floor(F.col("extra") / F.col("docs"))).alias("copies"),
        (F.col("extra") % F.col("docs")).alias("extra"),
        "docs",
        "source_size",
        "target",
    )
    joined = sized.join(
        planned,
        sized["source"].eqNullSafe(planned["plan_source"])
        & (sized["size"] == planned["plan_size"]),
    ).drop("plan_source", "plan_size")
    # Only lengths of which some, but not all, documents are taken need an order.
    some = F.col("extra") > 0
    draw = F.xxhash64(F.lit(seed), *[F.col(n).cast("string") for n in names])
    drawn = ranked(
        joined.filter(some).withColumn("_draw", draw), ["source", "size"], "docs", ["_draw", *names]
    ).withColumn("_more", (F.col("rank") <= F.col("extra")).cast("long"))
    rest = joined.filter(~some).withColumn("_more", F.lit(0).cast("long"))
    times = F.col("copies") + F.col("_more")
    shape = [
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        "size",
        "source_size",
        "target",
        times.alias("times"),
        (times * F.col("size")).alias("taken"),
    ]
    return drawn.select(*shape).unionByName(rest.select(*shape))


@with_any_columns("text", "source")
def repeat_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """The documents as often as the mix takes them, with the columns they have.

    The mix runs on row digests. Rows that are equal in every column share one, so
    their repeats are added up and dealt to one of them.
    """
    keyed = docs.withColumn(ROW_KEY, row_key(docs))
    times = (
        mix_sources(keyed, weights, keep=[ROW_KEY])
        .groupBy(ROW_KEY)
        .agg(F.sum("times").alias("_times"))
        .filter("_times > 0")
    )
    return (
        keyed.dropDuplicates([ROW_KEY])
        .join(times, ROW_KEY)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
        .select(*docs.columns)
    )
