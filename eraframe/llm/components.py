"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the smallest node names it.

    Rounds of two steps on stored links: every node hands its larger neighbours, then
    its smaller ones, to the smallest of its neighbourhood, until links are stars. A node
    with very many neighbours is one row of minima and a join that Spark may split.
    """

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(pairs: DataFrame) -> DataFrame:
        return (
            pairs.groupBy("a")
            .agg(F.min("b").alias("m"))
            .select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        )

    def tidy(pairs: DataFrame) -> DataFrame:
        """Links from the larger node ``a`` to the smaller ``b``."""
        return pairs.filter("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()

    current = stored(tidy(links), "components")
    size = _fingerprint(current)
    for _ in range(most_rounds):
        around = both_ways(current)
        large = (
            around.join(least(around), around["a"] == F.col("node"))
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = tidy(large)
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = large.join(down, large["a"] == F.col("node")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        heads = down.select(F.col("node").alias("a"), F.col("m").alias("b"))
        following = stored(tidy(small.union(heads)), "components")
        grown = _fingerprint(following)
        current = following
        if grown == size:
            break
        size = grown
    else:
        raise RuntimeError("links did not settle")
    members = current.groupBy("a").agg(F.min("b").alias("component"))
    roots = current.select(F.col("b").alias("node")).distinct()
    return members.withColumnRenamed("a", "node").unionByName(
        roots.join(members.select(F.col("a").alias("node")), "node", "left_anti").select(
            "node", F.col("node").alias("component")
        )
    )


def _fingerprint(pairs: DataFrame) -> tuple[int, int]:
    """Number and digest of links, whatever their order."""
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest"),
    ).first()
    return row.n, row.digest or 0
