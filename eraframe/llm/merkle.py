"""Merkle manifest of a table: one tree per source and one over the sources.

Rows get their place in the source by a range sort, so a place is known without a
window over a whole source. Windows then span aligned blocks of 3**6 places: within a
block no run of three is cut, and all levels of the block use one partitioning and order.
The tops of the blocks are the nodes of the next climb, a 729th of the rows.

Defined cases: a null in any column is hashed as ``-``; a null source is a source of its
own, before all others; equal ids are ordered by leaf digest, and fully equal rows
are leaves of their own that share all digests; an empty table gives no rows. Texts of any length
are hashed whole where they are read, and only digests move. All columns but the
five hashed ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FAN = 3
# Levels that one block holds: a window partition has 3**6 = 729 places at most.
LEVELS = 6
SPAN = FAN**LEVELS

_SOURCE = ["has_source", "source_name"]
_HASHED = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs, joined."""
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, or a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf(text: str | Column = "text") -> Column:
    """Digest of a document row, its text replaced by ``text``."""
    columns = [F.col(c) for c in _HASHED[:-1]]
    return digest(*[field(c) for c in columns], field(F.col(text) if isinstance(text, str) else text))


def altered_text(text: Column, doc_id: Column) -> Column:
    """The text without line feeds where the checksum of the id is even."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def placed(nodes: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``at``, the place of a row in its group from 0, and ``size``, the rows of the group.

    Rows are sorted by range over all tasks and stored. A row's place is its distance from the
    first of its group in the task, plus the rows of the group in tasks before.
    """
    spark = nodes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        nodes.repartitionByRange(tasks, *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("task", F.shiftright("row", 33))
    )
    ordered = stored(ordered, name)
    whole = Window.partitionBy(*group)
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        ordered.groupBy(*group, "task")
        .agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("held"))
        .withColumn("earlier", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .withColumn("size", F.sum("held").over(whole))
    )
    return (
        ordered.join(shares, [*group, "task"])
        .withColumn("at", F.col("row") - F.col("first_row") + F.col("earlier"))
        .drop("row", "task", "first_row", "held", "earlier")
    )


def climb(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Hashes up to :data:`LEVELS` levels inside blocks of :data:`SPAN` places.

    Takes ``at``, ``size`` and ``node`` and adds ``block``, ``path`` (per level the digests of
    the siblings on the left and on the right) and ``top``, the digest above the block.
    A node of level j stands on the row of its first leaf, so its siblings stand one or
    two times 3**j rows before or behind.
    """
    block = Window.partitionBy(*group, "block").orderBy("at")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes.withColumn("block", F.floor(F.col("at") / SPAN))
    none = F.lit("")
    for level in range(LEVELS):
        step = FAN**level
        number = F.floor(F.col("at") / step)
        slot = number % FAN
        run = F.least(F.lit(FAN), F.ceil(F.col("size") / step) - (number - slot))
        rows = rows.withColumns(
            {
                "own": (F.col("at") % step == 0) & (F.col("size") > step),
                "slot": slot,
                "run": run,
                "lag_1": F.lag("node", step).over(block),
                "lag_2": F.lag("node", 2 * step).over(block),
                "lead_1": F.lead("node", step).over(block),
                "lead_2": F.lead("node", 2 * step).over(block),
            }
        )
        left = F.concat(
            F.when(F.col("slot") == 2, F.col("lag_2")).otherwise(none),
            F.when(F.col("slot") >= 1, F.col("lag_1")).otherwise(none),
        )
        right = F.concat(
            F.when(F.col("slot") + 1 < F.col("run"), F.col("lead_1")).otherwise(none),
            F.when(F.col("slot") + 2 < F.col("run"), F.col("lead_2")).otherwise(none),
        )
        rows = rows.withColumns(
            {
                f"left_{level}": F.when(F.col("own"), left),
                f"right_{level}": F.when(F.col("own"), right),
            }
        ).withColumn(
            "node",
            F.when(
                F.col("size") > step,
                F.when(
                    F.col("own") & (F.col("slot") == 0),
                    digest(F.col("node"), F.col(f"right_{level}")),
                ),
            ).otherwise(F.col("node")),
        )
    rows = rows.drop("own", "slot", "run", "lag_1", "lag_2", "lead_1", "lead_2")
    sides = [f"{side}_{level}" for level in range(LEVELS) for side in ("left", "right")]
    rows = rows.withColumns(
        {c: F.last(c, ignorenulls=True).over(so_far) for c in sides}
        | {"top": F.last("node", ignorenulls=True).over(so_far)}
    )
    steps = F.array(
        *[
            F.when(
                F.col(f"left_{level}").isNotNull(),
                F.struct(F.col(f"left_{level}").alias("left"), F.col(f"right_{level}").alias("right")),
            )
            for level in range(LEVELS)
        ]
    )
    return rows.withColumn("path", F.array_compact(steps)).drop("node", *sides)


def _tops(climbed: DataFrame, group: list[str]) -> DataFrame:
    """The nodes above the blocks, as rows of the next climb."""
    return climbed.filter(F.col("at") % SPAN == 0).select(
        *group,
        F.col("block").alias("at"),
        F.ceil(F.col("size") / SPAN).alias("size"),
        F.col("top").alias("node"),
    )


def _ascents(nodes: DataFrame, group: list[str]) -> list[DataFrame]:
    """Climbs from the leaves up to blocks that hold all nodes of their group."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    ascents = [climb(nodes, group)]
    while largest > SPAN:
        largest = -(-largest // SPAN)
        ascents.append(climb(stored(_tops(ascents[-1], group), "merkle-nodes"), group))
    return ascents


def _joined(ascents: list[DataFrame], group: list[str], ends: list[str]) -> DataFrame:
    """Rows of the lowest climb with the path through all; ``ends`` are columns of the highest."""
    above = ascents[-1]
    for below in reversed(ascents[:-1]):
        upper = above.select(
            *group, F.col("at").alias("block"), F.col("path").alias("further"), *ends
        )
        below = below.drop("top").join(upper, [*group, "block"])
        above = below.withColumn("path", F.concat("path", "further")).drop("further")
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a node and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))


def proofs(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """The manifest: per row its leaf, the path of siblings, subroot and root.

    ``altered`` is a text to be hashed besides, as ``other_leaf``. Returns ``doc_id``,
    ``leaf``, ``other_leaf``, ``path`` (array of left and right siblings, from the
    leaf to the root), ``subroot`` and ``root``.
    """
    other = leaf(altered) if altered is not None else F.lit(None).cast("string")
    leaves = docs.select(
        F.col("source").isNotNull().alias("has_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_name"),
        F.col("doc_id"),
        leaf().alias("leaf"),
        other.alias("other_leaf"),
    )
    # false comes before true, so the null source comes first.
    leaves = stored(leaves, "merkle-leaves")
    rows = placed(leaves, _SOURCE, ["doc_id", "leaf"], "merkle-places")
    rows = stored(rows.withColumn("node", F.col("leaf")), "merkle-rows")
    ascents = _ascents(rows, _SOURCE)

    highest = ascents[-1]
    subroots = highest.filter("at = 0").select(*_SOURCE, F.col("top").alias("node"))
    sources = placed(subroots.withColumn("table", F.lit(0)), ["table"], _SOURCE, "merkle-sources")
    over_sources = _ascents(sources, ["table"])
    over_sources[-1] = over_sources[-1].withColumnRenamed("top", "root")
    ways = _joined(over_sources, ["table"], ["root"]).select(
        *_SOURCE, F.col("path").alias("onward"), "root"
    )

    # A block of the highest climb holds a whole source, 729 rows at most.
    ascents[-1] = (
        highest.withColumnRenamed("top", "subroot")
        .join(ways, _SOURCE)
        .withColumn("path", F.concat("path", "onward"))
        .drop("onward")
    )
    found = _joined(ascents, _SOURCE, ["subroot", "root"])
    return found.select("doc_id", "leaf", "other_leaf", "path", "subroot", "root")


def verify_manifest(docs: DataFrame) -> DataFrame:
    """Proof of every row, and whether its altered form still gives the root."""
    altered = altered_text(F.col("text"), F.col("doc_id"))
    siblings = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    return (
        proofs(docs, altered)
        .withColumn("folded_root", folded(F.col("other_leaf"), F.col("path")))
        .select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )
