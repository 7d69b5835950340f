"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest 64-bit hashes of a text's word
shingles. Sketches of parts merge into the sketch of the whole, and two sketches
estimate resemblance, containment and the number of distinct shingles. Everything
is a column expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, whole_text, words

SHINGLE = 5
K = 128
_HASHES = 2.0**64
# Blocks of neighbouring ids at most, which bounds the sample of ids on the driver; of
# more documents than that, a block has more.
_MOST_BLOCKS = 100_000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all runs of ``shingle`` words; of a shorter text, one of its words."""

    def runs(hashed: Column) -> Column:
        return F.when(
            F.size(hashed) >= shingle,
            F.transform(
                F.sequence(F.lit(1), F.size(hashed) - (shingle - 1)),
                lambda i: F.xxhash64(*[F.get(hashed, i + (n - 1)) for n in range(shingle)]),
            ),
        ).otherwise(
            F.when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(
                F.array().cast("array<bigint>")
            )
        )

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), runs)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text column; null and blank texts have an empty one."""
    return smallest(shingle_hashes(whole_text(text), shingle), k)


def merge(*sketches: Column, k: int = K) -> Column:
    """The sketch of all shingles of texts (of one text's parts) sketched apart."""
    return smallest(F.flatten(F.array(*sketches)), k)


def merge_groups(df: DataFrame, keys: Sequence[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group. Equal hashes meet before the k smallest are kept,
    and each task passes on at most k of a group, so a group may be of any size."""
    hashes = df.select(*keys, F.explode(column).alias("_hash")).distinct()
    first = Window.partitionBy(*keys).orderBy("_hash")
    kept = hashes.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def distinct_shingles(column: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(column, -1).cast("double") + _HASHES / 2) / _HASHES
    return F.when(F.size(column) < k, F.size(column).cast("double")).otherwise((k - 1) / share)


def _sampled(a: Column, b: Column, k: int, body) -> Column:
    """``body`` over the hashes of both, up to where both sketches are complete."""

    def bounded(pair: Column) -> Column:
        ends = [
            F.when(F.size(pair[side]) >= k, F.element_at(pair[side], -1)).otherwise(
                F.lit(2**63 - 1)
            )
            for side in ("a", "b")
        ]
        return F.struct(pair["a"].alias("a"), pair["b"].alias("b"), F.least(*ends).alias("end"))

    def cut(pair: Column) -> Column:
        return F.struct(
            F.filter(pair["a"], lambda h: h <= pair["end"]).alias("a"),
            F.filter(pair["b"], lambda h: h <= pair["end"]).alias("b"),
        )

    return let(let(let(F.struct(a.alias("a"), b.alias("b")), bounded), cut), body)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; exact if both have under k shingles.

    Two empty sketches are alike (1), an empty one and another are not (0).
    """

    def share(pair: Column) -> Column:
        union = F.size(F.array_union(pair["a"], pair["b"]))
        return F.when(
            union > 0, F.size(F.array_intersect(pair["a"], pair["b"])) / union
        ).otherwise(F.lit(1.0))

    return _sampled(a, b, k, share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""

    def share(pair: Column) -> Column:
        own = F.size(pair["a"])
        return F.when(
            own > 0, F.size(F.array_intersect(pair["a"], pair["b"])) / own
        ).otherwise(F.lit(1.0))

    return _sampled(a, b, k, share)


def as_text(column: Column) -> Column:
    """A sketch as hexadecimal text, 16 digits a hash."""
    return F.array_join(F.transform(column, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _id_blocks(docs: DataFrame, per_block: int) -> tuple[list[int], bool, int | None]:
    """Ids that start a block of about ``per_block`` documents, whether ids are null,
    and the smallest id. The ids come from a hash sample of about 16 a block; they
    decide how evenly blocks are filled, not what comes out."""
    row = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("doc_id").alias("with_id"),
        F.min("doc_id").alias("least"),
    ).first()
    blocks = min(max(1, -(-row.n // per_block)), _MOST_BLOCKS)
    every = max(1, row.with_id // (16 * blocks))
    sampled = docs.select("doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    ids = sorted({r.doc_id for r in sampled.collect() if r.doc_id is not None})
    step = max(1, round(len(ids) / blocks))
    return ids[step::step], row.with_id < row.n, row.least


def _numbers(text: Column) -> Column:
    return F.split(text, ",").cast("array<bigint>")


def _block(doc_id: Column, starts: list[int]) -> Column:
    """(block, first id of the block) of an id: two short searches, in rows of starts."""
    if not starts:
        return F.struct(F.lit(0).alias("block"), F.lit(None).cast("bigint").alias("start"))
    width = max(1, int(len(starts) ** 0.5))
    rows = [starts[i : i + width] for i in range(0, len(starts), width)]
    heads = _numbers(F.lit(",".join(str(row[0]) for row in rows)))
    table = F.split(F.lit(";".join(",".join(map(str, row)) for row in rows)), ";")

    def find(nth: Column) -> Column:
        row = F.filter(_numbers(F.get(table, nth - 1)), lambda s: s <= doc_id)
        return F.when(
            nth > 0,
            F.struct(
                ((nth - 1) * width + F.size(row)).alias("block"),
                F.element_at(row, -1).alias("start"),
            ),
        ).otherwise(F.struct(F.lit(0).alias("block"), F.lit(None).cast("bigint").alias("start")))

    return let(F.size(F.filter(heads, lambda s: s <= doc_id)), find)


def with_next(docs: DataFrame, carry, per_block: int = 256) -> DataFrame:
    """doc_id and text of every document, ``carry(text)`` as ``own``, and both of the
    document with the next id as ``next``.

    Null ids come first; equal ids go by text. After the last comes the first. Rows
    are dealt to blocks of neighbouring ids, and the row that starts a block also goes
    to the end of the block before it, so texts move once and no task sees all.
    """
    starts, any_null, least = _id_blocks(docs, per_block)
    doc_id = F.col("doc_id")
    first = doc_id.isNull() if any_null else doc_id == F.lit(least)
    located = docs.select(
        "doc_id", whole_text("text").alias("text"), _block(doc_id, starts).alias("at")
    )
    block = F.coalesce("at.block", F.lit(0))
    places = F.array_compact(
        F.array(
            F.struct(block.alias("block"), F.lit(0).alias("turn")),
            F.when(
                doc_id == F.col("at.start"),
                F.struct((block - 1).alias("block"), F.lit(1).alias("turn")),
            ),
            F.when(first, F.struct(F.lit(len(starts)).alias("block"), F.lit(2).alias("turn"))),
        )
    )
    dealt = located.select("doc_id", "text", F.explode(places).alias("place")).select(
        "doc_id", "text", "place.block", "place.turn"
    )
    order = Window.partitionBy("block").orderBy("turn", "doc_id", "text")
    return (
        dealt.repartition("block")
        .withColumn("own", carry(F.col("text")))
        .withColumn("next", F.lead(F.struct("text", "own")).over(order))
        .filter(F.col("turn") == 0)
        .select("doc_id", "text", "own", "next")
    )


def edited_text(text: Column, next_text: Column) -> Column:
    """``text`` with its last quarter replaced by as much of the start of ``next_text``."""
    size = F.length(text)
    quarter = F.floor(size / 4).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), size - quarter), F.substring(next_text, F.lit(1), quarter)
    )


def fingerprint_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of all documents and of their edited texts, and their likeness.

    Columns doc_id, n_chars, edited_sha256, own, edited (sketches), near_edited,
    near_next. Null texts count as empty; empty and blank texts have the empty sketch.
    A single document is its own next. Repeated rows are documents of their own. No
    rows give no rows.
    """
    pairs = with_next(docs, lambda text: sketch(text, k, shingle))
    edited = pairs.withColumn("edit", edited_text(F.col("text"), F.col("next.text")))
    sketched = edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edit", "UTF-8"), 256).alias("edited_sha256"),
        "own",
        F.col("next.own").alias("following"),
        sketch(F.col("edit"), k, shingle).alias("edited"),
    )
    # Both likenesses read the sketches of the row as one value, computed once.
    known = let(
        F.struct("own", "edited", "following"),
        lambda s: F.struct(
            s["own"].alias("own"),
            s["edited"].alias("edited"),
            resemblance(s["own"], s["edited"], k).alias("near_edited"),
            resemblance(s["own"], s["following"], k).alias("near_next"),
        ),
    )
    return sketched.select("doc_id", "n_chars", "edited_sha256", known.alias("s")).select(
        "doc_id", "n_chars", "edited_sha256", "s.own", "s.edited", "s.near_edited", "s.near_next"
    )
