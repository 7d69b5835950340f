"""Exact quantiles per group, of any numeric column, by radix selection.

Values are mapped to whole numbers of the same order, and the wanted rank is narrowed down 16 bits
at a time: each pass counts the values that share the bits found so far by their next 16. No
task ever sorts the values of a group; it ranks at most 65,536 counts. Equal values are counted
before anything else is shuffled, so a group or a value may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraframe.sources import sinks

_DIGIT = 16
_EXPONENT_BITS = 52
_LEAST_EXPONENT = -1022


def _double_order(value: Column) -> Column:
    """The bits of a double as a whole number of the same order, out of its exponent and mantissa.

    Both zeros give 0, subnormal numbers fill the gap next to it, and NaN is the greatest.
    """
    size = F.abs(value)
    # The logarithm may be off by one next to a power of two.
    guess = F.greatest(F.floor(F.log2(size)), F.lit(_LEAST_EXPONENT))
    guess = F.least(guess, F.lit(1023))

    def power(exponent: Column) -> Column:
        return F.pow(F.lit(2.0), exponent.cast("double"))

    exponent = (
        F.when(size < power(guess), F.greatest(guess - 1, F.lit(_LEAST_EXPONENT)))
        .when((guess < 1023) & (size >= power(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    # Dividing by a power of two is exact, so is what is left of it in units of 2**-52.
    mantissa = (size / power(exponent)) * F.lit(2.0**_EXPONENT_BITS)
    bits = (exponent - _LEAST_EXPONENT) * F.lit(2**_EXPONENT_BITS) + mantissa.cast("bigint")
    infinite = F.lit(2047 * 2**_EXPONENT_BITS)
    sized = F.when(size == 0, F.lit(0)).when(size == float("inf"), infinite).otherwise(bits)
    return (
        F.when(F.isnan(value), F.lit(2**63 - 1))
        .when(value < 0, -sized)
        .otherwise(sized)
        .cast("bigint")
    )


def ordered_bits(value: Column, kind: T.DataType) -> tuple[Column, int]:
    """A BIGINT in the order of ``value``, and how many bits it takes."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
        return value.cast("bigint"), 32
    if isinstance(kind, T.LongType):
        return value, 64
    if isinstance(kind, T.FloatType | T.DoubleType):
        return _double_order(value.cast("double")), 64
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * F.lit(10**kind.scale)).cast("bigint"), 64
    raise TypeError(f"no quantile of {kind.simpleString()}")


def quantile_by(
    df: DataFrame, by: Sequence[str], value: str, q: float, name: str = "quantile"
) -> DataFrame:
    """Interpolated quantile ``q`` of ``value`` per group of ``by``, as DOUBLE column ``name``.

    Nulls are left out, and a group without values has no row. A null in ``by`` is a
    group. NaN counts as the greatest value. The counts of equal values are stored in the
    shared folder, since every pass reads them.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"quantile out of range: {q}")
    groups = [f"group_{i}" for i in range(len(by))]
    bits, width = ordered_bits(F.col(value), df.schema[value].dataType)
    counts = (
        df.filter(F.col(value).isNotNull())
        .select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], bits.alias("bits"), value)
        # -0.0 and 0.0 have one number; so has every NaN.
        .groupBy(*groups, "bits")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(F.col(value)).alias("value"))
    )
    counts = sinks.hand_off(counts, "value-counts")
    position = (F.sum("rows") - 1) * F.lit(q)
    wanted = counts.groupBy(*groups).agg(position.alias("position"))
    # The two ranks around the position; one where it is whole.
    ends = F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position"))))
    own = [f"own_{g}" for g in groups]
    no_bits = F.lit(0).cast("bigint")
    targets = wanted.select(
        *[F.col(g).alias(o) for g, o in zip(groups, own, strict=True)],
        "position",
        ends.alias("rank"),
        no_bits.alias("before"),
        no_bits.alias("found"),
    )
    of_group = F.lit(True)
    for g, o in zip(groups, own, strict=True):
        of_group &= F.col(g).eqNullSafe(F.col(o))
    upto = Window.partitionBy(*own, "rank").orderBy("digit")
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for low in range(width - _DIGIT, -1, -_DIGIT):
        first = low == width - _DIGIT
        prefix = no_bits if first else F.shiftright("bits", low + _DIGIT)
        held = counts.select(*groups, prefix.alias("prefix"), F.shiftright("bits", low).alias("digit"), "rows")
        targets = (
            held.join(targets, (F.col("prefix") == F.col("found")) & of_group)
            .groupBy(*own, "position", "rank", "before", "digit")
            .agg(F.sum("rows").alias("rows"))
            .withColumn("reached", F.col("before") + F.sum("rows").over(upto))
            .filter((F.col("reached") > F.col("rank")) & (F.col("reached") - F.col("rows") <= F.col("rank")))
            .select(
                *own,
                "position",
                "rank",
                (F.col("reached") - F.col("rows")).alias("before"),
                F.col("digit").alias("found"),
            )
        )
    at = targets.join(counts, (F.col("bits") == F.col("found")) & of_group)
    at = at.withColumn("value", F.col("value").cast("double"))
    part = F.max("position") - F.floor(F.max("position"))
    lower, upper = F.min_by("value", "rank"), F.max_by("value", "rank")
    # Equal ends are taken as they are: the difference of infinities is no number.
    between = F.when((lower == upper) | (part == 0), lower).otherwise(lower + part * (upper - lower))
    return at.groupBy(*own).agg(between.alias(name)).select(
        *[F.col(o).alias(c) for c, o in zip(by, own, strict=True)], name
    )
