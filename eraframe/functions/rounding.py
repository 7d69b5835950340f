"""Rounding that does not depend on the order partial sums are merged in.

A mean of doubles differs in its last bits from run to run, because tasks
finish in a different order. Near a tie those bits would flip the rounded
value, so values pass through ten decimal places first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(28,10)"


def round_half_up(value: Column, digits: int) -> Column:
    """Half away from zero, the rule the reports use."""
    return F.round(value.cast(_EXACT), digits).cast("double")


def round_half_even(value: Column, digits: int) -> Column:
    """Half to even, the rule staging and loading use."""
    return F.bround(value.cast(_EXACT), digits).cast("double")
