"""Numeric helpers.

Money sums are taken in fixed point (``decimal(28,6)``): the result no longer
depends on how rows are spread over partitions, so reruns on a different cluster
shape give bit-identical features (and the SQL oracle can reproduce them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"


def exact_sum(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(MONEY)).cast("double")


def exact_avg(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return exact_sum(c) / F.count(c)


def round_half_up(c: Column, places: int = 6) -> Column:
    """Round the scaled double half away from zero (the oracle uses the same formula)."""
    scale = float(10 ** places)
    # "+ 0.0" turns a negative zero into 0.0 so equal values also print equal
    return F.round(c.cast("double") * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


def safe_ratio(num: Column, den: Column, floor: float = 1) -> Column:
    """``num / max(den, floor)``."""
    return num / F.greatest(den, F.lit(floor))


def decay(days: Column, rate: float = 0.01) -> Column:
    """``exp(-rate * days)``."""
    return F.exp(-F.lit(rate) * days)
