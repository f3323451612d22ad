"""Calendar helpers (pandas ``.dt`` semantics)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(d: Column) -> Column:
    """0 = Monday ... 6 = Sunday, like pandas ``dayofweek``."""
    return F.weekday(d)


def iso_week(d: Column) -> Column:
    return F.weekofyear(d)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days ``(later - earlier).days`` for day-grain values."""
    return F.datediff(later, earlier)


def week_ending_sunday(d: Column) -> Column:
    """Label of a pandas ``resample('W')`` bucket: the Sunday closing the week."""
    return F.date_add(F.trunc(d, "week"), 6)
