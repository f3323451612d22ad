"""The key of a given rank, by radix selection.

A histogram of the keys' leading digits shows which prefix holds the wanted rank; the next
pass looks at the rows of that prefix alone, one group of digits further.  A pass moves
at most one count per prefix, never a row, so no task holds the first n rows, nothing is
sorted and no index is built or joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits told apart in a pass, and rows of a prefix whose keys are read as they are.
DIGITS, FEW_ROWS = 3, 4096


def key_at(keys: DataFrame, col: str, rank: int | Callable[[int], int]) -> tuple[str | None, int]:
    """``(key, rows before it)`` of the row at ``rank`` (from 0) in the order of the hexadecimal keys ``col`` of one length.

    ``rank`` may be computed from the number of rows.  Null keys do not count; a rank
    beyond the last row gives no key, and all rows lie before it.  Runs a job per pass:
    about log 4096 of the number of rows.
    """
    rest, prefix, before = keys.select(F.col(col).alias("k")).where("k IS NOT NULL"), "", 0
    while True:
        bins = (rest.where(F.col("k").startswith(prefix)).groupBy(F.substring("k", len(prefix) + 1, DIGITS).alias("digits"))
                .agg(F.count(F.lit(1)).alias("n")).orderBy("digits").collect())   # 16 ** DIGITS rows at most
        if callable(rank):
            rank = rank(sum(b["n"] for b in bins))
        for b in bins:
            if rank < before + b["n"]:
                break
            before += b["n"]
        else:
            return None, before
        prefix += b["digits"]
        if b["digits"] == "":  # the whole key: all rows left are equal
            return prefix, before
        if b["n"] <= FEW_ROWS:
            few = sorted(r["k"] for r in rest.where(F.col("k").startswith(prefix)).collect())
            key = few[rank - before]
            return key, before + few.index(key)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of the hexadecimal column ``key``; of rows that share the last key any."""
    if n <= 0:
        return df.limit(0)
    last, before = key_at(df, key, n - 1)
    if last is None:
        return df.where(F.col(key).isNotNull())
    return df.where(F.col(key) < last).unionByName(df.where(F.col(key) == last).limit(n - before))
