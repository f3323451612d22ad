"""Text helpers that reproduce Python string semantics with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.strip()`` removes for ASCII text
# (space, tab, newline, carriage return, form feed, vertical tab).
PY_WHITESPACE = " \t\n\r\f\u000b"


def py_strip(c: Column) -> Column:
    """``str.strip()``: trims every ASCII whitespace character, not only blanks."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def title_case(c: Column) -> Column:
    """``str.title()``: upper-case the first letter of every run of letters.

    ``initcap`` only splits on blanks; Python starts a new word after any non-letter,
    so ``t-shirt`` -> ``T-Shirt`` and ``women's`` -> ``Women'S``.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cap = F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(cap, ""))


def truncate_label(c: Column, n: int, suffix: str = "") -> Column:
    """``s[:n] + suffix`` when longer than n, else s (suffix only appended on cut)."""
    if not suffix:
        return F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def safe_str(c: Column, floating: bool = False) -> Column:
    """Text form of a value; NULL (and NaN for floating columns) stays NULL."""
    out = c.cast("string")
    if floating:
        return F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string")).otherwise(out)
    return out
