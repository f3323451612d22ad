"""Cleaning operators (dedupe, null policy, text, types) and the three cleaning jobs.

Design notes for scale:
* key de-duplication is a ``row_number() == 1`` filter; Spark plans it as a
  ``WindowGroupLimit`` so only one row per key and task crosses the shuffle;
* medians and modes are one scalar subquery per table (one partial/final aggregate,
  its buffer is a value->count map bounded by the column's distinct values);
* every projection is a single ``select`` so Catalyst fuses it into one codegen stage.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.text import py_strip, title_case
from cartwheel.operators.quantiles import exact_quantiles
from cartwheel.session import stored

# Fixed values of the studied cleaning policy.
TX_KEYS = ("customer_id", "article_id", "t_dat")
ARTICLE_KEYS = ("article_id",)
CUSTOMER_KEYS = ("customer_id",)
CUSTOMER_FLAG_COLS = ("FN", "Active")
CUSTOMER_TEXT_FILLS = {"club_member_status": "Unknown", "fashion_news_frequency": "None"}
AGE_RANGE = (15, 100)
DESC_FILL = "No description"
TEXT_FILL = "Unknown"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def drop_full_duplicates(df: DataFrame) -> DataFrame:
    """Remove rows identical in every column (NULL equals NULL)."""
    return df.dropDuplicates()


def drop_key_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Keep one row per key; absent key columns are ignored.

    "First" is made deterministic: by default the remaining columns ascending,
    NULLs last.  Running it after :func:`drop_full_duplicates` gives the same rows,
    so the jobs call only this one (one shuffle instead of two).
    """
    ks = present(df, keys)
    if not ks:
        return drop_full_duplicates(df)
    if order is None:
        order = [F.col(c).asc_nulls_last() for c in df.columns if c not in ks]
    if not order:
        return df.dropDuplicates(ks)
    w = Window.partitionBy(*ks).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P3."""
    ks = present(df, keys)
    return df.na.drop(subset=ks) if ks else df


def clip(c: Column, lo=None, hi=None) -> Column:
    """Pandas ``clip``: NULL stays NULL (``greatest``/``least`` would skip it)."""
    out = c
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return F.when(c.isNull(), c).otherwise(out)


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """The exact median of every column (P5), found when called; NULL and NaN are missing."""
    return {c: F.lit(q[0]).cast("double") for c, q in exact_quantiles(df, cols, [0.5]).items()}


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: NULL -> column median (interpolated like pandas); filled columns become double."""
    cols = present(df, cols)
    med = column_medians(df, cols)
    return df.select(*[F.coalesce(F.col(c).cast("double"), med[c]).alias(c) if c in med else F.col(c)
                       for c in df.columns])


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> most frequent value, smallest on ties (pandas ``mode()[0]``)."""
    cols = present(df, cols)
    if not cols:
        return df
    s = df.select(F.struct(*[F.mode(F.col(c), True).alias(c) for c in cols]).alias("m")).scalar()
    return df.select(*[F.coalesce(F.col(c), s.getField(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def normalize_ids(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: ids to text, stripped."""
    cols = set(present(df, cols))
    return df.select(*[py_strip(F.col(c).cast("string")).alias(c) if c in cols else F.col(c) for c in df.columns])


def standardize_text(df: DataFrame, exclude: Sequence[str] = ARTICLE_KEYS) -> DataFrame:
    """Strip every text column; lower-case ``*desc*`` columns, title-case the rest."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType) and f.name not in exclude:
            s = py_strip(c)
            c = F.lower(s) if "desc" in f.name.lower() else title_case(s)
        out.append(c.alias(f.name))
    return df.select(*out)


def fill_by_type(df: DataFrame, exclude: Sequence[str] = ARTICLE_KEYS) -> DataFrame:
    """Text -> 'No description' (name contains 'desc') or 'Unknown'; numbers -> median."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]
    med = column_medians(df, numeric)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in exclude:
            pass
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(DESC_FILL if "desc" in f.name.lower() else TEXT_FILL))
        elif f.name in med:
            c = F.coalesce(c.cast("double"), med[f.name]).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- composed jobs

def clean_transactions(df: DataFrame) -> DataFrame:
    """Dedupe -> drop NULL keys -> price median / channel mode -> dates -> types.

    Ids are stripped *after* de-duplication, as in the studied job, so ids that
    differ only by padding survive as separate rows (SURVEY H18).  The de-duplicated rows
    are written and the median is found when called: median, mode and fills read them again,
    so the join and the shuffle before them run once.
    """
    return fill_transactions(stored(drop_null_keys(drop_key_duplicates(df, TX_KEYS), TX_KEYS), "transactions"))


def fill_transactions(df: DataFrame) -> DataFrame:
    """C1 after de-duplication: price median / channel mode -> dates -> types."""
    fills = column_medians(df, present(df, ["price"]))
    if "sales_channel_id" in df.columns:
        fills["sales_channel_id"] = df.select(F.mode("sales_channel_id", True)).scalar()
    df = df.select(*[F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c) for c in df.columns])
    cols = []
    for c in df.columns:
        if c == "t_dat":
            cols.append(F.to_date("t_dat").alias(c))
        elif c in ("customer_id", "article_id"):
            cols.append(py_strip(F.col(c).cast("string")).alias(c))
        elif c == "price":
            cols.append(F.col(c).cast("double").alias(c))
        elif c == "sales_channel_id":
            cols.append(F.col(c).cast("byte").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def clean_customers(df: DataFrame) -> DataFrame:
    """Dedupe -> drop NULL id -> constant fills -> age median + clip -> types; the de-duplicated rows are written when called, as in C1."""
    df = stored(drop_null_keys(drop_key_duplicates(df, CUSTOMER_KEYS), CUSTOMER_KEYS), "customers")
    med = column_medians(df, present(df, ["age"]))
    cols = []
    for c in df.columns:
        col = F.col(c)
        if c == "customer_id":
            col = py_strip(col.cast("string"))
        elif c in CUSTOMER_FLAG_COLS:
            col = F.coalesce(col, F.lit(0)).cast("int")
        elif c in CUSTOMER_TEXT_FILLS:
            col = py_strip(F.coalesce(col.cast("string"), F.lit(CUSTOMER_TEXT_FILLS[c])))
        elif c == "age":
            col = clip(F.coalesce(col.cast("double"), med["age"]), *AGE_RANGE).cast("int")
        cols.append(col.alias(c))
    return df.select(*cols)


def clean_articles(df: DataFrame) -> DataFrame:
    """Dedupe -> drop NULL id -> type-driven fills -> text -> types; the de-duplicated rows are written when called, as in C1."""
    df = stored(drop_null_keys(drop_key_duplicates(df, ARTICLE_KEYS), ARTICLE_KEYS), "articles")
    df = fill_by_type(df)
    df = standardize_text(df)
    cols = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if f.name == "article_id":
            col = py_strip(col.cast("string"))
        elif f.name.endswith("_no") and isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            col = col.cast("long")
        cols.append(col.alias(f.name))
    return df.select(*cols)
