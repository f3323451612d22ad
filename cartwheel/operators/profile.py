"""Profiling, integrity and EDA aggregates.

Every report is one pass over the table: all per-column statistics are computed
by a single aggregate and turned into rows with ``stack`` afterwards, so the
table is scanned once no matter how many columns it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.dates import week_ending_sunday
from cartwheel.functions.numeric import exact_avg
from cartwheel.operators.quantiles import exact_quantiles

_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Codes of the missing-value report's actions, and its thresholds (fixed values).
ACTION_NONE, ACTION_DROP, ACTION_HIGH = "none", "drop_column", "fill_with_care"
ACTION_TEXT, ACTION_NUM, ACTION_OTHER = "fill_unknown_or_mode", "fill_median_or_zero", "inspect"
DROP_PCT, HIGH_PCT = 70, 30
# Codes of the type report's flags.
FLAG_ID, FLAG_DATE, FLAG_LOWCARD, FLAG_INTLIKE, FLAG_OK = "id_as_text", "parse_date", "low_cardinality", "integer_with_gaps", "ok"
LOW_CARDINALITY = 50


def _stack(row: DataFrame, n: int, exprs: list[str], names: str) -> DataFrame:
    return row.selectExpr(f"stack({n}, {', '.join(exprs)}) AS ({names})")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def shape(df: DataFrame, name: str) -> DataFrame:
    """Rows and columns of a table (memory use is host-only and not reported)."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows",
                                                       F.lit(len(df.columns)).alias("n_columns"))


def missing_counts(df: DataFrame) -> DataFrame:
    """One aggregate: total rows and the NULL count of every column, as rows."""
    aggs = [F.count("*").alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(f"_m{i}")
                                            for i, c in enumerate(df.columns)]
    row = df.agg(*aggs)
    exprs = []
    for i, f in enumerate(df.schema.fields):
        exprs += [_lit(f.name), _lit(f.dataType.simpleString()), f"_m{i}", "_rows"]
    return _stack(row, len(df.columns), exprs, "column_name, dtype, missing_count, total_rows")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with NULLs, count and percentage (2 places)."""
    m = missing_counts(df)
    return (m.where(F.col("missing_count") > 0)
             .select("column_name", "missing_count",
                     F.round(F.col("missing_count") * 100.0 / F.col("total_rows"), 2).alias("missing_pct")))


def missing_actions(df: DataFrame) -> DataFrame:
    """Every column with dtype, NULL count / % and a suggested action."""
    m = missing_counts(df)
    pct = F.col("missing_count") * 100.0 / F.col("total_rows")
    numeric = F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    action = (F.when(F.col("missing_count") == 0, ACTION_NONE)
               .when(pct > DROP_PCT, ACTION_DROP).when(pct > HIGH_PCT, ACTION_HIGH)
               .when(F.col("dtype") == "string", ACTION_TEXT).when(numeric, ACTION_NUM)
               .otherwise(ACTION_OTHER))
    return m.select("column_name", "dtype", "missing_count", F.round(pct, 2).alias("missing_pct"),
                    action.alias("suggested_action"))


def duplicate_report(df: DataFrame, name: str, keys: Sequence[str] | None = None) -> DataFrame:
    """A10: rows beyond the first of each full-row / key group, with percentages."""
    full = df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1).alias("d"))
    total = df.select(F.count("*")).scalar()
    out = full.select(F.lit(name).alias("dataset"), total.alias("total_rows"),
                      F.col("d").alias("full_duplicates"))
    if keys:
        kd = df.groupBy(*keys).count().select(F.sum(F.col("count") - 1)).scalar()
        out = out.withColumn("key_duplicates", kd)
    else:
        out = out.withColumn("key_duplicates", F.lit(None).cast("long"))
    return (out.withColumn("full_pct", F.round(F.col("full_duplicates") * 100.0 / F.col("total_rows"), 3))
               .withColumn("key_pct", F.round(F.col("key_duplicates") * 100.0 / F.col("total_rows"), 3)))


def dtype_report(df: DataFrame) -> DataFrame:
    """Type, a sample value (smallest non-NULL, 30 chars), distinct count and a flag.

    Each column's distinct values are counted by themselves, combined map-side; several
    distinct counts in one aggregate would write every row once per column (Expand).
    """
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        aggs.append(F.min(c).cast("string").alias(f"_s{i}"))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            aggs.append(F.coalesce(F.bool_and(c == F.floor(c)), F.lit(True)).alias(f"_w{i}"))
        else:
            aggs.append(F.lit(False).alias(f"_w{i}"))
    distinct = {f"_u{i}": df.select(F.col(f.name).alias("v")).where("v IS NOT NULL").distinct().agg(F.count("*")).scalar() for i, f in enumerate(df.schema.fields)}
    row = df.agg(*aggs).withColumns(distinct)
    exprs = []
    for i, f in enumerate(df.schema.fields):
        exprs += [_lit(f.name), _lit(f.dataType.simpleString()), f"coalesce(substr(_s{i}, 1, 30), 'N/A')",
                  f"_u{i}", f"_w{i}"]
    r = _stack(row, len(df.columns), exprs, "column_name, dtype, sample_value, unique_values, _intlike")
    is_text = F.col("dtype") == "string"
    flag = (F.when(F.col("column_name").endswith("_id") & F.col("dtype").isin("double", "string"), FLAG_ID)
             .when(F.lower("column_name").contains("date") | ((F.col("column_name") == "t_dat") & is_text), FLAG_DATE)
             .when(is_text & (F.col("unique_values") < LOW_CARDINALITY), FLAG_LOWCARD)
             .when((F.col("dtype") == "double") & F.col("_intlike"), FLAG_INTLIKE)
             .otherwise(FLAG_OK))
    return r.withColumn("flag", flag).drop("_intlike")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles (interpolated), max per column.

    The quartiles are found when called (one job over the counted values); NaN is missing.
    """
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_a{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                 F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
        aggs += [F.lit(q).cast("double").alias(f"_q{i}_{k}") for k, q in enumerate(quartiles[c])]
    row = df.agg(*aggs)
    exprs = []
    for i, c in enumerate(cols):
        exprs += [_lit(c), f"_n{i}", f"_a{i}", f"_s{i}", f"_lo{i}", f"_q{i}_0", f"_q{i}_1", f"_q{i}_2", f"_hi{i}"]
    return _stack(row, len(cols), exprs, "column_name, count, mean, std, min, p25, p50, p75, max")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value (NULLs excluded, like pandas) and share of all counted rows."""
    g = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("count"))
    total = df.select(F.count(col)).scalar()
    return g.withColumn("share", F.col("count") / total)


def histogram(values: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), empty bins kept."""
    v = values.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    bounds = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, 0).otherwise(F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1)))
    counts = v.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    spark = values.sparkSession
    allb = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (allb.join(counts, "bin", "left")
                .select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def weekly_volume(tx: DataFrame, col: str = "t_dat") -> DataFrame:
    """Rows per week ending Sunday, empty weeks as 0 (calendar from min to max)."""
    wk = week_ending_sunday(F.col(col))
    counts = tx.groupBy(wk.alias("week")).agg(F.count("*").alias("purchase_count"))
    lo = counts.select(F.min("week")).scalar()
    hi = counts.select(F.max("week")).scalar()
    spark = tx.sparkSession
    cal = spark.range(1).select(F.explode(F.sequence(lo, hi, F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return cal.join(counts, "week", "left").select("week", F.coalesce("purchase_count", F.lit(0)).alias("purchase_count"))


def quality_report(tx: DataFrame) -> DataFrame:
    """One-row summary of the cleaned transactions; the exact median is found when called."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in tx.columns), F.lit(0))
    median = F.lit(exact_quantiles(tx, ["price"], [0.5])["price"][0]).cast("double")
    return tx.agg(F.count("*").alias("n_rows"), F.count_distinct("customer_id").alias("n_customers"),
                  F.count_distinct("article_id").alias("n_articles"), F.min("t_dat").alias("first_date"),
                  F.max("t_dat").alias("last_date"), nulls.alias("null_cells"),
                  F.min("price").alias("price_min"), F.max("price").alias("price_max"),
                  exact_avg("price").alias("price_mean"), median.alias("price_median"),
                  F.count_if(F.col("sales_channel_id") == 1).alias("channel_1_rows"),
                  F.count_if(F.col("sales_channel_id") == 2).alias("channel_2_rows"))


def coverage(tx: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """A5: distinct keys in the fact table vs the dimension, and the share covered."""
    n_tx = tx.select(F.count_distinct(key)).scalar()
    return dim.agg(F.count_distinct(key).alias("n_dimension")).select(
        F.lit(name).alias("entity"), "n_dimension", n_tx.alias("n_in_transactions"),
        F.round(n_tx * 100.0 / F.col("n_dimension"), 1).alias("coverage_pct"))


def orphans(tx: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of the fact table missing from the dimension (anti join on distinct keys)."""
    return (tx.select(key).distinct().join(dim.select(key), key, "left_anti")
              .select(F.lit(name).alias("entity"), F.col(key).alias("id")))


def top_counts(df: DataFrame, key: str, n: int, name: str = "purchase_count") -> DataFrame:
    """The n most frequent keys (ties by key); Spark plans TakeOrderedAndProject."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(n)


def top_articles(tx: DataFrame, articles: DataFrame, n: int = 20) -> DataFrame:
    """Top-n articles joined to names, label = name[:35].

    The catalogue is first semi-joined to the n winners (broadcast of n keys), so
    the name lookup is a join of two n-row tables.
    """
    top = top_counts(tx, "article_id", n)
    names = articles.select("article_id", "prod_name").join(F.broadcast(top.select("article_id")), "article_id", "left_semi")
    return top.join(F.broadcast(names), "article_id", "left").withColumn("label", F.substring("prod_name", 1, 35))


def top_customers(tx: DataFrame, n: int = 20) -> DataFrame:
    top = top_counts(tx, "customer_id", n)
    return top.withColumn("short_id", F.concat(F.substring("customer_id", 1, 12), F.lit("...")))


def first_last(tx: DataFrame) -> DataFrame:
    """The first and the last transactions in time (all rows on those days)."""
    b = tx.agg(F.min("t_dat").alias("lo"), F.max("t_dat").alias("hi"))
    lo, hi = b.select("lo").scalar(), b.select("hi").scalar()
    return (tx.where((F.col("t_dat") == lo) | (F.col("t_dat") == hi))
              .withColumn("position", F.when(F.col("t_dat") == lo, "first").otherwise("last")))
