"""Documented-but-uncoded features of the studied plan (D1-D4): ordinary Spark features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Meteorological seasons (northern hemisphere) by month.
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring",
           6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}
RECENT_DAYS = 30


def recent_purchase_count(tx: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """Per customer, purchases in the last ``days`` days of the data (0 when none)."""
    ref = tx.select(F.max("t_dat")).scalar()
    recent = F.col("t_dat") >= F.date_sub(ref, days)
    return tx.groupBy("customer_id").agg(F.count_if(recent).alias("recent_purchase_count"))


def preferred_attribute(tx: DataFrame, articles: DataFrame, attr: str, name: str | None = None) -> DataFrame:
    """Each customer's most purchased value of ``attr`` (ties -> smallest value).

    Counts are a (customer, value) aggregate; the ranking window then sees one
    row per distinct value of a customer, never the customer's raw rows.
    """
    name = name or f"preferred_{attr}"
    j = tx.select("customer_id", "article_id").join(articles.select("article_id", attr), "article_id")
    c = j.groupBy("customer_id", attr).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("_n"), F.asc(attr))
    return (c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
             .select("customer_id", F.col(attr).alias(name), F.col("_n").alias(f"{name}_count")))


def season_weekend_flags(tx: DataFrame) -> DataFrame:
    """D3: purchase month, season and weekend flag per transaction."""
    m = F.month("t_dat")
    season = F.element_at(F.create_map(*[x for k, v in SEASONS.items() for x in (F.lit(k), F.lit(v))]), m)
    return tx.select("customer_id", "article_id", "t_dat", m.alias("purchase_month"),
                     season.alias("purchase_season"), (F.weekday("t_dat") >= 5).cast("int").alias("weekend_purchase"))


def popularity_trend(tx: DataFrame) -> DataFrame:
    """Monthly purchases per article and the change against the article's previous month."""
    mo = F.trunc("t_dat", "month")
    g = tx.groupBy("article_id", mo.alias("month")).agg(F.count("*").alias("purchases"))
    w = Window.partitionBy("article_id").orderBy("month")
    prev = F.lag("purchases").over(w)
    return g.withColumn("prev_purchases", prev).withColumn("trend", F.col("purchases") - F.col("prev_purchases"))
