"""Item features: popularity, recent popularity, trending, article age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.numeric import exact_avg

RECENT_DAYS = 30


def _ref(tx: DataFrame, reference_date) -> Column:
    if reference_date is None:
        return tx.select(F.max("t_dat")).scalar()
    return F.lit(reference_date).cast("date")


def popularity_features(tx: DataFrame, reference_date=None) -> DataFrame:
    """Per-article counts, buyers, mean price, first/last sale, score = n / max n."""
    ref = _ref(tx, reference_date)
    aggs = [F.count("customer_id").alias("total_purchases"),
            F.count_distinct("customer_id").alias("unique_buyers")]
    if "price" in tx.columns:
        aggs.append(exact_avg("price").alias("avg_price"))
    aggs += [F.min("t_dat").alias("first_sold_date"), F.max("t_dat").alias("last_sold_date")]
    pop = tx.groupBy("article_id").agg(*aggs)
    mx = pop.select(F.max("total_purchases")).scalar()
    return (pop.withColumn("days_since_last_sale", F.datediff(ref, F.col("last_sold_date")))
               .withColumn("popularity_score", F.col("total_purchases") / mx))


def recent_window(tx: DataFrame, days: int, ref) -> DataFrame:
    """Rows of the inclusive window ``[ref - days, ...]``.

    The bound is a scalar subquery.  On the job's fact table, which is partitioned by
    ``month``, the same bound on the month leaves only the partitions that can hold such rows.
    """
    first = F.date_sub(ref, days)
    if "month" in tx.columns:
        tx = tx.where(F.col("month") >= F.date_format(first, "yyyy-MM")).drop("month")
    return tx.where(F.col("t_dat") >= first)


def recent_popularity(tx: DataFrame, days: int = RECENT_DAYS, reference_date=None) -> DataFrame:
    """purchases in the recent window."""
    recent = recent_window(tx, days, _ref(tx, reference_date))
    return recent.groupBy("article_id").agg(F.count("customer_id").alias(f"purchases_last_{days}d"))


def trending(tx: DataFrame, days: int = RECENT_DAYS, reference_date=None) -> DataFrame:
    """recent purchases and their share of the window's best seller."""
    recent = recent_window(tx, days, _ref(tx, reference_date))
    g = recent.groupBy("article_id").agg(F.count("customer_id").alias("recent_purchases"))
    mx = g.select(F.max("recent_purchases")).scalar()
    return g.withColumn("recent_popularity_score", F.col("recent_purchases") / mx)


def article_age(articles: DataFrame, tx: DataFrame, reference_date=None) -> DataFrame:
    """days since first sale; never-sold articles get the oldest age."""
    ref = _ref(tx, reference_date)
    first = (tx.groupBy("article_id").agg(F.min("t_dat").alias("first_sold_date"))
               .withColumn("article_age_days", F.datediff(ref, F.col("first_sold_date"))))
    j = articles.select("article_id").join(first, "article_id", "left")
    oldest = first.select(F.max("article_age_days")).scalar()
    return j.withColumn("article_age_days", F.coalesce(F.col("article_age_days"), oldest))


def merge_item_features(articles: DataFrame, pop: DataFrame, recent: DataFrame,
                        unsold_days: int = 0) -> DataFrame:
    """Articles LEFT JOIN popularity LEFT JOIN recent popularity, zero fill.

    ``unsold_days`` reproduces the studied default (0: unsold items look fresh);
    pass e.g. 9999 to repair it (SURVEY H3).
    """
    j = articles.join(pop, "article_id", "left").join(recent, "article_id", "left")
    zero = {"total_purchases": F.lit(0).cast("long"), "unique_buyers": F.lit(0).cast("long"),
            "popularity_score": F.lit(0.0), "days_since_last_sale": F.lit(unsold_days)}
    for c in recent.columns:
        if c.startswith("purchases_last_"):
            zero[c] = F.lit(0).cast("long")
    return j.select(*[F.coalesce(F.col(c), zero[c]).alias(c) if c in zero else F.col(c) for c in j.columns])


def item_features(articles: DataFrame, tx: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    return merge_item_features(articles, popularity_features(tx), recent_popularity(tx, days))
