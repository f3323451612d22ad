"""User features: RFM aggregate, cold-start merge, notebook variants."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.numeric import exact_avg, exact_sum

# Fixed values of the studied feature definitions.
ACTIVE_DAYS = 90
COLD_DAYS = 9999


def _scalar(df: DataFrame, expr: Column) -> Column:
    """A one-value scalar subquery; Catalyst runs it once and inlines the value."""
    return df.select(expr).scalar()


def purchase_aggregates(tx: DataFrame) -> DataFrame:
    """A1: one hash aggregate per customer (partial aggregation before the shuffle)."""
    aggs = [F.count("article_id").alias("purchase_count"),
            F.max("t_dat").alias("recent_purchase_date"),
            F.min("t_dat").alias("first_purchase_date")]
    if "price" in tx.columns:
        aggs += [exact_sum("price").alias("total_spend"), exact_avg("price").alias("avg_spend_per_txn")]
    aggs.append(F.count_distinct("article_id").alias("unique_articles"))
    return tx.groupBy("customer_id").agg(*aggs)


def purchase_features(tx: DataFrame, reference_date: Column | None = None,
                      active_days: int = ACTIVE_DAYS) -> DataFrame:
    """aggregates + recency vs the data's last day, frequency per active day, active flag."""
    ref = reference_date if reference_date is not None else _scalar(tx, F.max("t_dat"))
    agg = purchase_aggregates(tx)
    days = F.datediff(ref, F.col("recent_purchase_date"))
    span = F.greatest(F.datediff("recent_purchase_date", "first_purchase_date"), F.lit(1))
    return (agg.withColumn("days_since_last_purchase", days)
               .withColumn("purchase_frequency", F.col("purchase_count") / span)
               .withColumn("active_status", (F.col("days_since_last_purchase") <= active_days).cast("int")))


def merge_with_customers(customers: DataFrame, pf: DataFrame) -> DataFrame:
    """Customers LEFT JOIN features; cold users get 0 / 9999 / 0.0.

    As in the studied job, dates, average spend and distinct-article count stay NULL
    for cold users.  Both sides are keyed by ``customer_id`` and one row per key, so
    this is a plain shuffle (or broadcast, decided by AQE from runtime sizes).
    """
    j = customers.join(pf, on="customer_id", how="left")
    fills = {"purchase_count": F.lit(0).cast("long"), "days_since_last_purchase": F.lit(COLD_DAYS),
             "active_status": F.lit(0), "purchase_frequency": F.lit(0.0), "total_spend": F.lit(0.0)}
    return j.select(*[F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c) for c in j.columns])


def user_features(customers: DataFrame, tx: DataFrame) -> DataFrame:
    return merge_with_customers(customers, purchase_features(tx))


def recency_score(tx: DataFrame, reference_date: str | _dt.date = "2020-09-23") -> DataFrame:
    """``1 - days / max(days)`` against a fixed reference date; 0/0 -> 1."""
    ref = F.lit(reference_date).cast("date") if isinstance(reference_date, str) else F.lit(reference_date)
    r = (tx.groupBy("customer_id").agg(F.max("t_dat").alias("last_purchase_date"))
           .withColumn("days_since_purchase", F.datediff(ref, F.col("last_purchase_date"))))
    mx = _scalar(r, F.max("days_since_purchase"))
    score = F.coalesce(1 - F.col("days_since_purchase") / F.nullif(mx, F.lit(0)), F.lit(1.0))
    return (r.withColumn("recency_score", score)
             .withColumn("active_status", (F.col("days_since_purchase") <= ACTIVE_DAYS).cast("int")))


def weekly_purchase_frequency(tx: DataFrame) -> DataFrame:
    """purchases per week of span, span floored at one week."""
    g = tx.groupBy("customer_id").agg(F.count("*").alias("purchase_count"),
                                      F.min("t_dat").alias("first_purchase"),
                                      F.max("t_dat").alias("last_purchase"))
    weeks = F.greatest(F.datediff("last_purchase", "first_purchase") / 7.0, F.lit(1.0))
    return g.select("customer_id", (F.col("purchase_count") / weeks).alias("purchase_frequency"))


def spend_features(tx: DataFrame) -> DataFrame:
    """spend alone; without a price column, just the distinct customers."""
    if "price" not in tx.columns:
        return tx.select("customer_id").distinct()
    return tx.groupBy("customer_id").agg(exact_sum("price").alias("total_spend"),
                                         exact_avg("price").alias("avg_spend_per_transaction"))


def active_split(features: DataFrame) -> DataFrame:
    """active / inactive counts with percentage of all customers."""
    g = features.groupBy("active_status").agg(F.count("*").alias("n_customers"))
    total = _scalar(features, F.count("*"))
    return g.withColumn("pct", F.round(F.col("n_customers") * 100.0 / total, 1))
