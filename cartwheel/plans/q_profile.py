"""Driver queries for profiling, integrity checks and EDA aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.operators import profile as pr
from cartwheel.operators import user
from cartwheel.plans.registry import query
from cartwheel.sources import tables as tb


@query("quality_report")
def q_quality_report(spark, d):
    return pr.quality_report(tb.transactions(spark, d))


@query("coverage")
def q_coverage(spark, d):
    tx = tb.transactions(spark, d)
    return (pr.coverage(tx, tb.customers(spark, d), "customer_id", "customers")
              .unionByName(pr.coverage(tx, tb.articles(spark, d), "article_id", "articles")))


@query("value_counts")
def q_value_counts(spark, d):
    return pr.value_counts(tb.transactions(spark, d), "sales_channel_id")


@query("value_counts_status")
def q_value_counts_status(spark, d):
    return pr.value_counts(tb.customers(spark, d), "club_member_status")


@query("describe_counts")
def q_describe_counts(spark, d):
    rfm = user.purchase_features(tb.transactions(spark, d))
    return pr.describe(rfm, ["purchase_count", "total_spend", "days_since_last_purchase"])


@query("missing_report")
def q_missing_report(spark, d):
    return pr.missing_report(tb.raw_customers(spark, d))


@query("missing_actions")
def q_missing_actions(spark, d):
    return pr.missing_actions(tb.raw_articles(spark, d))


@query("duplicate_report")
def q_duplicate_report(spark, d):
    return (pr.duplicate_report(tb.raw_transactions(spark, d), "transactions", ["customer_id", "article_id", "t_dat"])
              .unionByName(pr.duplicate_report(tb.raw_customers(spark, d), "customers", ["customer_id"]))
              .unionByName(pr.duplicate_report(tb.raw_articles(spark, d), "articles", ["article_id"])))


@query("dtype_report")
def q_dtype_report(spark, d):
    return pr.dtype_report(tb.raw_customers(spark, d))


@query("shape_overview")
def q_shape_overview(spark, d):
    return (pr.shape(tb.raw_transactions(spark, d), "transactions")
              .unionByName(pr.shape(tb.raw_customers(spark, d), "customers"))
              .unionByName(pr.shape(tb.raw_articles(spark, d), "articles")))


@query("age_histogram")
def q_age_histogram(spark, d):
    return pr.histogram(tb.raw_customers(spark, d), "age", 50)


@query("purchase_count_histogram")
def q_purchase_count_histogram(spark, d):
    """Purchases per customer capped at 100, 60 bins."""
    per = tb.transactions(spark, d).groupBy("customer_id").agg(F.least(F.count("*"), F.lit(100)).alias("n"))
    return pr.histogram(per, "n", 60)


@query("weekly_volume")
def q_weekly_volume(spark, d):
    return pr.weekly_volume(tb.transactions(spark, d))


@query("orphans")
def q_orphans(spark, d):
    tx = tb.transactions(spark, d)
    return (pr.orphans(tx, tb.customers(spark, d), "customer_id", "customer")
              .unionByName(pr.orphans(tx, tb.articles(spark, d), "article_id", "article")))


@query("top_articles")
def q_top_articles(spark, d):
    return pr.top_articles(tb.transactions(spark, d), tb.articles(spark, d), 20)


@query("top_customers")
def q_top_customers(spark, d):
    return pr.top_customers(tb.transactions(spark, d), 20)


@query("first_last_txn")
def q_first_last_txn(spark, d):
    return pr.first_last(tb.transactions(spark, d))
