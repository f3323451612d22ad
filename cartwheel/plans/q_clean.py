"""Driver queries for the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.operators import clean
from cartwheel.plans.registry import query
from cartwheel.sources import tables as tb


@query("dedupe_full")
def q_dedupe_full(spark, d):
    return clean.drop_full_duplicates(tb.raw_transactions(spark, d))


@query("dedupe_key")
def q_dedupe_key(spark, d):
    return clean.drop_key_duplicates(tb.raw_transactions(spark, d), clean.TX_KEYS)


@query("drop_null_keys")
def q_drop_null_keys(spark, d):
    return clean.drop_null_keys(tb.raw_transactions(spark, d), clean.TX_KEYS)


@query("fill_median")
def q_fill_median(spark, d):
    return clean.fill_median(tb.raw_transactions(spark, d), ["price"])


@query("fill_mode")
def q_fill_mode(spark, d):
    return clean.fill_mode(tb.raw_transactions(spark, d), ["sales_channel_id"])


@query("clip_age")
def q_clip_age(spark, d):
    c = tb.raw_customers(spark, d)
    return c.select("customer_id", "age", clean.clip(F.col("age"), *clean.AGE_RANGE).alias("age_clipped"))


@query("standardize_text")
def q_standardize_text(spark, d):
    return clean.standardize_text(tb.raw_articles(spark, d))


@query("normalize_ids")
def q_normalize_ids(spark, d):
    return clean.normalize_ids(tb.raw_transactions(spark, d), ["customer_id", "article_id"])


@query("date_range")
def q_date_range(spark, d):
    """First / last transaction date and the span in days."""
    tx = tb.transactions(spark, d)
    return tx.agg(F.min("t_dat").alias("first_date"), F.max("t_dat").alias("last_date"),
                  F.datediff(F.max("t_dat"), F.min("t_dat")).alias("span_days"))


@query("clean_transactions")
def q_clean_transactions(spark, d):
    return tb.transactions(spark, d)


@query("clean_customers")
def q_clean_customers(spark, d):
    return tb.customers(spark, d)


@query("clean_articles")
def q_clean_articles(spark, d):
    return tb.articles(spark, d)
