"""Driver queries for sampling, splits, vocabularies and negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.operators import interactions as inter
from cartwheel.operators import sampling as sp
from cartwheel.plans.registry import query
from cartwheel.sources import tables as tb


@query("sample_n")
def q_sample_n(spark, d):
    """The 20,000-interaction training sample (a sampling operator: the limit is the feature)."""
    tx = tb.transactions(spark, d).select("customer_id", "article_id", "t_dat")
    return sp.sample_n(tx, 20000, ["customer_id", "article_id", "t_dat"])


@query("train_test_split")
def q_train_test_split(spark, d):
    pairs = tb.transactions(spark, d).select("customer_id", "article_id").distinct()
    return sp.train_test_split(pairs, ["customer_id", "article_id"], 0.8)


@query("train_test_split_exact")
def q_train_test_split_exact(spark, d):
    """R2: exactly the first 80% of distinct pairs in seeded hash order are training pairs."""
    pairs = tb.transactions(spark, d).select("customer_id", "article_id").distinct()
    return sp.train_test_split_exact(pairs, ["customer_id", "article_id"], 0.8)


@query("temporal_split")
def q_temporal_split(spark, d):
    tx = tb.transactions(spark, d).select("customer_id", "article_id", "t_dat")
    return sp.temporal_split(tx, "2000-01-01")


@query("vocabulary")
def q_vocabulary(spark, d):
    return sp.vocabulary(tb.transactions(spark, d), "customer_id")


@query("item_vocabulary")
def q_item_vocabulary(spark, d):
    return sp.vocabulary(tb.transactions(spark, d), "article_id")


@query("eligible_users")
def q_eligible_users(spark, d):
    return sp.eligible_users(tb.transactions(spark, d), 2)


@query("sample_eval_users")
def q_sample_eval_users(spark, d):
    """500 eligible users by seeded hash order (the studied default)."""
    return sp.sample_eval_users(tb.transactions(spark, d), 500, 2)


@query("semi_sampled_users")
def q_semi_sampled_users(spark, d):
    """Interactions of all eligible users (left semi join, never a big IN list)."""
    tx = tb.transactions(spark, d)
    return tx.join(sp.eligible_users(tx, 2), "customer_id", "left_semi")


@query("keep_known")
def q_keep_known(spark, d):
    """Transactions whose customer and article both exist in the dimensions."""
    tx = tb.transactions(spark, d)
    return (tx.join(tb.customers(spark, d).select("customer_id"), "customer_id", "left_semi")
              .join(tb.articles(spark, d).select("article_id"), "article_id", "left_semi"))


@query("negatives")
def q_negatives(spark, d):
    return sp.negatives(tb.transactions(spark, d), ratio=1)


@query("training_pairs")
def q_training_pairs(spark, d):
    tx = tb.transactions(spark, d)
    return sp.training_pairs(inter.positive_pairs(tx), sp.negatives(tx, ratio=1))
