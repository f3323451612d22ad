"""Driver queries for user / item / interaction features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.operators import interactions as inter
from cartwheel.operators import item, user
from cartwheel.plans.registry import query
from cartwheel.sources import tables as tb


@query("user_features")
def q_user_features(spark, d):
    """cleaned customers LEFT JOIN RFM features of cleaned transactions."""
    return user.user_features(tb.customers(spark, d), tb.transactions(spark, d))


@query("user_purchase_agg")
def q_user_purchase_agg(spark, d):
    return user.purchase_aggregates(tb.transactions(spark, d))


@query("user_rfm")
def q_user_rfm(spark, d):
    return user.purchase_features(tb.transactions(spark, d))


@query("recency_score")
def q_recency_score(spark, d):
    return user.recency_score(tb.transactions(spark, d), reference_date="2001-09-01")


@query("purchase_frequency_weekly")
def q_purchase_frequency_weekly(spark, d):
    return user.weekly_purchase_frequency(tb.transactions(spark, d))


@query("spend_features")
def q_spend_features(spark, d):
    return user.spend_features(tb.transactions(spark, d))


@query("active_split")
def q_active_split(spark, d):
    return user.active_split(user.user_features(tb.customers(spark, d), tb.transactions(spark, d)))


@query("item_popularity")
def q_item_popularity(spark, d):
    return item.popularity_features(tb.transactions(spark, d))


@query("recent_popularity")
def q_recent_popularity(spark, d):
    return item.recent_popularity(tb.transactions(spark, d), 30)


@query("trending_scores")
def q_trending_scores(spark, d):
    """recent popularity and its score for every article sold in the last 30 days."""
    return item.trending(tb.transactions(spark, d), 30)


@query("trending_items")
def q_trending_items(spark, d):
    """The five trending articles of the last 30 days."""
    t = item.trending(tb.transactions(spark, d), 30)
    return t.orderBy(F.desc("recent_purchases"), "article_id").limit(5)


@query("article_age")
def q_article_age(spark, d):
    return item.article_age(tb.articles(spark, d), tb.transactions(spark, d))


@query("item_features")
def q_item_features(spark, d):
    return item.item_features(tb.articles(spark, d), tb.transactions(spark, d))


@query("interaction_features")
def q_interaction_features(spark, d):
    return inter.interaction_features(tb.transactions(spark, d))


@query("repeat_purchase")
def q_repeat_purchase(spark, d):
    return inter.add_repeat_purchase_flag(inter.base_interactions(tb.transactions(spark, d)))


@query("recency_weight")
def q_recency_weight(spark, d):
    return inter.add_recency_weight(inter.base_interactions(tb.transactions(spark, d)))


@query("calendar_features")
def q_calendar_features(spark, d):
    tx = tb.transactions(spark, d).select("customer_id", "article_id", "t_dat")
    return inter.add_time_features(tx)


@query("positive_pairs")
def q_positive_pairs(spark, d):
    return inter.positive_pairs(tb.transactions(spark, d))


@query("popularity_score")
def q_popularity_score(spark, d):
    """Purchases per article as a share of the best seller (scalar max, no global window)."""
    return item.popularity_features(tb.transactions(spark, d)).select("article_id", "total_purchases", "popularity_score")
