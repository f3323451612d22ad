"""Driver queries for sources/resolution helpers and the context features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.functions.text import truncate_label
from cartwheel.operators import context as cx
from cartwheel.plans.registry import query
from cartwheel.sources import io
from cartwheel.sources import tables as tb

CATALOG_OPTIONAL = ["product_type_name", "product_group_name", "colour_group_name", "section_name",
                    "garment_group_name", "index_name", "index_group_name"]


@query("star_views")
def q_star_views(spark, d):
    """The cleaned fact table joined to both dimensions (the star as one view)."""
    tx = tb.transactions(spark, d)
    c = tb.customers(spark, d).select("customer_id", "age", "club_member_status")
    a = tb.articles(spark, d).select("article_id", "product_type_name", "colour_group_name")
    return tx.join(c, "customer_id").join(a, "article_id")


@query("resolve_ids")
def q_resolve_ids(spark, d):
    """Resolve the shared id pair and rename it to user_id / item_id."""
    tx = tb.transactions(spark, d)
    u, i = io.resolve_id_columns(tx, tb.customers(spark, d), tb.articles(spark, d))
    return io.canonical_ids(tx.select(u, i, "t_dat"), u, i)


@query("known_ids")
def q_known_ids(spark, d):
    return io.known_ids(io.check_metadata(tb.articles(spark, d)))


@query("id_picker")
def q_id_picker(spark, d):
    return io.id_picker(tb.transactions(spark, d), "customer_id", 500)


@query("catalog_attrs")
def q_catalog_attrs(spark, d):
    """Article id plus the optional catalogue columns that exist."""
    a = tb.articles(spark, d)
    return a.select("article_id", *[c for c in CATALOG_OPTIONAL if c in a.columns])


@query("short_labels")
def q_short_labels(spark, d):
    """X11: display cuts of names and descriptions."""
    a = tb.articles(spark, d)
    return a.select("article_id", truncate_label(F.col("prod_name"), 35).alias("label"),
                    F.concat(F.substring("article_id", 1, 12), F.lit("...")).alias("short_id"),
                    F.substring("detail_desc", 1, 120).alias("description"))


@query("recent_purchase_count")
def q_recent_purchase_count(spark, d):
    return cx.recent_purchase_count(tb.transactions(spark, d))


@query("preferred_attribute")
def q_preferred_attribute(spark, d):
    tx, a = tb.transactions(spark, d), tb.articles(spark, d)
    t = cx.preferred_attribute(tx, a, "product_type_name", "preferred_product_type")
    c = cx.preferred_attribute(tx, a, "colour_group_name", "preferred_color")
    return t.join(c, "customer_id", "full")


@query("season_weekend_flags")
def q_season_weekend_flags(spark, d):
    return cx.season_weekend_flags(tb.transactions(spark, d))


@query("popularity_trend")
def q_popularity_trend(spark, d):
    return cx.popularity_trend(tb.transactions(spark, d))
