"""Driver queries for readers, writers and stored tables: each writes whole tables to the shared folder and reads them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartwheel.operators import clean, item, profile, user
from cartwheel.operators import recommend as rc
from cartwheel.plans.q_retrieval import _batch_recs
from cartwheel.plans.registry import query
from cartwheel.session import ensure_checkpoint_dir
from cartwheel.sources import bucketed, io
from cartwheel.sources import tables as tb


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


def _as_csv(df, path):
    io.write_table(df, path, fmt="csv")
    return path


@query("raw_csv_transactions")
def q_raw_csv_transactions(spark, d):
    """The raw fact table through CSV and its declared types; padded ids come back as they were."""
    return io.read_raw_transactions(spark, _as_csv(tb.raw_transactions(spark, d), f"{_folder(spark)}/transactions"))


@query("raw_csv_articles")
def q_raw_csv_articles(spark, d):
    """S2."""
    return io.read_raw_articles(spark, _as_csv(tb.raw_articles(spark, d), f"{_folder(spark)}/articles"))


@query("raw_csv_customers")
def q_raw_csv_customers(spark, d):
    """S3."""
    return io.read_raw_customers(spark, _as_csv(tb.raw_customers(spark, d), f"{_folder(spark)}/customers"))


@query("first_existing_source")
def q_first_existing_source(spark, d):
    """The cleaned articles are written under the second of three names and found there."""
    path = _folder(spark)
    io.write_table(tb.articles(spark, d), f"{path}/articles_cleaned")
    return spark.read.parquet(io.resolve_first_existing(spark, path, ["articles_final", "articles_cleaned", "articles"]))


@query("alternate_item_key")
def q_alternate_item_key(spark, d):
    """A recommendation table keyed by item_id meets checked metadata keyed by article_id."""
    articles = tb.articles(spark, d)
    meta = io.check_metadata(articles).select("article_id", "product_type_name")
    return io.normalize_item_key(_batch_recs(spark, d, articles=articles)).join(meta, "article_id")


@query("model_settings")
def q_model_settings(spark, d):
    """Settings with the width of the stored vectors, saved, loaded and joined to the vectors they describe."""
    path, vectors = _folder(spark), tb.factors(spark, d)
    width = vectors.agg(F.max(F.size("features"))).first()[0]
    io.save_model_config(spark, {"embedding_dim": width}, path)
    config = io.load_model_config(spark, path)
    fits = F.count_if(F.size("features") == config["embedding_dim"])
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"), fits.alias("n_fitting")).select(
        "n_vectors", "n_fitting", *[F.lit(config[k]).alias(k) for k in io.DEFAULT_MODEL_CONFIG])


@query("batch_export")
def q_batch_export(spark, d):
    """The readable recommendations of all users, written once and read back."""
    path = _folder(spark)
    io.write_table(rc.readable_recommendations(_batch_recs(spark, d), tb.articles(spark, d)), path)
    return spark.read.parquet(path)


@query("payload_records")
def q_payload_records(spark, d):
    """The JSON text of every user's response, parsed again to one row per recommendation."""
    articles = tb.articles(spark, d)
    p = rc.payload(_batch_recs(spark, d, articles=articles), articles, 10)
    rec = F.explode("p.recommendations").alias("rec")
    return (p.select("cache_key", rc.parse_payload(F.col("json")).alias("p"))
             .select("cache_key", "p.user_id", "p.total_recommendations", rec).select("cache_key", "user_id", "total_recommendations", "rec.*"))


@query("user_features_bucketed")
def q_user_features_bucketed(spark, d):
    """User features from tables in buckets of the customer; only their writing shuffles the fact table."""
    path, tx = _folder(spark), tb.transactions(spark, d).checkpoint()
    buckets = max(8, bucketed.bucket_count(tx.count()))
    bucketed.write_bucketed(tx, f"{path}/transactions", "customer_id", buckets, ["article_id"])
    bucketed.write_bucketed(tb.customers(spark, d), f"{path}/customers", "customer_id", buckets)
    return user.user_features(bucketed.read_bucketed(spark, f"{path}/customers"), bucketed.read_bucketed(spark, f"{path}/transactions"))


@query("dedupe_visits")
def q_dedupe_visits(spark, d):
    """P1 on rows that do repeat: a customer's lines of one day are one visit."""
    return clean.drop_full_duplicates(tb.raw_transactions(spark, d).select("customer_id", "t_dat", "sales_channel_id"))


@query("duplicate_visits")
def q_duplicate_visits(spark, d):
    """A10 on the same rows."""
    visits = tb.raw_transactions(spark, d).select("customer_id", "t_dat", "sales_channel_id")
    return profile.duplicate_report(visits, "visits", ["customer_id", "t_dat"])


def _recent(spark, d):
    tx = tb.transactions(spark, d)
    return item.recent_window(tx, 30, tx.select(F.max("t_dat")).scalar())


@query("user_features_recent")
def q_user_features_recent(spark, d):
    """F2/J1 over the last 30 days: most customers are cold and take the fills."""
    return user.user_features(tb.customers(spark, d), _recent(spark, d))


@query("item_features_recent")
def q_item_features_recent(spark, d):
    """F8/J2 over the last 30 days: articles without a sale take the fills."""
    return item.item_features(tb.articles(spark, d), _recent(spark, d))


@query("article_age_recent")
def q_article_age_recent(spark, d):
    """F7 over the last 30 days: an article without a sale gets the oldest age."""
    return item.article_age(tb.articles(spark, d), _recent(spark, d))
