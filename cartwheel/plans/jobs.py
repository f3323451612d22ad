"""Composed batch jobs (C1-C7): each reads tables, runs operators, writes tables.

Stages communicate through Parquet tables (never CSV, never the driver).  The
fact table is written range-partitioned by month and date, so a month is a few files;
a reader that bounds ``month`` beside the date prunes partitions.  It is written a second
time in buckets of the customer, as are the customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.operators import clean, evaluate, index, interactions, item, retrieval, sampling, sgd, train, user
from cartwheel.sources import bucketed, generations, io


def clean_tables(spark: SparkSession, raw_tx: DataFrame, raw_articles: DataFrame, raw_customers: DataFrame,
                 out: str) -> None:
    """C1-C3."""
    # the de-duplicated rows feed the median and the fills: write them once
    io.write_table(clean.drop_null_keys(clean.drop_key_duplicates(raw_tx, clean.TX_KEYS), clean.TX_KEYS), f"{out}/transactions_distinct")
    distinct = spark.read.parquet(f"{out}/transactions_distinct")
    tx = clean.fill_transactions(distinct).withColumn("month", F.date_format("t_dat", "yyyy-MM"))
    io.write_table(tx, f"{out}/transactions", partition_by=["month"], sort_within=["t_dat"])
    io.write_table(clean.clean_articles(raw_articles), f"{out}/articles")
    io.write_table(clean.clean_customers(raw_customers), f"{out}/customers")
    # the same rows by customer: every per-customer aggregate and join of C4 reads them without a shuffle
    fact = spark.read.parquet(f"{out}/transactions").drop("month")
    buckets = bucketed.bucket_count(distinct.count())
    bucketed.write_bucketed(fact, f"{out}/transactions_by_customer", "customer_id", buckets, ["article_id"])
    bucketed.write_bucketed(spark.read.parquet(f"{out}/customers"), f"{out}/customers_by_id", "customer_id", buckets)


def feature_tables(spark: SparkSession, base: str, out: str) -> None:
    """C4: user, item and interaction feature tables from the cleaned tables."""
    dated = spark.read.parquet(f"{base}/transactions").withColumn("month", F.col("month").cast("string"))
    tx = bucketed.read_bucketed(spark, f"{base}/transactions_by_customer")
    arts = spark.read.parquet(f"{base}/articles")
    custs = bucketed.read_bucketed(spark, f"{base}/customers_by_id")
    with bucketed.sharing_buckets(spark):
        io.write_table(user.user_features(custs, tx), f"{out}/user_features")
        io.write_table(interactions.interaction_features(tx), f"{out}/interaction_features")
    io.write_table(item.item_features(arts, dated), f"{out}/item_features")


def train_job(spark: SparkSession, features: str, out: str, method: str = "als", **kw) -> None:
    """Split, train, save factors and settings as a new generation of ``out``.

    ``method``: "als", "sgd" (an Adam update per batch, optional dense layers) or "softmax"
    (synchronous updates).  Readers go on with the last generation until all tables of
    this one are written.
    """
    path = generations.begin(out)
    inter = spark.read.parquet(f"{features}/interaction_features")
    split = sampling.train_test_split(inter.select("customer_id", "article_id").distinct(), ["customer_id", "article_id"])
    io.write_table(split, f"{path}/split")
    pairs = (spark.read.parquet(f"{path}/split").where(F.col("split") == "train")
             .select(F.col("customer_id").alias("user_id"), F.col("article_id").alias("item_id")))
    if method == "als":
        weighted = train.confidence_pairs(inter).join(pairs, ["user_id", "item_id"], "left_semi")
        users, items = train.als_factors(weighted, **kw)
    elif method == "sgd":
        model = sgd.stratified_sgd(pairs, **kw)
        users, items = model.users(), model.items()
        io.write_table(spark.createDataFrame(model.history, "epoch int, loss double, updates int"), f"{path}/history")
    else:
        users, items, hist = train.softmax_factors(pairs, **kw)
        io.write_table(hist, f"{path}/history")
    io.write_table(users, f"{path}/user_factors")
    io.write_table(items, f"{path}/item_factors")
    io.save_model_config(spark, {"embedding_dim": kw.get("rank", kw.get("dim", train.EMBEDDING_DIM))}, f"{path}/config")
    generations.publish(spark, out, path)


def recommend_job(spark: SparkSession, model: str, base: str, out: str, k: int = 10, ivf: bool = False,
                  nlist: int = retrieval.IVF_NLIST, nprobe: int = retrieval.IVF_NPROBE) -> None:
    """Top-k of the current model generation for every user (exact or IVF), readable table, served lookup table."""
    from cartwheel.operators import recommend
    path = generations.current(spark, model)
    users = spark.read.parquet(f"{path}/user_factors")
    items = spark.read.parquet(f"{path}/item_factors")
    if ivf:
        cents = retrieval.kmeans_centroids(items, nlist)
        index.write_inverted_file(items, cents, f"{out}/item_lists")
        res = index.topk_inverted(users, f"{out}/item_lists", cents, k, nprobe)
    else:
        res = index.topk_indexed(users, index.write_item_index(items, f"{out}/item_index"), k)
    recs = res.select(F.col("query_id").alias("user_id"), "item_id", "score", "rank")
    io.write_table(recs, f"{out}/recommendations")
    recs = spark.read.parquet(f"{out}/recommendations")
    arts = io.check_metadata(spark.read.parquet(f"{base}/articles"))
    io.write_table(recommend.readable_recommendations(recs, arts), f"{out}/readable")
    io.write_table(recommend.payload(recs, arts, k).withColumn("computed_at", F.current_timestamp()), f"{out}/served")


def evaluate_job(spark: SparkSession, recs_path: str, features: str, k: int = 10,
                 max_users: int | None = None) -> DataFrame:
    """Eligible (optionally sampled) users, relevant sets, metric means."""
    inter = spark.read.parquet(f"{features}/interaction_features")
    users = sampling.sample_eval_users(inter, max_users)
    rel = evaluate.relevant_items(inter, users)
    recs = spark.read.parquet(recs_path)
    return evaluate.evaluate(recs, rel, k, users)
