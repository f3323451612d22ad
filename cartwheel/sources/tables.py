"""Canonical star-schema views built from the driver's TPC-H-like tables.

The studied pipeline reads three raw tables (transactions, articles, customers).
Here they are *derived* from the driver tables so that every query grows with them:

* transactions = orders JOIN lineitem (one row per line; a customer buying a part)
* customers    = customer
* articles     = part
* factors      = embeddings (``vec_id`` as the entity id, 64 floats)

The ``raw_*`` variants carry deterministic defects (NULLs, padding, out-of-range
ages, mixed case) so the cleaning operators have work to do; the defects are
functions of the row's own keys, never filters.  The SQL oracle defines the same
views (``cartwheel.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned transactions: ids as text (some padded), NULL prices/channels/keys."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    od = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    cust = F.col("o_custkey").cast("string")
    channel = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(2)
    return j.select(
        _null_when(F.col("o_orderkey") % 401 == 400,
                   F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit(" "), cust, F.lit("\t"))).otherwise(cust)
                   ).alias("customer_id"),
        F.col("l_partkey").cast("string").alias("article_id"),
        F.col("o_orderdate").cast("date").alias("t_dat"),
        _null_when((F.col("l_orderkey") + F.col("l_linenumber")) % 50 == 0, F.col("l_extendedprice")).alias("price"),
        _null_when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 61 == 0, channel).cast("int").alias("sales_channel_id"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean canonical fact table (what the cleaning job would have written)."""
    from cartwheel.operators.clean import clean_transactions
    return clean_transactions(raw_transactions(spark, sf_dir))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    news = (F.when(F.col("c_nationkey") % 3 == 0, "NONE")
            .when(F.col("c_nationkey") % 3 == 1, "Regularly").otherwise("Monthly"))
    return c.select(
        _null_when(k % 250 == 249, k.cast("string")).alias("customer_id"),
        _null_when(k % 4 == 0, (k % 2).cast("double")).alias("FN"),
        _null_when(k % 5 == 0, F.lit(1.0)).alias("Active"),
        _null_when(k % 6 == 0, F.col("c_mktsegment")).alias("club_member_status"),
        _null_when(k % 7 == 0, news).alias("fashion_news_frequency"),
        _null_when(k % 9 == 0, ((k * 37) % 131).cast("double")).alias("age"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartwheel.operators.clean import clean_customers
    return clean_customers(raw_customers(spark, sf_dir))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    words = F.split(F.col("p_name"), " ")
    return p.select(
        k.cast("string").alias("article_id"),
        F.col("p_name").alias("prod_name"),
        _null_when(k % 11 == 0, F.col("p_size").cast("double")).alias("product_type_no"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower("p_type"), F.lit("\t"))).otherwise(F.col("p_type")).alias("product_type_name"),
        _null_when(k % 13 == 0, F.col("p_brand")).alias("product_group_name"),
        F.element_at(words, 1).alias("colour_group_name"),
        F.element_at(words, 2).alias("garment_group_name"),
        _null_when(k % 17 == 0, F.concat(F.col("p_name"), F.lit(" in "), F.col("p_type"))).alias("detail_desc"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartwheel.operators.clean import clean_articles
    return clean_articles(raw_articles(spark, sf_dir))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding table as ``(id string, features array<float>, label int)``."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("features"), "label")


def purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second interaction source: purchase events with non-midnight timestamps."""
    ev = read(spark, sf_dir, "events")
    return (ev.where(F.col("event_type") == "purchase")
              .select(F.col("user_id").cast("string").alias("customer_id"),
                      F.col("ts"), F.col("value").alias("price")))
