"""Bucketed tables: no exchange of the fact table, hot keys, other sessions."""

import glob
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from cartwheel.operators import interactions, user
from cartwheel.sources import bucketed
from cartwheel.sources import tables as tb

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def _exchanges(df):
    """Hash shuffles of the planned query, scalar subqueries (one row each) aside."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def fact(spark):
    out = tempfile.mkdtemp(prefix="cw-buckets-", dir="/tmp")
    tx, cust = tb.transactions(spark, SF).checkpoint(), tb.customers(spark, SF).checkpoint()
    bucketed.write_bucketed(tx, f"{out}/tx", "customer_id", 8, ["article_id"])
    bucketed.write_bucketed(cust, f"{out}/cust", "customer_id", 8)
    return tx, cust, out


def test_features_of_bucketed_tables_plan_no_shuffle(spark, fact):
    tx, cust, out = fact
    by_customer, customers = bucketed.read_bucketed(spark, f"{out}/tx"), bucketed.read_bucketed(spark, f"{out}/cust")
    assert _rows(by_customer) == _rows(tx)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with bucketed.sharing_buckets(spark):
            got, pairs = user.user_features(customers, by_customer), interactions.add_repeat_purchase_flag(by_customer)
            assert not _exchanges(got) and not _exchanges(pairs)
            assert _exchanges(user.user_features(cust, tx))
            assert _rows(got) == _rows(user.user_features(cust, tx))
            assert _rows(pairs) == _rows(interactions.add_repeat_purchase_flag(tx))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_another_session_declares_the_table_again(spark, fact):
    tx, _, out = fact
    other = spark.newSession()
    spark.sql(f"DROP TABLE {bucketed._name(f'{out}/tx')}")   # an in-memory catalog of another application lacks it
    again = bucketed.read_bucketed(other, f"{out}/tx").groupBy("customer_id").count()
    assert not _exchanges(again)
    assert _rows(again) == _rows(tx.groupBy("customer_id").count())


def test_hot_key_is_written_and_read_by_many_tasks(spark):
    out = tempfile.mkdtemp(prefix="cw-buckets-", dir="/tmp")
    rows = spark.range(0, 9000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 500 != 1, F.col("id").cast("string")).alias("customer_id"),
                                             F.lit(1).alias("v"))
    bucketed.write_bucketed(rows, f"{out}/t", "customer_id", 16)
    table = bucketed.read_bucketed(spark, f"{out}/t", rows_per_bucket=1000)
    assert _exchanges(table.groupBy("customer_id").count())                    # declared without buckets
    held = spark.read.parquet(f"{out}/t").where("customer_id = 'hot'").groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(held) > 1 and sum(r["count"] for r in held) == 3000 and max(r["count"] for r in held) < 2000
    assert _rows(table) == _rows(rows)
    assert _rows(bucketed.read_bucketed(spark, f"{out}/t").groupBy("customer_id").count()) == _rows(rows.groupBy("customer_id").count())


def test_empty_table_and_overwrite(spark):
    out = tempfile.mkdtemp(prefix="cw-buckets-", dir="/tmp")
    one = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    bucketed.write_bucketed(one.limit(0), f"{out}/t", "k", 4)
    empty = bucketed.read_bucketed(spark, f"{out}/t")
    assert empty.columns == ["k", "v"] and empty.count() == 0
    bucketed.write_bucketed(one, f"{out}/t", "k", 2)
    assert _rows(bucketed.read_bucketed(spark, f"{out}/t")) == _rows(one)
    assert glob.glob(f"{out}/t_layout/*.json") and bucketed.bucket_count(0) == 1 and bucketed.bucket_count(5_000_000) == 3
