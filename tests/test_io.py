import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cartwheel.operators import recommend as rc
from cartwheel.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="cw-test-", dir="/tmp")


def test_raw_csv_readers_keep_text_ids(spark):
    d = _tmp()
    with open(f"{d}/tx.csv", "w") as f:
        f.write("t_dat,customer_id,article_id,price,sales_channel_id\n2020-09-01,00c1,0108775015,0.05,2\n")
    tx = io.read_raw_transactions(spark, f"{d}/tx.csv").collect()[0]
    assert tx.article_id == "0108775015" and tx.customer_id == "00c1" and str(tx.t_dat) == "2020-09-01"
    with open(f"{d}/a.csv", "w") as f:
        f.write("article_id,product_type_no,prod_name\n0108775015,253,Strap top\n")
    a = io.read_raw_articles(spark, f"{d}/a.csv").collect()[0]
    assert a.article_id == "0108775015" and a.product_type_no == 253.0


def test_write_roundtrip_and_resolution(spark):
    d = _tmp()
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    io.write_table(df, f"{d}/second", fmt="csv")
    assert io.resolve_first_existing(spark, d, ["first", "second"]) == f"{d}/second"
    with pytest.raises(FileNotFoundError):
        io.resolve_first_existing(spark, d, ["nope"])
    io.write_table(df, f"{d}/pq")
    assert spark.read.parquet(f"{d}/pq").collect()[0].v == 1


def test_id_resolution_and_metadata_check(spark):
    recs = spark.createDataFrame([(1, 7)], "user_id int, item_id int")
    assert io.resolve_id_columns(recs) == ("user_id", "item_id")
    tx = spark.createDataFrame([("c", "a")], "customer_id string, article_id string")
    assert io.resolve_id_columns(tx) == ("customer_id", "article_id")
    with pytest.raises(ValueError):
        io.resolve_id_columns(spark.createDataFrame([(1,)], "x int"))
    assert io.canonical_ids(recs, "user_id", "item_id").dtypes == [("user_id", "string"), ("item_id", "string")]
    assert io.normalize_item_key(recs).columns == ["user_id", "article_id"]
    with pytest.raises(ValueError):
        io.check_metadata(tx)


def test_model_config_defaults(spark):
    d = _tmp()
    assert io.load_model_config(spark, f"{d}/missing") == io.DEFAULT_MODEL_CONFIG
    io.save_model_config(spark, {"embedding_dim": 16}, f"{d}/cfg")
    cfg = io.load_model_config(spark, f"{d}/cfg")
    assert cfg["embedding_dim"] == 16 and cfg["top_k"] == 10


def test_payload_keys_and_unknown_items(spark):
    recs = spark.createDataFrame([("u", "a", 0.1234567, 1), ("u", "zz", 0.1, 2)],
                                 "user_id string, item_id string, score double, rank int")
    arts = spark.createDataFrame([("a", "Top", "Red", "Jersey", "Upper", "d")],
                                 "article_id string, product_type_name string, colour_group_name string, "
                                 "garment_group_name string, product_group_name string, detail_desc string")
    p = rc.payload(recs, arts, 50).collect()[0]
    assert p.cache_key == "recommendations:u:top50" and p.total_recommendations == 2
    body = json.loads(p.json)
    assert body["recommendations"][0]["score"] == 0.123457 and body["recommendations"][1]["product_type"] is None
    back = rc.payload(recs, arts, 50).select(rc.parse_payload(F.col("json")).alias("p")).collect()[0].p
    assert back.recommendations[1].product_id == "zz"
    readable = {r.product_id: r for r in rc.readable_recommendations(recs, arts).collect()}
    assert readable["zz"].product_type_name == "Unknown" and readable["zz"].score == 0.1


def test_request_guard_and_cache(spark):
    req = spark.createDataFrame([("u", 0), ("u", 500), ("u", None), ("x", 5)], "user_id string, top_k int")
    known = spark.createDataFrame([("u",)], "customer_id string")
    g = sorted((r.user_id, r.top_k, r.status) for r in rc.request_guard(req, known).collect())
    assert g == [("u", 1, "served"), ("u", 10, "served"), ("u", 100, "served"), ("x", 5, "rejected")]
    import datetime as dt
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    reqs = spark.createDataFrame([(1, "u", 10, t(10, 30)), (2, "u", 10, t(12, 0)), (3, "v", 10, t(9, 0)), (4, "u", 50, t(10, 30))],
                                 "request_id long, user_id string, top_k int, ts timestamp_ntz")
    comp = spark.createDataFrame([("u", 10, t(9, 45)), ("u", 10, t(10, 31))], "user_id string, top_k int, computed_at timestamp_ntz")
    out = {r.request_id: r.source for r in rc.cache_lookup(reqs, comp).collect()}
    assert out == {1: "cache", 2: "compute", 3: "compute", 4: "compute"}  # a list of 10 does not answer for 50


def test_lenient_dates(spark):
    d = _tmp()
    with open(f"{d}/tx.csv", "w") as f:
        f.write("t_dat,customer_id,article_id,price,sales_channel_id\n2020-09-01,c,a,1.0,1\nnot-a-date,c,b,1.0,1\n")
    rows = io.read_raw_transactions(spark, f"{d}/tx.csv", lenient_dates=True).orderBy("article_id").collect()
    assert str(rows[0].t_dat) == "2020-09-01" and rows[1].t_dat is None


def test_partitioned_table_is_few_files_and_prunes(spark):
    import glob

    from cartwheel.operators import item
    d = _tmp()
    tx = spark.range(4000).select(F.expr("date_add(date'2020-01-01', cast(id % 240 as int))").alias("t_dat"), F.lit("c").alias("customer_id"),
                                  (F.col("id") % 7).cast("string").alias("article_id")).withColumn("month", F.date_format("t_dat", "yyyy-MM")).repartition(16)
    io.write_table(tx, f"{d}/tx", partition_by=["month"], sort_within=["t_dat"])
    assert len(glob.glob(f"{d}/tx/*/*.parquet")) <= 8 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = spark.read.parquet(f"{d}/tx").withColumn("month", F.col("month").cast("string"))
    recent = item.recent_popularity(back, 30)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert any("month" in part.split("]", 1)[0] for part in plan.split("PartitionFilters: [")[1:])
    assert {tuple(r) for r in recent.collect()} == {tuple(r) for r in item.recent_popularity(tx.drop("month"), 30).collect()}


def test_submitted_settings_win():
    import os
    import subprocess
    import sys
    code = ("from cartwheel.session import get_spark; s = get_spark('local[1]'); "
            "print('GOT', s.conf.get('spark.sql.session.timeZone'), s.conf.get('spark.sql.adaptive.enabled'), s.conf.get('spark.driver.memory'))")
    args = "--conf spark.sql.session.timeZone=America/New_York --conf spark.sql.adaptive.enabled=false --driver-memory 1g pyspark-shell"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYSPARK_SUBMIT_ARGS": args, "PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert "GOT America/New_York false 1g" in out.stdout
