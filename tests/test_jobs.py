"""Composed jobs C1-C7 end to end on the smallest driver tables."""

import tempfile

from pyspark.sql import functions as F

from cartwheel.plans import jobs
from cartwheel.sources import tables as tb

SF = "/root/testdata/sf0.001"


def test_pipeline_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="cw-jobs-", dir="/tmp")
    jobs.clean_tables(spark, tb.raw_transactions(spark, SF), tb.raw_articles(spark, SF), tb.raw_customers(spark, SF),
                      f"{out}/clean")
    cleaned = spark.read.parquet(f"{out}/clean/transactions").drop("month")
    # the bounded-median job output equals the lazily planned cleaning of the driver query
    assert sorted(cleaned.collect()) == sorted(tb.transactions(spark, SF).collect())
    jobs.feature_tables(spark, f"{out}/clean", f"{out}/feat")
    jobs.train_job(spark, f"{out}/feat", f"{out}/model", "als", rank=8, max_iter=3)
    jobs.recommend_job(spark, f"{out}/model", f"{out}/clean", f"{out}/recs", k=5, ivf=True, nlist=4, nprobe=2)
    recs = spark.read.parquet(f"{out}/recs/recommendations")
    assert recs.agg(F.max("rank")).first()[0] <= 5
    m = jobs.evaluate_job(spark, f"{out}/recs/recommendations", f"{out}/feat", k=5).collect()[0]
    assert m.users_evaluated > 0 and 0.0 <= m.ndcg <= 1.0
    served = spark.read.parquet(f"{out}/recs/served").first()
    assert served.cache_key.startswith("recommendations:") and served.json.startswith("{")
