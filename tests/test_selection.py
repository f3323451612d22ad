"""Radix selection equals sorting."""

import hashlib

from pyspark.sql import functions as F

from cartwheel.operators import sampling as sp
from cartwheel.operators import selection


def test_key_at_equals_sorting(spark, monkeypatch):
    keys = sorted([hashlib.md5(str(k).encode()).hexdigest() for k in range(500)] + ["aa" * 16] * 40 + ["ab" * 16] * 3)
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "h string")
    for few in (4096, 2):
        monkeypatch.setattr(selection, "FEW_ROWS", few)
        for rank in (0, 1, 250, keys.index("aa" * 16), keys.index("aa" * 16) + 39, len(keys) - 1):
            assert selection.key_at(df, "h", rank) == (keys[rank], keys.index(keys[rank]))
        assert selection.key_at(df, "h", len(keys)) == (None, len(keys))
        assert selection.key_at(df, "h", lambda n: n // 2) == (keys[len(keys) // 2], keys.index(keys[len(keys) // 2]))
    assert selection.key_at(df.limit(0), "h", 0) == (None, 0)


def test_first_rows_take_part_of_equal_keys(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 50, "0" * 32).otherwise(F.md5(F.col("id").cast("string"))).alias("h"))
    for n in (0, 1, 30, 50, 70, 100, 200):
        got = [r["h"] for r in selection.first_rows(df, "h", n).collect()]
        assert sorted(got) == sorted(r["h"] for r in df.collect())[:n]


def test_samples_and_splits_have_their_size(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    assert sp.sample_n(df, 123, ["k"]).count() == 123
    assert sp.sample_n(df.unionAll(df), 1999, ["k"]).count() == 1999
    split = sp.train_test_split_exact(df, ["k"], 0.8).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 800, "test": 200}
    plan = sp.sample_n(df, 123, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
