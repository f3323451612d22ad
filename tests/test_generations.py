"""Generations of a model: a job that dies leaves the last one, readers see whole ones."""

import pytest
from pyspark.sql import functions as F

from cartwheel.operators import sgd
from cartwheel.plans import jobs
from cartwheel.sources import generations


def write(spark, root, value):
    path = generations.begin(root)
    spark.createDataFrame([(value,)], "v int").write.parquet(f"{path}/t")
    return path


def test_generations_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "model")
    assert generations.current(spark, root) == root
    read = lambda: spark.read.parquet(f"{generations.current(spark, root)}/t").first()["v"]
    paths = []
    for value in range(4):
        paths.append(write(spark, root, value))
        if value:
            assert read() == value - 1   # written, not yet published
        assert generations.publish(spark, root, paths[-1]) == value + 1
        assert read() == value
    assert [n for n, _ in generations.manifests(spark, root)] == [3, 4]
    # the one before the current is kept for its readers, older ones are gone
    assert spark.read.parquet(f"{paths[2]}/t").count() == 1
    assert not (tmp_path / "model" / paths[0].rsplit("/", 1)[1]).exists()


def test_a_killed_training_leaves_the_last_model(spark, tmp_path, monkeypatch):
    rows = [(f"u{k % 12}", f"i{(k * 7) % 9}", 1.0) for k in range(100)]
    features = str(tmp_path / "features")
    spark.createDataFrame(rows, "customer_id string, article_id string, recency_weight double").write.parquet(f"{features}/interaction_features")
    model = str(tmp_path / "model")
    jobs.train_job(spark, features, model, "sgd", dim=4, epochs=1, blocks=2)
    before = generations.current(spark, model)
    factors = sorted(map(tuple, spark.read.parquet(f"{before}/user_factors").select("id").collect()))
    assert len(factors) == 12 and spark.read.parquet(f"{before}/history").count() == 1

    def dies(self):
        raise RuntimeError("lost")

    monkeypatch.setattr(sgd.TwoTower, "items", dies)
    with pytest.raises(RuntimeError):
        jobs.train_job(spark, features, model, "sgd", dim=4, epochs=1, blocks=2)
    assert generations.current(spark, model) == before
    arts = spark.createDataFrame([(f"i{k}", "t", "c", "g", "p", "d") for k in range(9)],
                                 "article_id string, product_type_name string, colour_group_name string, garment_group_name string, product_group_name string, detail_desc string")
    arts.write.parquet(str(tmp_path / "base" / "articles"))
    jobs.recommend_job(spark, model, str(tmp_path / "base"), str(tmp_path / "recs"), k=3)
    recs = spark.read.parquet(str(tmp_path / "recs" / "recommendations"))
    assert recs.count() == 36 and recs.agg(F.max("rank")).first()[0] == 3
