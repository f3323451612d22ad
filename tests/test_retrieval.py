import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cartwheel.operators import retrieval as rt
from cartwheel.operators import sampling as sp

FAC = "id string, features array<float>"


def brute(qs, its, k):
    out = {}
    for qi, qv in qs:
        sc = sorted(((-float(np.dot(np.asarray(qv, np.float64), np.asarray(iv, np.float64))), ii) for ii, iv in its))
        out[qi] = [ii for _, ii in sc[:k]]
    return out


def test_topk_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    its = [(f"i{j:03d}", [float(x) for x in rng.integers(-2, 3, 4)]) for j in range(60)]
    qs = [(f"q{j}", [float(x) for x in rng.integers(-2, 3, 4)]) for j in range(25)]
    res = rt.topk_flat(spark.createDataFrame(qs, FAC), spark.createDataFrame(its, FAC), 7, item_block=16, query_block=4)
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == brute(qs, its, 7)
    ranks = res.groupBy("query_id").agg(F.collect_set("rank").alias("r")).collect()
    assert all(sorted(x.r) == list(range(1, 8)) for x in ranks)


def test_k_larger_than_catalogue_and_default(spark):
    its = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], FAC)
    qs = spark.createDataFrame([("q", [1.0, 1.0])], FAC)
    assert [r.item_id for r in rt.topk_flat(qs, its, 5).orderBy("rank").collect()] == ["a", "b"]
    assert rt.topk_flat(qs, its, 0).count() == 2         # k = 0 -> default 10, catalogue has 2


def test_zero_vector_normalisation(spark):
    df = spark.createDataFrame([("z", [0.0, 0.0]), ("v", [3.0, 4.0])], FAC)
    out = {r.id: r.features for r in rt.l2_normalize(df).collect()}
    assert out["z"] == [0.0, 0.0] and np.allclose(out["v"], [0.6, 0.8])


def test_ivf_with_all_probes_equals_flat(spark):
    rng = np.random.default_rng(2)
    its = [(f"i{j}", [float(x) for x in rng.normal(size=8)], int(j % 5)) for j in range(80)]
    df = spark.createDataFrame(its, "id string, features array<float>, label int")
    f = df.select("id", "features")
    cents = rt.label_centroids(df)
    ivf = rt.topk_ivf(f, f, cents, 5, nprobe=5)
    flat = rt.topk_flat(f, f, 5)
    key = lambda d_: sorted((r.query_id, r.item_id, r.rank) for r in d_.collect())
    assert key(ivf) == key(flat)
    few = rt.topk_ivf(f, f, cents, 5, nprobe=1)
    assert rt.mean_recall(rt.ann_recall(flat, few)).collect()[0].mean_recall <= 1.0


def test_index_ids_dense_and_ordered(spark):
    ids = spark.createDataFrame([(str(x),) for x in [5, 3, 9, 3, 12, 100, 7]], "a string")
    got = [(r.a, r.idx) for r in sp.index_ids(ids, "a", partitions=3).orderBy("idx").collect()]
    assert got == list(zip(sorted({"5", "3", "9", "12", "100", "7"}), range(6)))


def test_negatives_never_positives(spark):
    rows = [(f"u{u}", f"a{(u * 7 + j) % 40}") for u in range(30) for j in range(u % 6 + 1)]
    rows += [("heavy", f"a{j}") for j in range(18)] + [("most", f"a{j}") for j in range(33)]
    tx = spark.createDataFrame(rows, "customer_id string, article_id string")
    neg = sp.negatives(tx, ratio=1, block=3)
    assert neg.join(tx, ["customer_id", "article_id"]).count() == 0
    counts = {r.customer_id: r.n for r in neg.groupBy("customer_id").agg(F.count("*").alias("n")).collect()}
    pos = {r.customer_id: r.n for r in tx.distinct().groupBy("customer_id").agg(F.count("*").alias("n")).collect()}
    n_items = tx.select("article_id").distinct().count()
    assert counts == {u: min(n, n_items - n) for u, n in pos.items()}
    assert neg.select("customer_id", "article_id").distinct().count() == neg.count()


def test_draws_of_negatives_are_not_broadcast(spark):
    tx = spark.range(3000).select(F.concat(F.lit("u"), F.col("id") % 5).alias("customer_id"), F.concat(F.lit("a"), F.col("id") % 1501).alias("article_id"))
    neg = sp.negatives(tx)
    neg.collect()
    plan = neg._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [idx" in plan and "BroadcastHashJoin [idx" not in plan


def test_exclusion_is_exact(spark):
    rng = np.random.default_rng(4)
    its = [(f"i{j:03d}", [float(x) for x in rng.integers(-3, 4, 3)]) for j in range(50)]
    qs = [(f"q{j}", [float(x) for x in rng.integers(-3, 4, 3)]) for j in range(12)]
    full = brute(qs, its, 50)
    # each query excludes a different number of its own best items (0 .. 11)
    excl = [(q, full[q][m]) for n, (q, _) in enumerate(qs) for m in range(n)]
    ex = spark.createDataFrame(excl, "query_id string, item_id string")
    res = rt.topk_flat(spark.createDataFrame(qs, FAC), spark.createDataFrame(its, FAC), 5, exclude=ex,
                       item_block=16, query_block=3)
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    want = {q: [i for i in full[q] if (q, i) not in set(excl)][:5] for q, _ in qs}
    assert got == want


def test_block_product_takes_little_memory():
    rng = np.random.default_rng(6)
    q = pd.DataFrame({"qid": [f"q{k}" for k in range(3000)], "qvec": list(rng.normal(size=(3000, 8)).astype(np.float32)), "qk": 10})
    it = pd.DataFrame({"iid": [f"i{k:04d}" for k in range(5000)], "ivec": list(rng.normal(size=(5000, 8)).astype(np.float32))})
    tracemalloc.start()
    got = rt._local_topk(10)((0,), q, it)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and len(got) == 30_000
    scores = np.stack(q["qvec"]).astype(float) @ np.stack(it["ivec"]).astype(float).T
    assert np.allclose(got["score"].to_numpy().reshape(3000, 10), -np.sort(-scores, axis=1)[:, :10])
