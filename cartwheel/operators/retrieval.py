"""Embedding retrieval: normalisation, exact and IVF top-K, lookups.

Exact top-K reads a stored index (``index.py``).  Top-K within clusters is a blocked matrix
product run by ``cogroup(...).applyInPandas``:

* items carry a cluster and are split into
  sub-blocks of at most ``item_block`` rows; queries probing a cluster are split
  into sub-blocks of at most ``query_block`` rows.  The (cluster, item block,
  query block) triple is the cogroup key, so a hot cluster or a huge catalogue is
  simply more groups - no group holds more than ``query_block + item_block`` rows;
* each group computes ``Q @ I.T`` in NumPy in row chunks of bounded memory (single
  precision finds what may be among the best, double precision scores it) and emits only its local top-k per query, ties broken by item id;
* a final ``row_number() <= k`` over the few local winners per query (Spark
  plans it as a WindowGroupLimit, so the pre-shuffle side is pruned as well).

No user x item pair ever becomes a row, nothing is collected except the
``nlist`` centroids, and broadcast data is bounded by ``nlist``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions import vectors as V
from cartwheel.session import ensure_checkpoint_dir

DEFAULT_K = 10
IVF_NLIST = 100     # fixed values: studied IVF defaults
MAX_CENTROIDS = 65_536
IVF_NPROBE = 10
ITEM_BLOCK = 20000
QUERY_BLOCK = 16_384   # the items of a cluster are copied once per query block; a block of 64 floats is about 10 MB
CHUNK_CELLS, RESCORED = 1 << 21, 1 << 15   # score-matrix cells whose candidates are held at a time, pairs scored again at a time (8 and 32 MiB)
TILE_QUERIES, TILE_ITEMS = 256, 2048       # a tile of scores is 2 MiB at most

PAIR_SCHEMA = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("item_id", T.StringType()),
                            T.StructField("score", T.DoubleType())])


def as_factors(df: DataFrame, id_col: str = "id", vec_col: str = "features") -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).alias("features"))


def l2_normalize(factors: DataFrame) -> DataFrame:
    """Unit-length vectors; zero vectors unchanged."""
    return factors.withColumn("features", V.l2_normalize(F.col("features")))


def vector_norms(factors: DataFrame, preview: int = 8) -> DataFrame:
    """Norm, dimension and the first ``preview`` components of every vector."""
    return factors.select("id", V.l2_norm(F.col("features")).alias("norm"), F.size("features").alias("dim"),
                          F.slice("features", 1, preview).alias("head"))


def lookup_embedding(ids: DataFrame, id_col: str, factors: DataFrame, dim: int | Column | None = None) -> DataFrame:
    """``(id, features)`` for every id; unknown ids get the zero vector.

    The studied towers map unknown ids to a reserved slot; a zero vector is that
    slot with no learned signal (its scores are 0 for every item).
    """
    if dim is None:
        dim = factors.select(F.max(F.size("features"))).scalar()
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (ids.select(F.col(id_col).cast("string").alias("id")).distinct()
               .join(factors.select("id", "features"), "id", "left")
               .select("id", F.coalesce(F.col("features"), zero).alias("features")))


# ------------------------------------------------------------------ kernel

def ranks(row: np.ndarray) -> np.ndarray:
    """Place of every element within its run of equal rows (``row`` ascends)."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def score_margin(lengths: np.ndarray, longest: float, dim: int) -> np.ndarray:
    """A bound on the error of scores found in single precision, for queries and items of these norms."""
    return (dim + 8) * 1.2e-7 * lengths * longest + 1e-30


def _true_cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the true cells, found eight cells at a time (few are true)."""
    if mask.size % 8:
        at = np.flatnonzero(mask)
    else:
        eights = mask.reshape(-1, 8)
        some = np.flatnonzero(eights.view(np.uint64))
        n, place = np.nonzero(eights[some])
        at = some[n] * 8 + place
    return np.divmod(at, mask.shape[1])


def _raised(about: np.ndarray, here: np.ndarray, need: np.ndarray, margin: np.ndarray, bound: np.ndarray) -> None:
    """Raise the bounds of the rows ``here`` to what is surely reached ``need`` times among these scores."""
    for n in np.unique(need[here]):
        rows = here[need[here] == n]
        if n <= about.shape[1]:
            bound[rows] = np.maximum(bound[rows], np.partition(about[rows], -n, axis=1)[:, -n] - 2 * margin[rows])


def _candidates(queries: np.ndarray, vectors: np.ndarray, low: np.ndarray, need: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(query row, item)`` of all that may be among the best ``need``, by scores in the precision of the given arrays."""
    down = lambda x: np.nextafter(x.astype(vectors.dtype), vectors.dtype.type(-np.inf))  # noqa: E731 - the comparison then loses nothing
    bound, found = low - margin, []
    for first in range(0, len(vectors), TILE_ITEMS):
        about = queries @ vectors[first:first + TILE_ITEMS].T
        _raised(about, np.flatnonzero(np.isneginf(bound)), need, margin, bound)
        r, c = _true_cells(about >= down(bound)[:, None])
        many = np.flatnonzero(np.bincount(r, minlength=len(queries)) > 2 * need + 32)
        if len(many):
            _raised(about, many, need, margin, bound)
            kept = about[r, c] >= down(bound)[r]
            r, c = r[kept], c[kept]
        found.append((r, first + c, about[r, c]))
    r, c, about = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    # the tiles together may tell a higher bound than each of them
    order = np.lexsort((-about, r))
    r, c, about = r[order], c[order], about[order]
    last = np.flatnonzero(ranks(r) + 1 == need[r])
    bound[r[last]] = np.maximum(bound[r[last]], about[last] - 2 * margin[r[last]])
    kept = about >= down(bound)[r]
    return r[kept], c[kept]


def block_best(queries: np.ndarray, vectors: np.ndarray, low: np.ndarray, need: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, item, score)`` of the items that score at least ``low``; of one query the best ``need`` at most, of equal ones the first.

    ``margin`` bounds the error of a query's scores in single precision.  Scores are made in tiles that
    stay in the processor's cache; of a tile only what reaches its query's bound is looked at again.
    """
    kind = np.float32 if len(queries) and len(vectors) and max(np.abs(queries).max(), np.abs(vectors).max()) < 1e15 else np.float64
    about_q, about_v = queries.astype(kind), vectors.astype(kind)
    step, found = max(1, min(TILE_QUERIES, CHUNK_CELLS // max(len(vectors), 1))), []
    for lo in range(0, len(queries), step):
        at = slice(lo, lo + step)
        r, c = _candidates(about_q[at], about_v, low[at], need[at], margin[at])
        r = r + lo
        score = np.concatenate([np.einsum("ij,ij->i", queries[r[n:n + RESCORED]], vectors[c[n:n + RESCORED]]) for n in range(0, len(r), RESCORED)] or [np.zeros(0)])
        good = score >= low[r]
        r, c, score = r[good], c[good], score[good]
        order = np.lexsort((c, -score, r))
        order = order[ranks(r[order]) < need[r[order]]]
        found.append((r[order], c[order], score[order]))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _local_topk(k: int):
    def fn(key, q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        if q.empty or it.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype=object), "item_id": pd.Series([], dtype=object),
                                 "score": pd.Series([], dtype=float)})
        iids = it["iid"].to_numpy().astype(object)
        order = np.argsort(iids, kind="stable")          # id order: ties resolve to the smallest ids
        iids = iids[order]
        imat = np.stack(it["ivec"].to_numpy()[order]).astype(np.float64)
        qids, qvecs = q["qid"].to_numpy().astype(object), q["qvec"].to_numpy()
        qks = q["qk"].to_numpy().astype(np.int64) if "qk" in q.columns else np.full(len(q), k, np.int64)
        longest = float(np.linalg.norm(imat, axis=1).max())
        step = max(1, CHUNK_CELLS // len(imat))
        out_q, out_i, out_s = [], [], []
        for s in range(0, len(qvecs), step):
            qmat = np.stack(qvecs[s:s + step]).astype(np.float64)
            margin = score_margin(np.linalg.norm(qmat, axis=1), longest, imat.shape[1])
            r, c, v = block_best(qmat, imat, np.full(len(qmat), -np.inf), qks[s:s + step], margin)
            out_q.append(qids[s + r])
            out_i.append(iids[c])
            out_s.append(v)
        return pd.DataFrame({"query_id": np.concatenate(out_q), "item_id": np.concatenate(out_i),
                             "score": np.concatenate(out_s)})
    return fn


def _blocks(n: Column, rows: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(rows)), F.lit(1)).cast("int")


def routed_topk(queries: DataFrame, items: DataFrame, k: int = DEFAULT_K,
                item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK,
                exclude: DataFrame | None = None) -> DataFrame:
    """Exact top-k of ``items`` for every query within the clusters it probes.

    queries: ``(id, cluster, features)`` one row per probed cluster;
    items:   ``(id, cluster, features)`` one row per item.
    Returns ``(query_id, item_id, score, rank)``.  The two sides get distinct
    column names so that a table can be searched against itself.  The block counts
    come from a per-cluster table (one row per cluster).
    """
    q0 = queries.select(F.col("id").alias("qid"), F.col("cluster").alias("qcl"), F.col("features").alias("qvec"))
    if exclude is not None:
        # exact exclusion without a cap: a query that must skip s items asks for k + s
        seen = exclude.groupBy(F.col("query_id").alias("qid")).agg(F.count("*").alias("_s"))
        q0 = (q0.join(seen, "qid", "left")
                .withColumn("qk", (F.lit(k) + F.coalesce(F.col("_s"), F.lit(0))).cast("long")).drop("_s"))
    else:
        q0 = q0.withColumn("qk", F.lit(k).cast("long"))
    i0 = items.select(F.col("id").alias("iid"), F.col("cluster").alias("icl"), F.col("features").alias("ivec"))
    try:
        par = queries.sparkSession.sparkContext.defaultParallelism
    except Exception:  # sessions without a local SparkContext handle
        par = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def block_counts(ni: Column, nq: Column):
        ib = _blocks(ni, item_block)
        # enough query blocks to occupy the cores on small inputs; capped so the item side
        # (copied once per query block) is never replicated more than 256 / ib times
        qb = F.greatest(_blocks(nq, query_block), F.least(F.ceil(F.lit(min(par, 256)) / ib), _blocks(nq, 256)).cast("int"))
        return ib, qb

    isz = i0.groupBy("icl").agg(F.count("*").alias("ni"))
    qsz = q0.groupBy("qcl").agg(F.count("*").alias("nq"))
    ib, qb = block_counts(F.col("ni"), F.col("nq"))
    meta = isz.join(qsz, isz.icl == qsz.qcl).select(F.col("icl").alias("cl"), ib.alias("ib"), qb.alias("qb"))
    # one row per cluster: adaptive execution broadcasts it if it is small
    mi = meta.select(F.col("cl").alias("icl"), F.col("ib").alias("i_ib"), F.col("qb").alias("i_qb"))
    mq = meta.select(F.col("cl").alias("qcl"), F.col("ib").alias("q_ib"), F.col("qb").alias("q_qb"))
    it = (i0.join(mi, "icl")
            .select(F.col("icl").alias("cluster"), F.pmod(F.xxhash64("iid"), F.col("i_ib")).cast("int").alias("isub"),
                    F.explode(F.sequence(F.lit(0), F.col("i_qb") - 1)).alias("qsub"), "iid", "ivec"))
    qs = (q0.join(mq, "qcl")
            .select(F.col("qcl").alias("cluster"), F.explode(F.sequence(F.lit(0), F.col("q_ib") - 1)).alias("isub"),
                    F.pmod(F.xxhash64("qid"), F.col("q_qb")).cast("int").alias("qsub"), "qid", "qvec", "qk"))
    keys = ["cluster", "isub", "qsub"]
    # a given number of partitions: coalescing by bytes would put many block products into one task
    parts = max(par, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = qs.repartition(parts, *keys).groupBy(*keys).cogroup(it.repartition(parts, *keys).groupBy(*keys)).applyInPandas(_local_topk(k), PAIR_SCHEMA)
    if exclude is not None:
        local = local.join(exclude.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_flat(queries: DataFrame, items: DataFrame, k: int = DEFAULT_K, item_block: int = ITEM_BLOCK, query_block: int | None = None,
              exclude: DataFrame | None = None) -> DataFrame:
    """Exact (brute-force) inner-product top-k; ``k`` None/0 -> default.

    ``exclude=(query_id, item_id)`` pairs (e.g. already bought items) are never
    returned and do not use up any of the k slots.  Stores the items in the shared
    checkpoint folder when called; tasks read them block by block (``index.topk_indexed``),
    so that no item is copied per query block and no list is shuffled.
    """
    from cartwheel.operators import index as ix
    path = f"{ensure_checkpoint_dir(queries.sparkSession).rstrip('/')}/items-{uuid.uuid4().hex}"
    return ix.topk_indexed(queries, ix.write_item_index(items, path, item_block), k, exclude, query_block or ix.QUERY_ROWS)


# ------------------------------------------------------------------ IVF

def label_centroids(items: DataFrame, label_col: str = "label") -> DataFrame:
    """Centroid per given label: element-wise mean (``posexplode`` + one aggregate)."""
    e = items.select(F.col(label_col).alias("cluster"), F.posexplode("features").alias("pos", "x"))
    g = e.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (g.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v"))
              .select("cluster", F.transform("_v", lambda s: s["x"]).alias("centroid")))


def kmeans_centroids(items: DataFrame, nlist: int = IVF_NLIST, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """IVF training: Spark ML k-means on the item vectors -> ``(cluster, centroid)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = items.select(array_to_vector("features").alias("v"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="v").fit(data)
    spark = items.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>")


def _centroid_matrix(centroids: DataFrame):
    rows = centroids.limit(MAX_CENTROIDS + 1).collect()   # broadcast, so the count is checked
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} clusters: their centroids are not broadcast")
    rows.sort(key=lambda r: r["cluster"])
    ids = np.array([r["cluster"] for r in rows], dtype=np.int64)
    mat = np.array([r["centroid"] for r in rows], dtype=np.float64)
    return ids, mat


def assign_clusters(items: DataFrame, centroids: DataFrame) -> DataFrame:
    """Inner-product assignment (the IP quantizer): cluster = argmax <x, c>, ties -> lowest id."""
    ids, mat = _centroid_matrix(centroids)
    bc = items.sparkSession.sparkContext.broadcast((ids, mat))

    def fn(batches):
        cids, cm = bc.value
        for b in batches:
            if b.empty:
                continue
            x = np.stack(b["features"].to_numpy()).astype(np.float64)
            s = x @ cm.T
            yield pd.DataFrame({"id": b["id"], "cluster": cids[np.argmax(s, axis=1)].astype(np.int32),
                                "features": b["features"]})
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("cluster", T.IntegerType()),
                           items.schema["features"]])
    return items.select("id", "features").mapInPandas(fn, schema)


def probe_clusters(queries: DataFrame, centroids: DataFrame, nprobe: int = IVF_NPROBE) -> DataFrame:
    """The ``nprobe`` best centroids per query by inner product (ties -> lowest id)."""
    ids, mat = _centroid_matrix(centroids)
    bc = queries.sparkSession.sparkContext.broadcast((ids, mat))
    p = min(nprobe, len(ids))

    def fn(batches):
        cids, cm = bc.value
        for b in batches:
            if b.empty:
                continue
            x = np.stack(b["features"].to_numpy()).astype(np.float64)
            s = x @ cm.T
            order = np.lexsort((np.broadcast_to(cids, s.shape), -s), axis=1)[:, :p]
            n = len(b)
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), p),
                                "cluster": cids[order].reshape(-1).astype(np.int32),
                                "features": np.repeat(b["features"].to_numpy(), p)})
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("cluster", T.IntegerType()),
                           queries.schema["features"]])
    return queries.select("id", "features").mapInPandas(fn, schema)


def topk_ivf(queries: DataFrame, items: DataFrame, centroids: DataFrame, k: int = DEFAULT_K,
             nprobe: int = IVF_NPROBE, item_clusters: DataFrame | None = None, **kw) -> DataFrame:
    """IVF search: exact scores inside the ``nprobe`` probed clusters only.

    ``item_clusters`` may supply a fixed assignment ``(id, cluster, features)``;
    otherwise items are assigned to their best centroid by inner product.
    Fewer than k candidates give a shorter list, as the studied index does.
    """
    k = k or DEFAULT_K
    it = item_clusters if item_clusters is not None else assign_clusters(items, centroids)
    return routed_topk(probe_clusters(queries, centroids, nprobe), it, k, **kw)


def ann_recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Per query, share of the exact top-k that the approximate search also returned."""
    e = exact.select("query_id", "item_id")
    a = approx.select("query_id", "item_id", F.lit(1).alias("_hit"))
    j = e.join(a, ["query_id", "item_id"], "left")
    return j.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))


def mean_recall(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("recall").alias("mean_recall"), F.count("*").alias("n_queries"))


def factorized_topk(test_pairs: DataFrame, recs: DataFrame, ks=(1, 5, 10, 50, 100)) -> DataFrame:
    """Share of test (user, item) pairs whose item ranks within the top-k of the catalogue.

    ``recs`` is a top-max(ks) result; a pair absent from it ranks beyond every k.
    """
    r = recs.select(F.col("query_id").alias("user_id"), "item_id", "rank")
    j = test_pairs.join(r, ["user_id", "item_id"], "left")
    return j.agg(*[F.avg(F.when(F.col("rank") <= kk, 1.0).otherwise(0.0)).alias(f"top_{kk}") for kk in ks],
                 F.count("*").alias("n_pairs"))
