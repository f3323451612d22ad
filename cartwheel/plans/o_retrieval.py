"""Oracle SQL for vectors, retrieval, recommendation tables and evaluation."""

from cartwheel.plans.oracle import oracle, r6

F_ = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
ZERO = "(SELECT list_transform(range(max(len(embedding))), lambda x: CAST(0.0 AS DOUBLE)) FROM embeddings)"
USERS = f"""
  SELECT c.customer_id AS id, coalesce(f.v, {ZERO}) AS v
  FROM (SELECT DISTINCT customer_id FROM customers) c LEFT JOIN f ON c.customer_id = f.id"""
ITEMS = f"""
  SELECT a.article_id AS id, coalesce(f.v, {ZERO}) AS v
  FROM (SELECT DISTINCT article_id FROM articles) a LEFT JOIN f ON a.article_id = f.id"""
BASE = {"f": F_, "users": USERS, "items": ITEMS}


def topk(q: str, i: str, k: int) -> str:
    return f"""
  SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT q.id AS user_id, i.id AS item_id, list_inner_product(q.v, i.v) AS score,
           row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.v, i.v) DESC, i.id) AS rank
    FROM ({q}) q CROSS JOIN ({i}) i) s
  WHERE rank <= {k}"""


def recs_out(src: str) -> str:
    return f"SELECT user_id, item_id, {r6('score')} AS score, rank FROM ({src}) r"


def vec6(expr: str) -> str:
    return f"list_transform({expr}, lambda x: {r6('x')})"


oracle("l2_normalize", f"""
SELECT id, list_transform(v, lambda x: {r6("CAST(CAST(x / (CASE WHEN n = 0 THEN 1.0 ELSE n END) AS FLOAT) AS DOUBLE)")}) AS features
FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM f) q""", **BASE)
oracle("vector_norms", f"""
SELECT id, {r6("sqrt(list_sum(list_transform(v, lambda x: x * x)))")} AS norm, CAST(len(v) AS INTEGER) AS dim,
       {vec6("v[1:8]")} AS head FROM f""", **BASE)
oracle("lookup_embedding", f"SELECT id AS customer_id, {vec6('v')} AS features FROM users", **BASE)
oracle("topk_flat", recs_out(topk("SELECT id, v FROM f", "SELECT id, v FROM f", 10)), **BASE)
oracle("topk_indexed", recs_out(topk("SELECT id, v FROM f", "SELECT id, v FROM f", 10)), **BASE)
oracle("user_similarity", recs_out(topk("SELECT id, v FROM fn", "SELECT id, v FROM fn", 10)), **BASE, fn="""
  SELECT id, list_transform(v, lambda x: CAST(CAST(x / (CASE WHEN n = 0 THEN 1.0 ELSE n END) AS FLOAT) AS DOUBLE)) AS v
  FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM f) q""")

IVF = {
    "cent": """
  SELECT label AS cluster, list(x ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(x) AS x FROM (
      SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM f) e
    GROUP BY label, pos) g
  GROUP BY label""",
    "probe": """
  SELECT id, v, cluster FROM (
    SELECT f.id, f.v, c.cluster,
           row_number() OVER (PARTITION BY f.id ORDER BY list_inner_product(f.v, c.c) DESC, c.cluster) AS pr
    FROM f CROSS JOIN cent c) q
  WHERE pr <= 3""",
    "ivf": """
  SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT p.id AS user_id, i.id AS item_id, list_inner_product(p.v, i.v) AS score,
           row_number() OVER (PARTITION BY p.id ORDER BY list_inner_product(p.v, i.v) DESC, i.id) AS rank
    FROM probe p JOIN f i ON i.label = p.cluster) s
  WHERE rank <= 10""",
}
oracle("topk_ivf", recs_out("SELECT * FROM ivf"), **BASE, **IVF)
oracle("topk_inverted", recs_out("SELECT * FROM ivf"), **BASE, **IVF)
oracle("ann_recall", f"""
SELECT {r6("avg(recall)")} AS mean_recall, count(*) AS n_queries FROM (
  SELECT e.user_id, count(a.item_id) / count(*) AS recall
  FROM exact e LEFT JOIN ivf a ON e.user_id = a.user_id AND e.item_id = a.item_id
  GROUP BY e.user_id) q""", **BASE, **IVF, exact=topk("SELECT id, v FROM f", "SELECT id, v FROM f", 10))

BATCH = topk("SELECT * FROM users", "SELECT * FROM items", 10)
oracle("recommend_user", recs_out(topk("SELECT * FROM users WHERE id = '7'", "SELECT * FROM items", 10)), **BASE)
oracle("recommend_batch", recs_out(BATCH), **BASE)
oracle("candidate_pool", recs_out(topk("SELECT * FROM users", "SELECT * FROM items ORDER BY id LIMIT 1000", 10)), **BASE)
oracle("readable_recs", f"""
SELECT r.user_id, r.rank, r.item_id AS product_id, coalesce(a.product_type_name, 'Unknown') AS product_type_name,
       coalesce(a.colour_group_name, 'Unknown') AS colour_group_name,
       coalesce(a.garment_group_name, 'Unknown') AS garment_group_name,
       coalesce(a.product_group_name, 'Unknown') AS product_group_name,
       coalesce(a.detail_desc, 'Unknown') AS detail_desc, {r6("r.score")} AS score
FROM recs r LEFT JOIN articles a ON r.item_id = a.article_id""", **BASE, recs=BATCH)
oracle("display_recs", f"""
SELECT r.user_id, r.rank, r.item_id AS "Product ID", coalesce(a.product_type_name, 'Unknown') AS "Product Type",
       coalesce(a.colour_group_name, 'Unknown') AS "Color", coalesce(a.garment_group_name, 'Unknown') AS "Garment Group",
       coalesce(a.product_group_name, 'Unknown') AS "Category", {r6("r.score")} AS "Score",
       substr(coalesce(a.detail_desc, 'No description available'), 1, 120) AS "Description"
FROM recs r LEFT JOIN articles a ON r.item_id = a.article_id""", **BASE, recs=BATCH)
oracle("request_guard", """
SELECT event_id, user_id, k AS top_k_requested, greatest(1, least(100, coalesce(k, 10))) AS top_k,
       CASE WHEN user_id IN (SELECT customer_id FROM customers) THEN 'served' ELSE 'rejected' END AS status,
       CASE WHEN user_id IN (SELECT customer_id FROM customers) THEN NULL ELSE 'unknown user' END AS reason
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_id % 7 <> 0 THEN CAST(trunc(value) AS INTEGER) END AS k
      FROM events WHERE event_type IN ('view', 'click')) r""")
oracle("unknown_users", """
SELECT customer_id AS user_id, 10 AS top_k_requested, 10 AS top_k, 'rejected' AS status, 'unknown user' AS reason
FROM (SELECT DISTINCT customer_id FROM transactions) t
WHERE customer_id NOT IN (SELECT customer_id FROM customers)""")
oracle("rec_cache_lookup", """
SELECT r.event_id AS request_id, CAST(r.user_id AS VARCHAR) AS user_id, r.top_k, r.ts,
       CASE WHEN c.cached_at IS NOT NULL AND r.ts < c.cached_at + INTERVAL 3600 SECOND THEN c.cached_at END AS cached_at,
       CASE WHEN c.cached_at IS NOT NULL AND r.ts < c.cached_at + INTERVAL 3600 SECOND THEN 'cache' ELSE 'compute' END AS source
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 20 ELSE 10 END AS top_k FROM events WHERE event_type = 'click') r
LEFT JOIN LATERAL (SELECT max(v.ts) AS cached_at FROM events v
                   WHERE v.event_type = 'view' AND v.user_id = r.user_id AND v.ts <= r.ts
                     AND CASE WHEN v.event_id % 3 = 0 THEN 20 ELSE 10 END = r.top_k) c ON true""")

oracle("rec_cache_sessions", """
SELECT * FROM (WITH RECURSIVE req AS (
  SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_id % 3 = 0 THEN 20 ELSE 10 END AS top_k, ts
  FROM events WHERE event_type IN ('view', 'click')
), computed AS (
  SELECT user_id, top_k, min(ts) AS at FROM req GROUP BY user_id, top_k
  UNION ALL
  SELECT c.user_id, c.top_k, min(r.ts) FROM computed c JOIN req r ON r.user_id = c.user_id AND r.top_k = c.top_k AND r.ts >= c.at + INTERVAL 3600 SECOND
  GROUP BY c.user_id, c.top_k
)
SELECT r.request_id, r.user_id, r.top_k, r.ts, c.at AS computed_at,
       CASE WHEN r.ts = c.at AND r.request_id = min(r.request_id) OVER (PARTITION BY r.user_id, r.top_k, r.ts) THEN 'compute' ELSE 'cache' END AS source
FROM req r ASOF JOIN computed c ON r.user_id = c.user_id AND r.top_k = c.top_k AND r.ts >= c.at)""")

EVAL = dict(BASE)
EVAL.update({
    "eusers": "SELECT customer_id FROM transactions GROUP BY customer_id HAVING count(DISTINCT article_id) >= 2",
    "rel": """
  SELECT DISTINCT customer_id AS user_id, article_id AS item_id FROM transactions
  WHERE customer_id IN (SELECT customer_id FROM eusers)""",
    "recs": topk("SELECT * FROM users WHERE id IN (SELECT customer_id FROM eusers)", "SELECT * FROM items", 10),
    "pu": """
  SELECT n.user_id, n.n_relevant, coalesce(h.n_hits, 0) AS n_hits,
         CASE WHEN h2.n_recs IS NULL THEN 0.0 ELSE coalesce(h.n_hits, 0) / 10.0 END AS precision,
         CASE WHEN h2.n_recs IS NULL THEN 0.0 ELSE coalesce(h.n_hits, 0) / n.n_relevant END AS recall,
         CASE WHEN h2.n_recs IS NULL THEN 0.0 ELSE coalesce(h.dcg, 0.0) /
              list_sum(list_transform(range(1, least(n.n_relevant, 10) + 1), lambda r: 1.0 / log2(r + 1))) END AS ndcg
  FROM (SELECT user_id, count(*) AS n_relevant FROM rel GROUP BY user_id) n
  LEFT JOIN (SELECT user_id, count(*) AS n_recs FROM recs GROUP BY user_id) h2 ON n.user_id = h2.user_id
  LEFT JOIN (SELECT r.user_id, count(*) AS n_hits, sum(1.0 / log2(r.rank + 1)) AS dcg
             FROM recs r JOIN rel ON r.user_id = rel.user_id AND r.item_id = rel.item_id GROUP BY r.user_id) h
    ON n.user_id = h.user_id""",
})
oracle("relevant_items", "SELECT user_id, item_id FROM rel", **EVAL)
oracle("hits_at_k", "SELECT user_id, n_relevant, n_hits FROM pu", **EVAL)
oracle("precision_at_k", f"SELECT user_id, {r6('precision')} AS precision FROM pu", **EVAL)
oracle("recall_at_k", f"SELECT user_id, {r6('recall')} AS recall FROM pu", **EVAL)
oracle("ndcg_at_k", f"SELECT user_id, {r6('ndcg')} AS ndcg FROM pu", **EVAL)
oracle("evaluate", f"""
SELECT {r6("coalesce(avg(precision), 0.0)")} AS precision, {r6("coalesce(avg(recall), 0.0)")} AS recall,
       {r6("coalesce(avg(ndcg), 0.0)")} AS ndcg, count(*) AS users_evaluated FROM pu""", **EVAL)

FT = dict(BASE)
FT.update({
    "test": """
  SELECT customer_id AS user_id, article_id AS item_id FROM (SELECT DISTINCT customer_id, article_id FROM transactions) p
  WHERE substr(md5('42:' || customer_id || ':' || article_id), 1, 8) >= 'cccccccc'""",
    "top": topk("SELECT * FROM users WHERE id IN (SELECT user_id FROM test)", "SELECT * FROM items", 100),
})
oracle("factorized_topk", f"""
SELECT {", ".join(r6(f"avg(CASE WHEN r.rank <= {k} THEN 1.0 ELSE 0.0 END)") + f" AS top_{k}" for k in (1, 5, 10, 50, 100))},
       count(*) AS n_pairs
FROM test t LEFT JOIN top r ON t.user_id = r.user_id AND t.item_id = r.item_id""", **FT)

oracle("inbatch_softmax_loss", f"""
SELECT batch_id, count(*) AS n_pairs, {r6("sum(m + ln(se) - diag)")} AS loss FROM (
  SELECT a.batch_id, a.user_id, a.item_id, max(a.m) AS m, sum(exp(a.s - a.m)) AS se, max(a.diag) AS diag FROM (
    SELECT p.batch_id, p.user_id, p.item_id, list_inner_product(p.uv, q.iv) AS s,
           max(list_inner_product(p.uv, q.iv)) OVER (PARTITION BY p.batch_id, p.user_id, p.item_id) AS m,
           max(CASE WHEN q.user_id = p.user_id AND q.item_id = p.item_id THEN list_inner_product(p.uv, q.iv) END)
             OVER (PARTITION BY p.batch_id, p.user_id, p.item_id) AS diag
    FROM pb p JOIN pb q ON p.batch_id = q.batch_id) a
  GROUP BY a.batch_id, a.user_id, a.item_id) r
GROUP BY batch_id""", **BASE, tp="""
  SELECT customer_id AS user_id, article_id AS item_id FROM (SELECT DISTINCT customer_id, article_id FROM transactions) p
  WHERE substr(md5('42:' || customer_id || ':' || article_id), 1, 8) < 'cccccccc'""", pb="""
  SELECT t.user_id, t.item_id, u.v AS uv, i.v AS iv,
         CAST(('0x' || substr(md5('42:' || t.user_id || ':' || t.item_id), 1, 15)) AS BIGINT)
           % CAST(greatest(ceil((SELECT count(*) FROM tp) / 128.0), 1) AS BIGINT) AS batch_id
  FROM tp t JOIN users u ON t.user_id = u.id JOIN items i ON t.item_id = i.id""")

oracle("rec_cache_keys", """
SELECT user_id, 'recommendations:' || user_id || ':top10' AS cache_key,
       CAST(count(*) AS INTEGER) AS total_recommendations
FROM recs GROUP BY user_id""", **BASE, recs=BATCH)

HO = dict(BASE)
HO.update({
    "eusers": "SELECT customer_id FROM transactions GROUP BY customer_id HAVING count(DISTINCT article_id) >= 2",
    "pairs": """
  SELECT customer_id AS user_id, article_id AS item_id,
         substr(md5('42:' || customer_id || ':' || article_id), 1, 8) < 'cccccccc' AS is_train
  FROM (SELECT DISTINCT customer_id, article_id FROM transactions) p""",
    "rel": "SELECT user_id, item_id FROM pairs WHERE NOT is_train AND user_id IN (SELECT customer_id FROM eusers)",
    "recs": """
  SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM (
    SELECT q.id AS user_id, i.id AS item_id,
           row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.v, i.v) DESC, i.id) AS rank
    FROM (SELECT * FROM users WHERE id IN (SELECT customer_id FROM eusers)) q CROSS JOIN items i
    WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.is_train AND p.user_id = q.id AND p.item_id = i.id)) s
  WHERE rank <= 10""",
})
HO["pu"] = EVAL["pu"]
oracle("evaluate_heldout", f"""
SELECT {r6("coalesce(avg(precision), 0.0)")} AS precision, {r6("coalesce(avg(recall), 0.0)")} AS recall,
       {r6("coalesce(avg(ndcg), 0.0)")} AS ndcg, count(*) AS users_evaluated FROM pu""", **HO)
