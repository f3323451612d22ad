"""Oracle SQL for sampling, splits, vocabularies and negatives."""

from cartwheel.plans.oracle import oracle, r6

oracle("sample_n", """
SELECT customer_id, article_id, t_dat FROM transactions
ORDER BY md5('42:' || customer_id || ':' || article_id || ':' || CAST(t_dat AS VARCHAR)), customer_id, article_id, t_dat
LIMIT 20000""")
oracle("train_test_split", """
SELECT customer_id, article_id,
       CASE WHEN substr(md5('42:' || customer_id || ':' || article_id), 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS split
FROM (SELECT DISTINCT customer_id, article_id FROM transactions) p""")
oracle("train_test_split_exact", """
SELECT customer_id, article_id,
       CASE WHEN row_number() OVER (ORDER BY md5('42:' || customer_id || ':' || article_id)) - 1
                 < floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT DISTINCT customer_id, article_id FROM transactions) p""")
oracle("temporal_split", """
SELECT customer_id, article_id, t_dat, CASE WHEN t_dat < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split
FROM transactions""")
oracle("vocabulary", """
SELECT customer_id, CAST(dense_rank() OVER (ORDER BY customer_id) AS BIGINT) AS idx
FROM (SELECT DISTINCT customer_id FROM transactions WHERE customer_id IS NOT NULL) u""")
oracle("item_vocabulary", """
SELECT article_id, CAST(dense_rank() OVER (ORDER BY article_id) AS BIGINT) AS idx
FROM (SELECT DISTINCT article_id FROM transactions WHERE article_id IS NOT NULL) u""")
oracle("eligible_users", """
SELECT customer_id, count(DISTINCT article_id) AS n_items FROM transactions GROUP BY customer_id
HAVING count(DISTINCT article_id) >= 2""")
SAMPLED = """
  SELECT customer_id FROM transactions GROUP BY customer_id HAVING count(DISTINCT article_id) >= 2
  ORDER BY md5('42:' || customer_id), customer_id LIMIT 500"""
oracle("sample_eval_users", "SELECT customer_id FROM sampled", sampled=SAMPLED)
oracle("semi_sampled_users", """
SELECT customer_id, article_id, t_dat, round(price * 1e6) / 1e6 AS price, sales_channel_id FROM transactions
WHERE customer_id IN (SELECT customer_id FROM transactions GROUP BY customer_id HAVING count(DISTINCT article_id) >= 2)""")
oracle("keep_known", """
SELECT customer_id, article_id, t_dat, round(price * 1e6) / 1e6 AS price, sales_channel_id FROM transactions
WHERE customer_id IN (SELECT customer_id FROM customers) AND article_id IN (SELECT article_id FROM articles)""")

NEG = {
    "items": """
  SELECT article_id, CAST(dense_rank() OVER (ORDER BY article_id) - 1 AS BIGINT) AS idx
  FROM (SELECT DISTINCT article_id FROM transactions) a""",
    "pos": "SELECT DISTINCT customer_id, article_id FROM transactions",
    "prime": """
  SELECT min(p) AS p FROM (SELECT unnest(range(greatest(2, (SELECT count(*) FROM items)), 2 * (SELECT count(*) FROM items) + 3)) AS p) r
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, CAST(sqrt(2 * (SELECT count(*) FROM items) + 3) AS BIGINT) + 1)) AS d) f WHERE d < p AND p % d = 0)""",
    "draws": """
  SELECT customer_id, n_neg, j, (first + j * step) % (SELECT p FROM prime) AS idx
  FROM (SELECT customer_id, n_neg,
               CAST(('0x' || substr(md5('42:' || customer_id || ':start'), 1, 15)) AS BIGINT) % (SELECT p FROM prime) AS first,
               1 + CAST(('0x' || substr(md5('42:' || customer_id || ':step'), 1, 15)) AS BIGINT) % ((SELECT p FROM prime) - 1) AS step,
               unnest(range(0, (SELECT p FROM prime))) AS j
        FROM (SELECT customer_id, count(*) AS n_neg FROM pos GROUP BY customer_id) n) x
  WHERE j < 2 * n_neg + (SELECT p FROM prime) - (SELECT count(*) FROM items)""",
    "cand": """
  SELECT d.customer_id, i.article_id, d.j, d.n_neg FROM draws d JOIN items i ON d.idx = i.idx""",
    "neg": """
  SELECT customer_id, article_id, 0 AS label, CAST(0.0 AS DOUBLE) AS recency_weight,
         CAST(NULL AS INTEGER) AS days_since_purchase
  FROM (SELECT c.*, row_number() OVER (PARTITION BY c.customer_id ORDER BY c.j) AS rk
        FROM cand c WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.customer_id = c.customer_id
                                      AND p.article_id = c.article_id)) q
  WHERE rk <= n_neg""",
}
oracle("negatives", "SELECT * FROM neg", **NEG)
oracle("training_pairs", f"""
SELECT *, md5('42:' || customer_id || ':' || article_id) AS shuffle_key FROM (
SELECT customer_id, article_id, t_dat, pair_purchase_count, label, days_since_purchase, {r6("recency_weight")} AS recency_weight
FROM pos2
UNION ALL
SELECT customer_id, article_id, NULL, NULL, label, days_since_purchase, recency_weight FROM neg) u""", **NEG, pos2="""
  SELECT customer_id, article_id, max(t_dat) AS t_dat, count(*) AS pair_purchase_count, 1 AS label,
         CAST(date_diff('day', max(t_dat), (SELECT max(t_dat) FROM transactions)) AS INTEGER) AS days_since_purchase,
         exp(-date_diff('day', max(t_dat), (SELECT max(t_dat) FROM transactions)) / 90.0) AS recency_weight
  FROM transactions GROUP BY customer_id, article_id""")
