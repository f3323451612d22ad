"""Oracle SQL for readers, writers, stored tables and the recent-window features."""

from cartwheel.plans import o_features, o_retrieval  # noqa: F401 (they come first)
from cartwheel.plans.o_profile import _dups
from cartwheel.plans.oracle import BASE, ORACLE, oracle, r6

_RECS = {**o_retrieval.BASE, "recs": o_retrieval.BATCH}

oracle("raw_csv_transactions", "SELECT * FROM raw_transactions")
oracle("raw_csv_articles", "SELECT * FROM raw_articles")
oracle("raw_csv_customers", "SELECT * FROM raw_customers")
oracle("first_existing_source", "SELECT * FROM articles")
oracle("alternate_item_key", f"""
SELECT r.user_id, r.item_id AS article_id, {r6("r.score")} AS score, r.rank, a.product_type_name
FROM recs r JOIN articles a ON r.item_id = a.article_id""", **_RECS)
oracle("model_settings", """
SELECT count(*) AS n_vectors, count(*) FILTER (WHERE len(embedding) = w.width) AS n_fitting, CAST(max(w.width) AS INTEGER) AS embedding_dim,
       'customer_id' AS user_id_col, 'article_id' AS item_id_col, CAST(10 AS INTEGER) AS top_k
FROM embeddings, (SELECT max(len(embedding)) AS width FROM embeddings) w""")
ORACLE["batch_export"] = ORACLE["readable_recs"]
oracle("payload_records", f"""
SELECT 'recommendations:' || r.user_id || ':top10' AS cache_key, r.user_id,
       CAST(count(*) OVER (PARTITION BY r.user_id) AS INTEGER) AS total_recommendations, r.rank, r.item_id AS product_id,
       a.product_type_name AS product_type, a.colour_group_name AS color, a.garment_group_name AS garment_group,
       a.product_group_name AS product_group, {r6("r.score")} AS score
FROM recs r LEFT JOIN articles a ON r.item_id = a.article_id""", **_RECS)
ORACLE["user_features_bucketed"] = ORACLE["user_features"]

_VISITS = "SELECT customer_id, t_dat, sales_channel_id FROM raw_transactions"
oracle("dedupe_visits", "SELECT DISTINCT * FROM visits", visits=_VISITS)
oracle("duplicate_visits", f"""
SELECT dataset, total_rows, full_duplicates, key_duplicates, {r6("round(full_duplicates * 100.0 / total_rows, 3)")} AS full_pct,
       {r6("round(key_duplicates * 100.0 / total_rows, 3)")} AS key_pct
FROM ({_dups("visits", "visits", ["customer_id", "t_dat"])}) q""", visits=_VISITS)

# the same features, over a fact table of the last 30 days
_LAST_30 = f"""
  SELECT * FROM ({BASE["transactions"]}) t
  WHERE t_dat >= (SELECT max(t_dat) FROM tx_dedup) - INTERVAL 30 DAY"""
for _name in ("user_features", "item_features", "article_age"):
    ORACLE[f"{_name}_recent"] = ORACLE[_name].replace(BASE["transactions"], _LAST_30)
