"""Oracle SQL for resolution helpers and context features."""

from cartwheel.plans.oracle import oracle

oracle("star_views", """
SELECT t.customer_id, t.article_id, t.t_dat, round(t.price * 1e6) / 1e6 AS price, t.sales_channel_id,
       c.age, c.club_member_status, a.product_type_name, a.colour_group_name
FROM transactions t JOIN customers c ON t.customer_id = c.customer_id JOIN articles a ON t.article_id = a.article_id""")
oracle("resolve_ids", "SELECT customer_id AS user_id, article_id AS item_id, t_dat FROM transactions")
oracle("known_ids", "SELECT DISTINCT article_id FROM articles WHERE article_id IS NOT NULL")
oracle("id_picker", """
SELECT DISTINCT customer_id AS id FROM transactions WHERE customer_id IS NOT NULL ORDER BY id LIMIT 500""")
oracle("catalog_attrs", """
SELECT article_id, product_type_name, product_group_name, colour_group_name, garment_group_name FROM articles""")
oracle("short_labels", """
SELECT article_id, CASE WHEN length(prod_name) > 35 THEN substr(prod_name, 1, 35) ELSE prod_name END AS label,
       substr(article_id, 1, 12) || '...' AS short_id, substr(detail_desc, 1, 120) AS description
FROM articles""")
oracle("recent_purchase_count", """
SELECT customer_id, count(*) FILTER (WHERE t_dat >= (SELECT max(t_dat) FROM transactions) - INTERVAL 30 DAY)
       AS recent_purchase_count
FROM transactions GROUP BY customer_id""")


def _pref(attr, name):
    return f"""
  SELECT customer_id, {attr} AS {name}, n AS {name}_count FROM (
    SELECT customer_id, {attr}, n, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, {attr}) AS r
    FROM (SELECT t.customer_id, a.{attr}, count(*) AS n
          FROM transactions t JOIN articles a ON t.article_id = a.article_id GROUP BY 1, 2) g) q
  WHERE r = 1"""


oracle("preferred_attribute", """
SELECT coalesce(t.customer_id, c.customer_id) AS customer_id, t.preferred_product_type, t.preferred_product_type_count,
       c.preferred_color, c.preferred_color_count
FROM pt t FULL JOIN pc c ON t.customer_id = c.customer_id""",
       pt=_pref("product_type_name", "preferred_product_type"), pc=_pref("colour_group_name", "preferred_color"))
oracle("season_weekend_flags", """
SELECT customer_id, article_id, t_dat, CAST(month(t_dat) AS INTEGER) AS purchase_month,
       CASE WHEN month(t_dat) IN (12, 1, 2) THEN 'winter' WHEN month(t_dat) IN (3, 4, 5) THEN 'spring'
            WHEN month(t_dat) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS purchase_season,
       CAST(isodow(t_dat) >= 6 AS INTEGER) AS weekend_purchase
FROM transactions""")
oracle("popularity_trend", """
SELECT article_id, month, purchases, prev_purchases, purchases - prev_purchases AS trend FROM (
  SELECT article_id, month, purchases, lag(purchases) OVER (PARTITION BY article_id ORDER BY month) AS prev_purchases
  FROM (SELECT article_id, CAST(date_trunc('month', t_dat) AS DATE) AS month, count(*) AS purchases
        FROM transactions GROUP BY 1, 2) g) q""")
