"""Oracle SQL for the cleaning queries."""

from cartwheel.plans.oracle import WS, oracle, r6, title_sql

oracle("dedupe_full", "SELECT DISTINCT * FROM raw_transactions")
oracle("dedupe_key", """
SELECT customer_id, article_id, t_dat, price, sales_channel_id FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, article_id, t_dat
                               ORDER BY price ASC NULLS LAST, sales_channel_id ASC NULLS LAST) AS rn
  FROM raw_transactions) q WHERE rn = 1""")
oracle("drop_null_keys", """
SELECT * FROM raw_transactions
WHERE customer_id IS NOT NULL AND article_id IS NOT NULL AND t_dat IS NOT NULL""")
oracle("fill_median", f"""
SELECT customer_id, article_id, t_dat,
       {r6("coalesce(price, (SELECT median(price) FROM raw_transactions))")} AS price, sales_channel_id
FROM raw_transactions""")
oracle("fill_mode", """
SELECT customer_id, article_id, t_dat, round(price * 1e6) / 1e6 AS price,
       coalesce(sales_channel_id, (SELECT sales_channel_id FROM raw_transactions WHERE sales_channel_id IS NOT NULL
                                   GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS sales_channel_id
FROM raw_transactions""")
oracle("clip_age", """
SELECT customer_id, age, CASE WHEN age IS NULL THEN NULL ELSE least(greatest(age, 15), 100) END AS age_clipped
FROM raw_customers""")
oracle("standardize_text", f"""
SELECT article_id, {title_sql("prod_name")} AS prod_name, round(product_type_no * 1e6) / 1e6 AS product_type_no,
       {title_sql("product_type_name")} AS product_type_name, {title_sql("product_group_name")} AS product_group_name,
       {title_sql("colour_group_name")} AS colour_group_name, {title_sql("garment_group_name")} AS garment_group_name,
       lower(trim(detail_desc, {WS})) AS detail_desc
FROM raw_articles""")
oracle("normalize_ids", f"""
SELECT trim(customer_id, {WS}) AS customer_id, trim(article_id, {WS}) AS article_id, t_dat,
       round(price * 1e6) / 1e6 AS price, sales_channel_id
FROM raw_transactions""")
oracle("date_range", """
SELECT min(t_dat) AS first_date, max(t_dat) AS last_date,
       CAST(date_diff('day', min(t_dat), max(t_dat)) AS INTEGER) AS span_days
FROM transactions""")
oracle("clean_transactions", "SELECT customer_id, article_id, t_dat, round(price * 1e6) / 1e6 AS price, sales_channel_id FROM transactions")
oracle("clean_customers", "SELECT * FROM customers")
oracle("clean_articles", "SELECT * FROM articles")
