"""Oracle SQL for the feature queries."""

from cartwheel.plans.oracle import oracle, r6, xavg, xsum

PF = f"""
  SELECT customer_id, count(article_id) AS purchase_count, max(t_dat) AS recent_purchase_date,
         min(t_dat) AS first_purchase_date, {xsum("price")} AS total_spend, {xavg("price")} AS avg_spend_per_txn,
         count(DISTINCT article_id) AS unique_articles,
         CAST(date_diff('day', max(t_dat), (SELECT max(t_dat) FROM transactions)) AS INTEGER) AS days_since_last_purchase,
         count(article_id) / greatest(date_diff('day', min(t_dat), max(t_dat)), 1) AS purchase_frequency
  FROM transactions GROUP BY customer_id"""

oracle("user_features", f"""
SELECT c.customer_id, c.FN, c.Active, c.club_member_status, c.fashion_news_frequency, c.age,
       coalesce(p.purchase_count, 0) AS purchase_count, p.recent_purchase_date, p.first_purchase_date,
       {r6("coalesce(p.total_spend, 0.0)")} AS total_spend, {r6("p.avg_spend_per_txn")} AS avg_spend_per_txn,
       p.unique_articles, coalesce(p.days_since_last_purchase, 9999) AS days_since_last_purchase,
       {r6("coalesce(p.purchase_frequency, 0.0)")} AS purchase_frequency,
       coalesce(CAST(p.days_since_last_purchase <= 90 AS INTEGER), 0) AS active_status
FROM customers c LEFT JOIN pf p ON c.customer_id = p.customer_id""", pf=PF)

MAXD = "(SELECT max(t_dat) FROM transactions)"

oracle("user_purchase_agg", f"""
SELECT customer_id, purchase_count, recent_purchase_date, first_purchase_date, {r6("total_spend")} AS total_spend,
       {r6("avg_spend_per_txn")} AS avg_spend_per_txn, unique_articles FROM pf""", pf=PF)
oracle("user_rfm", f"""
SELECT customer_id, purchase_count, recent_purchase_date, first_purchase_date, {r6("total_spend")} AS total_spend,
       {r6("avg_spend_per_txn")} AS avg_spend_per_txn, unique_articles, days_since_last_purchase,
       {r6("purchase_frequency")} AS purchase_frequency, CAST(days_since_last_purchase <= 90 AS INTEGER) AS active_status
FROM pf""", pf=PF)
oracle("recency_score", f"""
SELECT customer_id, last_purchase_date, days_since_purchase,
       {r6("coalesce(1 - days_since_purchase / nullif((SELECT max(days_since_purchase) FROM r), 0), 1.0)")} AS recency_score,
       CAST(days_since_purchase <= 90 AS INTEGER) AS active_status
FROM r""", r="""
  SELECT customer_id, max(t_dat) AS last_purchase_date,
         CAST(date_diff('day', max(t_dat), DATE '2001-09-01') AS INTEGER) AS days_since_purchase
  FROM transactions GROUP BY customer_id""")
oracle("purchase_frequency_weekly", f"""
SELECT customer_id, {r6("count(*) / greatest(date_diff('day', min(t_dat), max(t_dat)) / 7.0, 1.0)")} AS purchase_frequency
FROM transactions GROUP BY customer_id""")
oracle("spend_features", f"""
SELECT customer_id, {r6(xsum("price"))} AS total_spend, {r6(xavg("price"))} AS avg_spend_per_transaction
FROM transactions GROUP BY customer_id""")
oracle("active_split", f"""
SELECT active_status, count(*) AS n_customers,
       {r6("round(count(*) * 100.0 / (SELECT count(*) FROM customers), 1)")} AS pct
FROM (SELECT coalesce(CAST(p.days_since_last_purchase <= 90 AS INTEGER), 0) AS active_status
      FROM customers c LEFT JOIN pf p ON c.customer_id = p.customer_id) q
GROUP BY active_status""", pf=PF)

POP = f"""
  SELECT article_id, count(customer_id) AS total_purchases, count(DISTINCT customer_id) AS unique_buyers,
         {xavg("price")} AS avg_price, min(t_dat) AS first_sold_date, max(t_dat) AS last_sold_date,
         CAST(date_diff('day', max(t_dat), {MAXD}) AS INTEGER) AS days_since_last_sale
  FROM transactions GROUP BY article_id"""
RECENT = f"""
  SELECT article_id, count(customer_id) AS purchases_last_30d FROM transactions
  WHERE t_dat >= {MAXD} - INTERVAL 30 DAY GROUP BY article_id"""

oracle("item_popularity", f"""
SELECT article_id, total_purchases, unique_buyers, {r6("avg_price")} AS avg_price, first_sold_date, last_sold_date,
       days_since_last_sale, {r6("total_purchases / (SELECT max(total_purchases) FROM pop)")} AS popularity_score
FROM pop""", pop=POP)
oracle("recent_popularity", "SELECT * FROM recent", recent=RECENT)
TRENDING = f"""
  SELECT article_id, count(customer_id) AS recent_purchases FROM transactions
  WHERE t_dat >= {MAXD} - INTERVAL 30 DAY GROUP BY article_id"""
TRENDING_SCORES = f"""
SELECT article_id, recent_purchases, {r6("recent_purchases / (SELECT max(recent_purchases) FROM t)")} AS recent_popularity_score
FROM t"""
oracle("trending_scores", TRENDING_SCORES, t=TRENDING)
oracle("trending_items", TRENDING_SCORES + " ORDER BY recent_purchases DESC, article_id LIMIT 5", t=TRENDING)
oracle("article_age", """
SELECT a.article_id, f.first_sold_date, coalesce(f.article_age_days, (SELECT max(article_age_days) FROM f)) AS article_age_days
FROM articles a LEFT JOIN f ON a.article_id = f.article_id""", f=f"""
  SELECT article_id, min(t_dat) AS first_sold_date,
         CAST(date_diff('day', min(t_dat), {MAXD}) AS INTEGER) AS article_age_days
  FROM transactions GROUP BY article_id""")
oracle("item_features", f"""
SELECT a.*, coalesce(p.total_purchases, 0) AS total_purchases, coalesce(p.unique_buyers, 0) AS unique_buyers,
       {r6("p.avg_price")} AS avg_price, p.first_sold_date, p.last_sold_date,
       coalesce(p.days_since_last_sale, 0) AS days_since_last_sale,
       {r6("coalesce(p.total_purchases / (SELECT max(total_purchases) FROM pop), 0.0)")} AS popularity_score,
       coalesce(r.purchases_last_30d, 0) AS purchases_last_30d
FROM articles a LEFT JOIN pop p ON a.article_id = p.article_id LEFT JOIN recent r ON a.article_id = r.article_id""",
       pop=POP, recent=RECENT)

INTER = f"""
  SELECT customer_id, article_id, t_dat, price, 1 AS label,
         CAST(date_diff('day', t_dat, {MAXD}) AS INTEGER) AS days_since_purchase,
         exp(-0.01 * date_diff('day', t_dat, {MAXD})) AS recency_weight,
         count(*) OVER (PARTITION BY customer_id, article_id) AS purchase_count_pair
  FROM transactions"""
oracle("interaction_features", f"""
SELECT customer_id, article_id, t_dat, {r6("price")} AS price, label, days_since_purchase,
       {r6("recency_weight")} AS recency_weight, purchase_count_pair,
       CAST(purchase_count_pair > 1 AS INTEGER) AS is_repeat_purchase,
       CAST(isodow(t_dat) - 1 AS INTEGER) AS day_of_week, CAST(month(t_dat) AS INTEGER) AS month,
       CAST(weekofyear(t_dat) AS INTEGER) AS week_of_year, CAST(year(t_dat) AS INTEGER) AS year
FROM inter""", inter=INTER)
oracle("repeat_purchase", f"""
SELECT customer_id, article_id, t_dat, {r6("price")} AS price, label, purchase_count_pair,
       CAST(purchase_count_pair > 1 AS INTEGER) AS is_repeat_purchase
FROM inter""", inter=INTER)
oracle("recency_weight", f"""
SELECT customer_id, article_id, t_dat, {r6("price")} AS price, label, days_since_purchase,
       {r6("recency_weight")} AS recency_weight
FROM inter""", inter=INTER)
oracle("calendar_features", """
SELECT customer_id, article_id, t_dat, CAST(isodow(t_dat) - 1 AS INTEGER) AS day_of_week,
       CAST(month(t_dat) AS INTEGER) AS month, CAST(weekofyear(t_dat) AS INTEGER) AS week_of_year,
       CAST(year(t_dat) AS INTEGER) AS year
FROM transactions""")
POS = f"""
  SELECT customer_id, article_id, max(t_dat) AS t_dat, count(*) AS pair_purchase_count, 1 AS label,
         CAST(date_diff('day', max(t_dat), {MAXD}) AS INTEGER) AS days_since_purchase,
         exp(-date_diff('day', max(t_dat), {MAXD}) / 90.0) AS recency_weight
  FROM transactions GROUP BY customer_id, article_id"""
oracle("positive_pairs", f"""
SELECT customer_id, article_id, t_dat, pair_purchase_count, label, days_since_purchase,
       {r6("recency_weight")} AS recency_weight FROM pos""", pos=POS)
oracle("popularity_score", f"""
SELECT article_id, total_purchases, {r6("total_purchases / (SELECT max(total_purchases) FROM pop)")} AS popularity_score
FROM pop""", pop=POP)
