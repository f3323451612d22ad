"""Oracle SQL for the profiling queries."""

from cartwheel.plans.oracle import oracle, r6, xavg

oracle("quality_report", f"""
SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, count(DISTINCT article_id) AS n_articles,
       min(t_dat) AS first_date, max(t_dat) AS last_date,
       CAST(count(*) FILTER (WHERE customer_id IS NULL) + count(*) FILTER (WHERE article_id IS NULL)
          + count(*) FILTER (WHERE t_dat IS NULL) + count(*) FILTER (WHERE price IS NULL)
          + count(*) FILTER (WHERE sales_channel_id IS NULL) AS BIGINT) AS null_cells,
       {r6("min(price)")} AS price_min, {r6("max(price)")} AS price_max, {r6(xavg("price"))} AS price_mean,
       {r6("median(price)")} AS price_median,
       count(*) FILTER (WHERE sales_channel_id = 1) AS channel_1_rows,
       count(*) FILTER (WHERE sales_channel_id = 2) AS channel_2_rows
FROM transactions""")
oracle("coverage", """
SELECT 'customers' AS entity, (SELECT count(DISTINCT customer_id) FROM customers) AS n_dimension,
       (SELECT count(DISTINCT customer_id) FROM transactions) AS n_in_transactions,
       round((SELECT count(DISTINCT customer_id) FROM transactions) * 100.0 / (SELECT count(DISTINCT customer_id) FROM customers), 1) AS coverage_pct
UNION ALL
SELECT 'articles', (SELECT count(DISTINCT article_id) FROM articles), (SELECT count(DISTINCT article_id) FROM transactions),
       round((SELECT count(DISTINCT article_id) FROM transactions) * 100.0 / (SELECT count(DISTINCT article_id) FROM articles), 1)""")
oracle("value_counts", f"""
SELECT CAST(sales_channel_id AS VARCHAR) AS value, count(*) AS count,
       {r6("count(*) / (SELECT count(sales_channel_id) FROM transactions)")} AS share
FROM transactions WHERE sales_channel_id IS NOT NULL GROUP BY sales_channel_id""")
oracle("value_counts_status", f"""
SELECT club_member_status AS value, count(*) AS count,
       {r6("count(*) / (SELECT count(club_member_status) FROM customers)")} AS share
FROM customers WHERE club_member_status IS NOT NULL GROUP BY club_member_status""")

_PF = """
  SELECT customer_id, count(article_id) AS purchase_count,
         CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) AS total_spend,
         CAST(date_diff('day', max(t_dat), (SELECT max(t_dat) FROM transactions)) AS INTEGER) AS days_since_last_purchase
  FROM transactions GROUP BY customer_id"""


def _desc(col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return (f"SELECT '{col}' AS column_name, count({x}) AS count, {r6(f'avg({x})')} AS mean, {r6(f'stddev_samp({x})')} AS std, "
            f"{r6(f'min({x})')} AS min, {r6(f'quantile_cont({x}, 0.25)')} AS p25, {r6(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{r6(f'quantile_cont({x}, 0.75)')} AS p75, {r6(f'max({x})')} AS max FROM pf")


oracle("describe_counts", "\nUNION ALL\n".join(_desc(c) for c in ["purchase_count", "total_spend", "days_since_last_purchase"]), pf=_PF)

_COLS_C = ["customer_id", "FN", "Active", "club_member_status", "fashion_news_frequency", "age"]
_TYPES_C = {"customer_id": "string", "FN": "double", "Active": "double", "club_member_status": "string",
            "fashion_news_frequency": "string", "age": "double"}
_COLS_A = ["article_id", "prod_name", "product_type_no", "product_type_name", "product_group_name",
           "colour_group_name", "garment_group_name", "detail_desc"]
_TYPES_A = {c: "string" for c in _COLS_A}
_TYPES_A["product_type_no"] = "double"


def _missing(table, cols, types):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, '{types[c]}' AS dtype, count(*) FILTER (WHERE \"{c}\" IS NULL) AS missing_count, "
        f"count(*) AS total_rows FROM {table}" for c in cols)


oracle("missing_report", f"""
SELECT column_name, missing_count, {r6("round(missing_count * 100.0 / total_rows, 2)")} AS missing_pct
FROM m WHERE missing_count > 0""", m=_missing("raw_customers", _COLS_C, _TYPES_C))
oracle("missing_actions", f"""
SELECT column_name, dtype, missing_count, {r6("round(missing_count * 100.0 / total_rows, 2)")} AS missing_pct,
       CASE WHEN missing_count = 0 THEN 'none'
            WHEN missing_count * 100.0 / total_rows > 70 THEN 'drop_column'
            WHEN missing_count * 100.0 / total_rows > 30 THEN 'fill_with_care'
            WHEN dtype = 'string' THEN 'fill_unknown_or_mode'
            WHEN dtype IN ('double', 'int', 'bigint') THEN 'fill_median_or_zero'
            ELSE 'inspect' END AS suggested_action
FROM m""", m=_missing("raw_articles", _COLS_A, _TYPES_A))


def _dups(name, table, keys):
    k = ", ".join(keys)
    return (f"SELECT '{name}' AS dataset, (SELECT count(*) FROM {table}) AS total_rows, "
            f"(SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS full_duplicates, "
            f"(SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {table})) AS key_duplicates")


oracle("duplicate_report", f"""
SELECT dataset, total_rows, full_duplicates, key_duplicates,
       {r6("round(full_duplicates * 100.0 / total_rows, 3)")} AS full_pct,
       {r6("round(key_duplicates * 100.0 / total_rows, 3)")} AS key_pct
FROM (
{_dups("transactions", "raw_transactions", ["customer_id", "article_id", "t_dat"])}
UNION ALL {_dups("customers", "raw_customers", ["customer_id"])}
UNION ALL {_dups("articles", "raw_articles", ["article_id"])}) q""")


def _dtype_rows():
    out = []
    for c in _COLS_C:
        t = _TYPES_C[c]
        sample = f"CAST(min(\"{c}\") AS VARCHAR)"
        if t == "double":
            sample = f"CASE WHEN min(\"{c}\") IS NULL THEN NULL ELSE CAST(min(\"{c}\") AS VARCHAR) END"
        intlike = f"coalesce(bool_and(\"{c}\" = floor(\"{c}\")), true)" if t == "double" else "false"
        out.append(f"SELECT '{c}' AS column_name, '{t}' AS dtype, coalesce(substr({sample}, 1, 30), 'N/A') AS sample_value, "
                   f"count(DISTINCT \"{c}\") AS unique_values, {intlike} AS intlike FROM raw_customers")
    return "\nUNION ALL\n".join(out)


oracle("dtype_report", """
SELECT column_name, dtype, sample_value, unique_values,
       CASE WHEN column_name LIKE '%\\_id' ESCAPE '\\' AND dtype IN ('double', 'string') THEN 'id_as_text'
            WHEN lower(column_name) LIKE '%date%' OR (column_name = 't_dat' AND dtype = 'string') THEN 'parse_date'
            WHEN dtype = 'string' AND unique_values < 50 THEN 'low_cardinality'
            WHEN dtype = 'double' AND intlike THEN 'integer_with_gaps'
            ELSE 'ok' END AS flag
FROM d""", d=_dtype_rows())
oracle("shape_overview", """
SELECT 'transactions' AS dataset, count(*) AS n_rows, 5 AS n_columns FROM raw_transactions
UNION ALL SELECT 'customers', count(*), 6 FROM raw_customers
UNION ALL SELECT 'articles', count(*), 8 FROM raw_articles""")


def _hist(src: str, bins: int) -> str:
    return f"""
SELECT b.bin, {r6(f"lo + b.bin * ((hi - lo) / {bins})")} AS bin_start, {r6(f"lo + (b.bin + 1) * ((hi - lo) / {bins})")} AS bin_end,
       coalesce(c.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) b
CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM ({src}) s) mm
LEFT JOIN (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) END AS INTEGER) AS bin,
         count(*) AS count
  FROM ({src}) s2 CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM ({src}) s3) m2
  GROUP BY 1) c ON b.bin = c.bin"""


oracle("age_histogram", _hist("SELECT CAST(age AS DOUBLE) AS x FROM raw_customers WHERE age IS NOT NULL", 50))
oracle("purchase_count_histogram",
       _hist("SELECT CAST(least(count(*), 100) AS DOUBLE) AS x FROM transactions GROUP BY customer_id", 60))
oracle("weekly_volume", """
SELECT CAST(w.week AS DATE) AS week, coalesce(c.n, 0) AS purchase_count
FROM (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS week FROM wk) w
LEFT JOIN (SELECT week, count(*) AS n FROM wk GROUP BY week) c ON CAST(w.week AS DATE) = c.week""",
       wk="SELECT CAST(date_trunc('week', t_dat) + INTERVAL 6 DAY AS DATE) AS week FROM transactions")
oracle("orphans", """
SELECT 'customer' AS entity, customer_id AS id FROM (SELECT DISTINCT customer_id FROM transactions) t
WHERE customer_id NOT IN (SELECT customer_id FROM customers)
UNION ALL
SELECT 'article', article_id FROM (SELECT DISTINCT article_id FROM transactions) t
WHERE article_id NOT IN (SELECT article_id FROM articles)""")
oracle("top_articles", """
SELECT t.article_id, t.purchase_count, a.prod_name, substr(a.prod_name, 1, 35) AS label
FROM (SELECT article_id, count(*) AS purchase_count FROM transactions GROUP BY article_id
      ORDER BY purchase_count DESC, article_id LIMIT 20) t
LEFT JOIN articles a ON t.article_id = a.article_id""")
oracle("top_customers", """
SELECT customer_id, purchase_count, substr(customer_id, 1, 12) || '...' AS short_id
FROM (SELECT customer_id, count(*) AS purchase_count FROM transactions GROUP BY customer_id
      ORDER BY purchase_count DESC, customer_id LIMIT 20) t""")
oracle("first_last_txn", """
SELECT customer_id, article_id, t_dat, round(price * 1e6) / 1e6 AS price, sales_channel_id,
       CASE WHEN t_dat = (SELECT min(t_dat) FROM transactions) THEN 'first' ELSE 'last' END AS position
FROM transactions
WHERE t_dat = (SELECT min(t_dat) FROM transactions) OR t_dat = (SELECT max(t_dat) FROM transactions)""")
