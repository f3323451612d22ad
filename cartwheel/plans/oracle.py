"""Independent SQL (DuckDB dialect) for every query with an exact oracle.

The canonical views of ``cartwheel.sources.tables`` are restated here as CTEs;
the driver pre-registers the raw tables as views.  Doubles are rounded to 6
places, as the Spark side does.
"""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"

BASE = {
    "raw_transactions": f"""
  SELECT CASE WHEN o.o_orderkey % 401 = 400 THEN NULL
              WHEN o.o_orderkey % 13 = 0 THEN ' ' || CAST(o.o_custkey AS VARCHAR) || chr(9)
              ELSE CAST(o.o_custkey AS VARCHAR) END AS customer_id,
         CAST(l.l_partkey AS VARCHAR) AS article_id,
         CAST(o.o_orderdate AS DATE) AS t_dat,
         CASE WHEN (l.l_orderkey + l.l_linenumber) % 50 = 0 THEN NULL ELSE l.l_extendedprice END AS price,
         CAST(CASE WHEN (l.l_orderkey * 7 + l.l_linenumber) % 61 = 0 THEN NULL
              WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 2 END AS INTEGER) AS sales_channel_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "tx_dedup": """
  SELECT customer_id, article_id, t_dat, price, sales_channel_id FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id, article_id, t_dat
                                 ORDER BY price ASC NULLS LAST, sales_channel_id ASC NULLS LAST) AS rn
    FROM raw_transactions) q
  WHERE rn = 1 AND customer_id IS NOT NULL AND article_id IS NOT NULL AND t_dat IS NOT NULL""",
    "transactions": f"""
  SELECT trim(customer_id, {WS}) AS customer_id,
         trim(article_id, {WS}) AS article_id,
         t_dat,
         CAST(coalesce(price, (SELECT median(price) FROM tx_dedup)) AS DOUBLE) AS price,
         CAST(coalesce(sales_channel_id,
              (SELECT sales_channel_id FROM tx_dedup WHERE sales_channel_id IS NOT NULL
               GROUP BY sales_channel_id ORDER BY count(*) DESC, sales_channel_id LIMIT 1)) AS TINYINT) AS sales_channel_id
  FROM tx_dedup""",
    "raw_customers": """
  SELECT CASE WHEN c_custkey % 250 = 249 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS customer_id,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS DOUBLE) END AS FN,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1.0 AS DOUBLE) END AS Active,
         CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS club_member_status,
         CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'NONE'
              WHEN c_nationkey % 3 = 1 THEN 'Regularly' ELSE 'Monthly' END AS fashion_news_frequency,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 131 AS DOUBLE) END AS age
  FROM customer""",
    "cust_dedup": """
  SELECT customer_id, FN, Active, club_member_status, fashion_news_frequency, age FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY FN ASC NULLS LAST, Active ASC NULLS LAST,
             club_member_status ASC NULLS LAST, fashion_news_frequency ASC NULLS LAST, age ASC NULLS LAST) AS rn
    FROM raw_customers) q
  WHERE rn = 1 AND customer_id IS NOT NULL""",
    "customers": f"""
  SELECT trim(customer_id, {WS}) AS customer_id,
         CAST(coalesce(FN, 0) AS INTEGER) AS FN,
         CAST(coalesce(Active, 0) AS INTEGER) AS Active,
         trim(coalesce(club_member_status, 'Unknown'), {WS}) AS club_member_status,
         trim(coalesce(fashion_news_frequency, 'None'), {WS}) AS fashion_news_frequency,
         CAST(trunc(least(greatest(coalesce(age, (SELECT median(age) FROM cust_dedup)), 15), 100)) AS INTEGER) AS age
  FROM cust_dedup""",
    "raw_articles": """
  SELECT CAST(p_partkey AS VARCHAR) AS article_id,
         p_name AS prod_name,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS product_type_no,
         CASE WHEN p_partkey % 3 = 0 THEN ' ' || lower(p_type) || chr(9) ELSE p_type END AS product_type_name,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS product_group_name,
         split_part(p_name, ' ', 1) AS colour_group_name,
         split_part(p_name, ' ', 2) AS garment_group_name,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name || ' in ' || p_type END AS detail_desc
  FROM part""",
    "art_dedup": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY prod_name ASC NULLS LAST,
             product_type_no ASC NULLS LAST, product_type_name ASC NULLS LAST, product_group_name ASC NULLS LAST,
             colour_group_name ASC NULLS LAST, garment_group_name ASC NULLS LAST, detail_desc ASC NULLS LAST) AS rn
    FROM raw_articles) q
  WHERE rn = 1 AND article_id IS NOT NULL""",
    "articles": f"""
  SELECT trim(article_id, {WS}) AS article_id,
         {{title:coalesce(prod_name, 'Unknown')}} AS prod_name,
         CAST(trunc(coalesce(product_type_no, (SELECT median(product_type_no) FROM art_dedup))) AS BIGINT) AS product_type_no,
         {{title:coalesce(product_type_name, 'Unknown')}} AS product_type_name,
         {{title:coalesce(product_group_name, 'Unknown')}} AS product_group_name,
         {{title:coalesce(colour_group_name, 'Unknown')}} AS colour_group_name,
         {{title:coalesce(garment_group_name, 'Unknown')}} AS garment_group_name,
         lower(trim(coalesce(detail_desc, 'No description'), {WS})) AS detail_desc
  FROM art_dedup""",
    "factors": """
  SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS features, label FROM embeddings""",
}


def title_sql(expr: str) -> str:
    """Python ``str.title()`` after ``strip()`` in DuckDB."""
    return ("array_to_string(list_transform(regexp_extract_all(lower(trim(" + expr + ", " + WS + ")), "
            "'(\\p{L}+|[^\\p{L}]+)'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '')")


def _expand(text: str) -> str:
    import re

    def rep(m):
        return title_sql(m.group(1))
    return re.sub(r"\{title:([^{}]+\([^{}]*\))\}", rep, text)


BASE = {k: _expand(v) for k, v in BASE.items()}


def with_base(body: str, extra: dict[str, str] | None = None) -> str:
    ctes = dict(BASE)
    ctes.update(extra or {})
    w = ",\n".join(f"{k} AS ({v}\n)" for k, v in ctes.items())
    return f"WITH {w}\n{body}"


def r6(expr: str) -> str:
    """Same rounding as ``round_half_up`` on the Spark side."""
    return f"(round(CAST({expr} AS DOUBLE) * 1e6) / 1e6 + 0.0)"


def xsum(expr: str) -> str:
    """Fixed-point sum, as ``exact_sum``."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(28,6))) AS DOUBLE)"


def xavg(expr: str) -> str:
    return f"({xsum(expr)} / count({expr}))"


ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, **extra: str) -> None:
    ORACLE[name] = with_base(body, extra)


def all_oracles() -> dict[str, str]:
    from cartwheel.plans import o_clean, o_features, o_io, o_misc, o_profile, o_retrieval, o_sampling  # noqa: F401
    return dict(ORACLE)
