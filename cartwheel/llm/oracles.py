"""DuckDB SQL for the driver queries that SQL can express, over the same Parquet tables."""

OP1 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, verdict) AS (
  VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')
), split AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path FROM rules
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN split ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_MIX = r"""
sized AS (
  SELECT {id} AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {docs}
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS cap FROM src
), levels AS (
  SELECT *, cap / weight AS r,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), water AS (
  SELECT arg_min(level, (r, source IS NULL, source)) AS water FROM levels WHERE level <= r
), aimed AS (
  SELECT source, source_size, n_docs, CASE WHEN water IS NULL OR r < water THEN cap ELSE weight * water END AS target FROM levels, water
), seats AS (
  SELECT round(sum(target) / 16)::BIGINT AS seats FROM aimed
), quotients AS (
  SELECT source, target, s, target / (2 * s + 1) AS q, seats FROM aimed, seats, range(0, (target / 16 + 400)::BIGINT) AS g(s) WHERE target > 0
), won AS (
  SELECT source, count(*) AS blocks FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST, s) AS k, seats FROM quotients) WHERE k <= seats GROUP BY source
), plan AS (
  SELECT a.source, source_size, target, coalesce(blocks, 0) AS blocks, ceil(n_docs / 512)::BIGINT AS shards FROM aimed a LEFT JOIN won w ON a.source IS NOT DISTINCT FROM w.source
), placed AS (
  SELECT id, size, s.source, source_size, target, blocks,
         ('0x' || substr(md5('7/shard/' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT % shards AS shard,
         ('0x' || substr(md5('7/order/' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT AS ord
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), cells AS (
  SELECT source, shard, source_size, blocks, sum(size)::BIGINT AS cell, CASE WHEN source_size > 0 THEN target * sum(size) / source_size ELSE 0 END AS claim
  FROM placed GROUP BY source, shard, source_size, target, blocks
), cell_quotients AS (
  SELECT source, shard, s, claim / (2 * s + 1) AS q, blocks FROM cells, range(0, (claim / 16 + 400)::BIGINT) AS g(s) WHERE claim > 0
), cell_won AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, s) AS k FROM cell_quotients) WHERE k <= blocks GROUP BY source, shard
), wanted AS (
  SELECT c.source, c.shard, cell, least(coalesce(quota, 0) * 16, cell * 3) AS wanted,
         CASE WHEN cell > 0 THEN ('0x' || substr(md5('7/start/' || coalesce(c.source, '') || '/' || c.shard::VARCHAR), 1, 8))::BIGINT * 16 % cell ELSE 0 END AS first
  FROM cells c LEFT JOIN cell_won w ON c.source IS NOT DISTINCT FROM w.source AND c.shard = w.shard
), lined AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY ord, id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS fin FROM placed
), mixed AS (
  SELECT id, size, l.source, source_size, target, CASE WHEN cell > 0 THEN wanted // cell ELSE 0 END AS passes, fin - size AS beg, fin, cell, first,
         first + wanted - CASE WHEN cell > 0 THEN wanted // cell ELSE 0 END * cell AS stop
  FROM lined l JOIN wanted w ON l.source IS NOT DISTINCT FROM w.source AND l.shard = w.shard
), taken AS (
  SELECT id, size, source, source_size, target,
         (passes * size + greatest(0, least(fin, least(stop, cell)) - greatest(beg, first)) + greatest(0, least(fin, stop - cell) - greatest(beg, 0)))::BIGINT AS taken FROM mixed
)"""


def mix_sql(docs: str, doc_id: str = "doc_id") -> str:
    """The WITH members that end in ``taken (id, size, source, source_size, target, taken)``."""
    return _MIX.replace("{id}", doc_id).replace("{docs}", docs)


OP7 = "WITH " + mix_sql("documents") + "SELECT id AS doc_id, size, source_size, target, taken FROM taken"


def all_oracles() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op6_exact_dedup": OP6, "op7_mixing": OP7}
