"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

_SUFFIX = "'ac.uk','co.in','co.jp','co.nz','co.uk','co.za','com.au','com.br','com.mx','org.uk'"


def _strength(level: str) -> str:
    return f"""(SELECT 1.0 / CASE WHEN s IS NULL OR b - a <= 1e-9 THEN 0.1
        ELSE least(greatest((s - a) / (b - a), 0.001), 0.5) END - 1.0
        FROM (SELECT sum(n * (k / n::DOUBLE - p) * (k / n::DOUBLE - p)) s, sum(p * (1 - p)) a, sum(n * p * (1 - p)) b
              FROM {level} WHERE n > 0))"""


OP1 = f"""
WITH u AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
h0 AS (
  SELECT host, count(quality) n, coalesce(sum(quality), 0) k
  FROM p LEFT JOIN labels ON page_id = doc_id GROUP BY host),
h AS (
  SELECT *, regexp_extract(host, '[^.]*$') AS one, regexp_extract(host, '(?:[^.]*\\.)?[^.]*$') AS two,
    regexp_extract(host, '(?:[^.]*\\.)?(?:[^.]*\\.)?[^.]*$') AS three FROM h0),
hosts AS (
  SELECT host, n, k, CASE WHEN two IN ({_SUFFIX}) THEN three ELSE two END AS domain,
    CASE WHEN two IN ({_SUFFIX}) THEN two ELSE one END AS suffix FROM h),
d0 AS (SELECT domain, suffix, sum(n) n, sum(k) k FROM hosts GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) n, sum(k) k, (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) FROM hosts) p FROM d0 GROUP BY suffix),
s1 AS (SELECT *, {_strength('s0')} AS st FROM s0),
s2 AS (SELECT suffix, (k + st * p) / (n + st) m FROM s1),
d1 AS (SELECT domain, n, k, m AS p FROM d0 JOIN s2 USING (suffix)),
d2 AS (SELECT *, {_strength('d1')} AS st FROM d1),
d3 AS (SELECT domain, (k + st * p) / (n + st) m FROM d2),
h1 AS (SELECT host, n, k, m AS p FROM hosts JOIN d3 USING (domain)),
h2 AS (SELECT *, {_strength('h1')} AS st FROM h1),
h3 AS (SELECT host, n, k, st, (k + st * p) / (n + st) m FROM h2),
h4 AS (SELECT *, 1 / (9 * m * (n + st)) u, 1 / (9 * (1 - m) * (n + st)) v FROM h3),
h5 AS (SELECT *, u * (1 - v) * (1 - v) + v * (1 - u) * (1 - u) - u * v * 2.326 * 2.326 spread, (1 - v) * (1 - v) - v * 2.326 * 2.326 below FROM h4),
h6 AS (SELECT *, greatest(((1 - u) * (1 - v) + 2.326 * sqrt(greatest(spread, 0))) / below, 0) root FROM h5),
h7 AS (SELECT *, CASE WHEN below > 0 AND v < 1 AND spread >= 0 THEN root * root * root * m / (root * root * root * m + 1 - m) ELSE 1 END AS upper_bound FROM h6),
rules(action, rule, rhost, rpath) AS (VALUES ('allow','com/','com','/'), ('block','example.com/en/','example.com','/en/'),
  ('allow','www.example.com/en/','www.example.com','/en/'), ('block','net/es/','net','/es/'), ('block','net/fr/','net','/fr/')),
best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) rule, arg_max(action, length(rule)) action
  FROM (SELECT DISTINCT page_id, host, path FROM p)
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, best.rule,
  coalesce(best.action, CASE WHEN upper_bound < 0.7 THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS host_outcomes, k::BIGINT AS host_good, round(m, 6) AS host_mean
FROM p JOIN h7 USING (host) LEFT JOIN best ON best.page_id = p.page_id AND best.host = p.host AND best.path = p.path
"""


OP2 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT score
  FROM e q JOIN e d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
WHERE rank <= 20
"""


OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END sh FROM w),
e AS (SELECT doc_id, unnest(sh) g FROM s),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) n FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id reach FROM s UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON r.reach = both_ways.a),
m AS (SELECT doc_id, min(reach) component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op2_top_k": OP2, "op8_minhash": OP8}
