"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), stats AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM stats
), filled AS (
  SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS w,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS n, coalesce(sum(source_size) OVER o, 0) AS before_size, coalesce(sum(weight) OVER o, 0) AS before_weight
  FROM weighed
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, ((t - 3 * before_size)::DOUBLE / (w - before_weight)::DOUBLE) AS level FROM filled
), level AS (
  SELECT arg_min(level, n) FILTER (WHERE NOT 3 * source_size < level * weight) AS level FROM leveled
), rated AS (
  SELECT source, source_size, least(level.level * weight, (3 * source_size)::DOUBLE) AS target,
    CASE WHEN source_size > 0 THEN least(level.level * weight, (3 * source_size)::DOUBLE) / source_size ELSE 0 END AS rate
  FROM weighed, level
), drawn AS (
  SELECT s.*, r.source_size, r.target, r.rate, k,
    ((('0x' || substr(h, 1, 8))::BIGINT + k * ('0x' || substr(h, 9, 8))::BIGINT) % 4294967296) < (r.rate - floor(r.rate)) * 4294967296 AS again
  FROM (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || '|' || size) AS h FROM sized) s
  JOIN rated r ON s.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(64)) AS k)
), seeds AS (
  SELECT source, k, abs(sum(CASE WHEN again THEN size ELSE 0 END) + floor(any_value(rate)) * any_value(source_size) - any_value(target)) AS off
  FROM drawn GROUP BY source, k
), chosen AS (
  SELECT source, k FROM seeds QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1
)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * least(floor(d.rate) + again::INT, 3))::BIGINT AS taken
FROM drawn d JOIN chosen c ON d.k = c.k AND d.source IS NOT DISTINCT FROM c.source
"""

ORACLE_SQL["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL["op8_url_filter"] = r"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT parsed.*, h || p AS rule, verdict, length(h) AS n
  FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM fits QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST, n DESC) = 1
"""

ORACLE_SQL["op10_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

ORACLE_SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), fated AS (
  SELECT *, xor(list_reduce(list_transform(range(length(k)), lambda i: ord(k[i + 1])::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, n: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) % 20 AS fate FROM hashed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged
), faulty AS (
  SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY g, role, text ORDER BY n) > 1 AS seen,
    role[1] AS i, lag(role[1]) OVER (PARTITION BY g ORDER BY n) AS i_before
  FROM placed
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM faulty
), stats AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i_before IS NOT NULL AND i_before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows
  FROM judged GROUP BY g
), moves AS (
  SELECT g, n, i, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged
), states AS (
  SELECT g, 0::BIGINT AS n, {'c': 0, 'a': ''} AS s0, NULL::STRUCT(c INT, a VARCHAR) AS s1, {'c': 5, 'a': 'I'} AS s2, {'c': 10, 'a': 'II'} AS s3 FROM stats
  UNION ALL
  SELECT g, n, s0, s1, m2, list_min([r3, CASE WHEN m2 IS NOT NULL THEN {'c': m2.c + 5, 'a': m2.a || 'I'} END])
  FROM (
    SELECT g, n, s0, s1, r3, list_min([r2, {'c': s0.c + 5, 'a': s0.a || 'I'}, CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 5, 'a': s1.a || 'I'} END, CASE WHEN r3 IS NOT NULL THEN {'c': r3.c + 5, 'a': r3.a || 'I'} END]) AS m2
    FROM (
      SELECT s.g, m.n, {'c': s0.c + 2, 'a': s0.a || 'D'} AS s0,
        list_min([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D'} END, CASE WHEN NOT must_go AND i = 's' THEN {'c': s0.c + extra, 'a': s0.a || 'K'} END]) AS s1,
        list_min([CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'D'} END,
          CASE WHEN NOT must_go THEN list_min([{'c': s0.c + extra + (i <> 'u')::INT, 'a': s0.a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END},
            CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + extra + (i <> 'u')::INT, 'a': s1.a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END} END,
            CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + extra + (i <> 'u')::INT, 'a': s3.a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END} END]) END]) AS r2,
        list_min([CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 2, 'a': s3.a || 'D'} END,
          CASE WHEN NOT must_go AND s2 IS NOT NULL THEN {'c': s2.c + extra + (i <> 'a')::INT, 'a': s2.a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END} END]) AS r3
      FROM states s JOIN moves m ON m.g = s.g AND m.n = s.n + 1
    )
  )
), best AS (
  SELECT s.g, list_min([s0, s3]) AS b FROM states s JOIN stats t ON t.g = s.g AND t.rows = s.n
), letters AS (
  SELECT g, unnest(range(1, length(b.a) + 1)) AS p, b.a AS audit FROM best
), edits AS (
  SELECT g, p, audit[p] AS e, sum((audit[p] <> 'I')::INT) OVER w AS n, sum((audit[p] <> 'D')::INT) OVER w AS step FROM letters WINDOW w AS (PARTITION BY g ORDER BY p)
), turns AS (
  SELECT x.g, p, e, step, j.role, j.text, max((e = 'K' AND step = 1 AND j.i = 's')::INT) OVER (PARTITION BY x.g) AS led
  FROM edits x LEFT JOIN judged j ON x.e <> 'I' AND j.g = x.g AND j.n = x.n
), repaired AS (
  SELECT g, string_agg(CASE WHEN e = 'K' THEN role WHEN (step - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM turns WHERE e <> 'D' GROUP BY g
), told AS (
  SELECT (SELECT any_value(conv_id) FROM judged j WHERE j.g = t.g) AS conv_id, t.*, b.b.c::BIGINT AS cost, b.b.a AS audit, sha256(coalesce(r.t, '')) AS repaired_sha256
  FROM stats t JOIN best b USING (g) LEFT JOIN repaired r USING (g)
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL["op11_suffix_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents
), grams AS (
  SELECT k, doc_id, p, b[p:p + 49] AS s FROM (SELECT k, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS p FROM d)
), first AS (
  SELECT s, min(doc_id) AS least FROM grams GROUP BY s HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT k, p FROM grams JOIN first USING (s) WHERE doc_id > least
), ends AS (
  SELECT k, p, coalesce(p > max(p + 50) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM hits
), numbered AS (
  SELECT k, p, sum(new::INT) OVER (PARTITION BY k ORDER BY p) AS n FROM ends
), spans AS (
  SELECT k, n, min(p) AS a, max(p) + 49 AS z FROM numbered GROUP BY k, n
), kept AS (
  SELECT k, coalesce(lag(z) OVER (PARTITION BY k ORDER BY n), 0) + 1 AS a, a - 1 AS z, n FROM spans
  UNION ALL SELECT k, max(z) + 1, 9000000000, max(n) + 1 FROM spans GROUP BY k
), text AS (
  SELECT k, string_agg(hex(b[a:z]), '' ORDER BY n) FILTER (z >= a) AS t FROM kept JOIN d USING (k) GROUP BY k
), counts AS (
  SELECT k, sum(z - a + 1)::BIGINT AS removed, count(*) AS n FROM spans GROUP BY k
)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b ELSE unhex(coalesce(t, '')) END) AS kept_sha256
FROM d LEFT JOIN counts USING (k) LEFT JOIN text USING (k)
"""
