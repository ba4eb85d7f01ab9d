"""Inputs made from the star-schema tables, in SQL that Spark and DuckDB both read, and DuckDB SQL for each query."""

from __future__ import annotations

from kinfold.functions.normalize import COUNTRIES, OPEN_DATES, SKILLS, meanings, month_numbers

#: Raw values by table: query -> (table, key, expression).
RAW = {
    "norm_phone": ("customer", "c_custkey", "CASE c_custkey % 6 WHEN 0 THEN '98' || lpad(cast(c_custkey AS string), 8, '0') WHEN 1 THEN ' +1 (415) ' || lpad(cast(c_custkey AS string), 7, '0') WHEN 2 THEN '1415' || lpad(cast(c_custkey AS string), 7, '0') WHEN 3 THEN 'ext ' || cast(c_custkey % 1000 AS string) WHEN 4 THEN '(044) ' || lpad(cast(c_custkey AS string), 9, '0') END"),
    "norm_email": ("customer", "c_custkey", "CASE c_custkey % 5 WHEN 0 THEN '  U' || cast(c_custkey AS string) || '@Example.COM ' WHEN 1 THEN 'plain' || cast(c_custkey AS string) WHEN 2 THEN 'a@b@c' || cast(c_custkey AS string) || '.org' WHEN 3 THEN 'x@localhost' END"),
    "norm_name": ("supplier", "s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN '  ' || lower(s_name) || '   o''BRIEN  ' WHEN 1 THEN upper(s_name) WHEN 2 THEN 'x' END"),
    "norm_skill": ("part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN ' K8S ' WHEN 1 THEN 'node.js' WHEN 2 THEN 'Ms Sql' WHEN 3 THEN p_type WHEN 4 THEN lower(p_brand) ELSE 'sklearn' END"),
    "norm_country": ("nation", "n_nationkey", "CASE n_nationkey % 3 WHEN 0 THEN ' ' || lower(n_name) || ' ' WHEN 1 THEN substring(n_name, 1, 2) ELSE n_name END"),
    "norm_date": ("orders", "o_orderkey", "CASE o_orderkey % 8 WHEN 0 THEN cast(year(o_orderdate) AS string) || '/' || cast(month(o_orderdate) AS string) WHEN 1 THEN cast(month(o_orderdate) AS string) || '-' || cast(year(o_orderdate) AS string) WHEN 2 THEN 'March ' || cast(year(o_orderdate) AS string) WHEN 3 THEN cast(year(o_orderdate) AS string) || ', sep' WHEN 4 THEN ' ' || cast(year(o_orderdate) AS string) WHEN 5 THEN 'Sept ' || cast(year(o_orderdate) AS string) WHEN 6 THEN 'Present' END"),
    "parse_years": ("part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN cast(p_size AS string) || ' years' WHEN 1 THEN 'about ' || cast(p_size AS string) || '.5' ELSE p_name END"),
    "split_skills": ("part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN p_brand || ' , ' || p_type || ',,' WHEN 1 THEN p_brand || ';' || p_type WHEN 2 THEN p_brand || '|' || p_type ELSE ' ' || p_name END"),
}


def _raw(name: str) -> str:
    source, key, expression = RAW[name]
    return f"(SELECT {key} AS id, {expression} AS raw FROM {source})"


def _case(value: str, entries: dict[str, str]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {value} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in entries.items()) + " END"


#: Title case of a DuckDB expression: runs of letters, and what lies between them.
def title_sql(value: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({value}), '\\p{{L}}+|\\P{{L}}+'), lambda r: CASE r[1] WHEN 'ß' THEN 'Ss' ELSE upper(r[1]) END || r[2:]), '')"


EMAIL, PHONE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"\+?\d[\d\s\-().]{7,}\d"

#: Profiles: customers as one source, suppliers as another; e-mails tie three neighbours, phones tie two such groups, suppliers join some.
PROFILES = """
SELECT c_custkey * 2 AS ord, 'csv' AS source, 'customer_row' || cast(c_custkey AS string) AS candidate_id, c_name AS full_name,
  CASE WHEN c_custkey % 9 <> 4 THEN 'u' || cast(c_custkey - c_custkey % 3 AS string) || '@example.com' END AS email,
  CASE WHEN c_custkey % 12 IN (2, 3) THEN '+9198' || lpad(cast(c_custkey - c_custkey % 4 AS string), 8, '0') END AS phone,
  CASE WHEN c_custkey % 2 = 0 THEN 'City' || cast(c_custkey % 10 AS string) END AS city, cast(NULL AS string) AS region, CASE WHEN c_custkey % 3 <> 0 THEN 'IN' END AS country,
  CASE WHEN c_custkey % 2 = 1 THEN 'in/' || cast(c_custkey AS string) END AS linkedin, cast(NULL AS string) AS github,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS headline, cast(c_custkey % 11 AS double) AS years_experience,
  c_mktsegment AS skill, cast(0.9 AS double) AS skill_confidence, 'Co' || cast(c_custkey % 3 AS string) AS company, 'Dev' AS title,
  CASE WHEN c_custkey % 5 = 0 THEN '2020-01' END AS start, cast(c_custkey % 4 AS double) / 4 AS confidence
FROM customer
UNION ALL
SELECT s_suppkey * 2 + 1, 'ats_json', 'supplier_ats_' || cast(s_suppkey AS string), s_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'u' || cast(s_suppkey * 3 AS string) || '@example.com' END, cast(NULL AS string),
  cast(NULL AS string), 'R' || cast(s_suppkey % 5 AS string), 'US', cast(NULL AS string), 'gh/' || cast(s_suppkey AS string),
  'Supplier ' || cast(s_suppkey AS string), cast(NULL AS double), CASE WHEN s_suppkey % 3 = 0 THEN 'AUTOMOBILE' ELSE 'Logistics' END, cast(0.85 AS double),
  'co' || cast(s_suppkey % 3 AS string), 'dev ', '2019', cast(0.5 AS double)
FROM supplier
"""

#: Clusters in SQL: p (profiles), labels, m (profiles with label, size and rank of the source).
CLUSTERED = f"""
WITH RECURSIVE p AS ({PROFILES}), keys AS (
  SELECT ord, 'email:' || email AS key FROM p WHERE email IS NOT NULL UNION SELECT ord, 'phone:' || phone FROM p WHERE phone IS NOT NULL
), edges AS (
  SELECT DISTINCT a.ord AS u, b.ord AS v FROM keys a JOIN keys b ON a.key = b.key
), reach AS (
  SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
), labels AS (
  SELECT p.ord, coalesce(min(v), p.ord) AS label FROM p LEFT JOIN reach ON u = p.ord GROUP BY p.ord
), m AS (
  SELECT p.*, label, count(*) OVER (PARTITION BY label) AS size, CASE source WHEN 'ats_json' THEN 0 ELSE 1 END AS rank FROM p JOIN labels ON p.ord = labels.ord
)
"""
WINNER_ORDER = "ORDER BY confidence DESC, rank, m.ord"

ORACLE_SQL: dict[str, str] = {
    "norm_phone": f"""
      WITH k AS (SELECT id, raw, trim(raw) AS s, regexp_replace(raw, '[^0-9+]', '', 'g') AS kept FROM {_raw("norm_phone")}),
      f AS (SELECT id, raw, CASE WHEN starts_with(s, '+') THEN kept WHEN length(kept) = 10 THEN '+91' || kept WHEN length(kept) > 7 THEN '+' || kept END AS full_number FROM k)
      SELECT id, raw, CASE WHEN length(ltrim(full_number, '+')) BETWEEN 7 AND 15 THEN full_number END AS phone FROM f""",
    "norm_email": f"""
      SELECT id, raw, CASE WHEN contains(raw, '@') AND contains(string_split(raw, '@')[-1], '.') THEN lower(trim(raw)) END AS email FROM {_raw("norm_email")}""",
    "norm_name": f"""
      SELECT id, raw, CASE WHEN length(n) >= 2 THEN {title_sql("n")} END AS name FROM (SELECT id, raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS n FROM {_raw("norm_name")})""",
    "norm_skill": f"""
      SELECT id, raw, coalesce({_case("lower(trim(raw))", meanings(SKILLS))}, {title_sql("trim(raw)")}) AS skill FROM {_raw("norm_skill")}""",
    "norm_country": f"""
      SELECT id, raw, coalesce({_case("lower(trim(raw))", meanings(COUNTRIES))}, CASE WHEN regexp_full_match(trim(raw), '[A-Za-z]{{2}}') THEN upper(trim(raw)) END) AS country FROM {_raw("norm_country")}""",
    "norm_date": f"""
      WITH s AS (SELECT id, raw, trim(raw) AS s FROM {_raw("norm_date")}),
      g AS (SELECT *, regexp_extract(s, '^(\\d{{4}})[/.-](\\d{{1,2}})$', ['y', 'm']) AS a, regexp_extract(s, '^(\\d{{1,2}})[/.-](\\d{{4}})$', ['m', 'y']) AS b,
        regexp_extract(s, '^([A-Za-z]+)[,\\s]+(\\d{{4}})$', ['m', 'y']) AS c, regexp_extract(s, '^(\\d{{4}})[,\\s]+([A-Za-z]+)$', ['y', 'm']) AS d FROM s)
      SELECT id, raw, CASE WHEN lower(s) IN ({", ".join("'" + x + "'" for x in OPEN_DATES)}) THEN NULL WHEN a.y <> '' THEN a.y || '-' || lpad(a.m, 2, '0') WHEN b.y <> '' THEN b.y || '-' || lpad(b.m, 2, '0')
        WHEN {_case("lower(c.m)", month_numbers())} IS NOT NULL THEN c.y || '-' || {_case("lower(c.m)", month_numbers())}
        WHEN {_case("lower(d.m)", month_numbers())} IS NOT NULL THEN d.y || '-' || {_case("lower(d.m)", month_numbers())}
        WHEN regexp_full_match(s, '\\d{{4}}') THEN s END AS date FROM g""",
    "parse_years": f"SELECT id, raw, try_cast(regexp_extract(raw, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS years FROM {_raw('parse_years')}",
    "split_skills": f"""
      SELECT id, raw, array_to_string(list_filter(list_transform(string_split(raw, CASE WHEN contains(raw, ',') THEN ',' WHEN contains(raw, ';') THEN ';' WHEN contains(raw, '|') THEN '|' ELSE chr(0) END), lambda x: trim(x)), lambda x: x <> ''), '/') AS skills
      FROM {_raw("split_skills")}""",
    "doc_contacts": f"""
      SELECT doc_id, nullif(regexp_extract(text, '{EMAIL}'), '') AS email,
        coalesce(nullif(regexp_extract(array_to_string(string_split(text, chr(10))[1:15], chr(10)), '{PHONE}'), ''), nullif(regexp_extract(text, '{PHONE}'), '')) AS phone FROM documents""",
    "doc_top_lines": "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:15], '|') AS top FROM documents",
    "json_probe": """
      SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events""",
    "language_skills": """
      WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS pos FROM events WHERE event_type <> 'view' GROUP BY ALL),
      c AS (SELECT *, least(0.95::DOUBLE, 0.5::DOUBLE + 0.45::DOUBLE * (n / sum(n) OVER (PARTITION BY user_id))) AS c FROM n)
      SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY n DESC, pos) - 1)::INT AS place, upper(event_type[1]) || event_type[2:] AS name, format('{:.2f}', c) AS confidence FROM c""",
    "union_sources": f"SELECT ord, source, candidate_id FROM ({PROFILES})",
    "match_keys": f"{CLUSTERED} SELECT ord, key FROM keys",
    "key_hubs": f"{CLUSTERED} SELECT DISTINCT ord AS u, min(ord) OVER (PARTITION BY key) AS v FROM keys QUALIFY u <> v",
    "clusters": f"{CLUSTERED} SELECT ord, label FROM labels",
    "merge_scalars": f"""{CLUSTERED}
      SELECT label AS ord, coalesce(first(candidate_id ORDER BY m.ord)) AS candidate_id, first(full_name {WINNER_ORDER}) AS full_name, first(headline {WINNER_ORDER}) FILTER (WHERE headline <> '') AS headline,
        CASE WHEN any_value(size) = 1 THEN any_value(years_experience) ELSE first(years_experience {WINNER_ORDER}) FILTER (WHERE years_experience <> 0) END AS years_experience
      FROM m GROUP BY label""",
    "merge_contacts": f"""{CLUSTERED},
      e AS (SELECT label, string_agg(email, '/' ORDER BY o) AS emails FROM (SELECT label, email, min(ord) AS o FROM m WHERE email IS NOT NULL GROUP BY ALL) GROUP BY label),
      t AS (SELECT label, string_agg(phone, '/' ORDER BY o) AS phones FROM (SELECT label, phone, min(ord) AS o FROM m WHERE phone IS NOT NULL GROUP BY ALL) GROUP BY label)
      SELECT l.label AS ord, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones FROM (SELECT DISTINCT label FROM m) l LEFT JOIN e ON l.label = e.label LEFT JOIN t ON l.label = t.label""",
    "merge_location": f"""{CLUSTERED}
      SELECT label AS ord, coalesce(first(city {WINNER_ORDER}), first(city ORDER BY m.ord) FILTER (WHERE city IS NOT NULL)) AS city, coalesce(first(region {WINNER_ORDER}), first(region ORDER BY m.ord) FILTER (WHERE region IS NOT NULL)) AS region,
        coalesce(first(country {WINNER_ORDER}), first(country ORDER BY m.ord) FILTER (WHERE country IS NOT NULL)) AS country FROM m GROUP BY label""",
    "merge_links": f"""{CLUSTERED}
      SELECT label AS ord, first(linkedin ORDER BY m.ord) FILTER (WHERE linkedin IS NOT NULL) AS linkedin, first(github ORDER BY m.ord) FILTER (WHERE github IS NOT NULL) AS github FROM m GROUP BY label""",
    "merge_skills": f"""{CLUSTERED},
      n AS (SELECT label, skill, max(skill_confidence) AS c FROM m GROUP BY ALL)
      SELECT label AS ord, string_agg(skill, '/' ORDER BY c DESC, skill) AS skills FROM n GROUP BY label""",
    "merge_experience": f"""{CLUSTERED},
      r AS (SELECT label, lower(trim(company)) AS k1, lower(trim(title)) AS k2, first(company || '@' || coalesce(start, '') ORDER BY start IS NULL, m.ord) AS e, min(m.ord) AS o FROM m GROUP BY ALL)
      SELECT label AS ord, string_agg(e, '/' ORDER BY o) AS experience FROM r GROUP BY label""",
    "merge_confidence": f"""{CLUSTERED},
      a AS (SELECT label, count(*) AS n, avg(confidence) AS mean, 1 + 1 + 1 + 1 + max((email IS NOT NULL)::INT) + max((phone IS NOT NULL)::INT) + max((headline IS NOT NULL)::INT) + max((linkedin IS NOT NULL OR github IS NOT NULL)::INT) AS filled FROM m GROUP BY label)
      SELECT label AS ord, round(least(1.0, 0.6::DOUBLE * mean + 0.4::DOUBLE * (filled / 9.0::DOUBLE) + least(0.1::DOUBLE, 0.02::DOUBLE * (n - 1))), 3) AS overall_confidence FROM a""",
    "project_custom": f"""{CLUSTERED},
      e AS (SELECT label, first(email ORDER BY ord) FILTER (WHERE email IS NOT NULL) AS primary_email, first(phone ORDER BY ord) FILTER (WHERE phone IS NOT NULL) AS phone FROM m GROUP BY label),
      w AS (SELECT label, first(full_name {WINNER_ORDER}) AS full_name FROM m GROUP BY label)
      SELECT e.label AS ord, full_name, primary_email, phone FROM e JOIN w ON e.label = w.label WHERE primary_email IS NOT NULL AND full_name <> ''""",
    "header_alias": """
      SELECT c_custkey AS id, nullif(trim(coalesce(CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE c_mktsegment END, '')), '') AS first_title,
        coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE c_mktsegment END), ''), CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END) AS title FROM customer""",
    "section_split": """
      SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g') AS header, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS experience FROM documents""",
    "project_index": f"""{CLUSTERED},
      e AS (SELECT label, list(email ORDER BY o) AS l FROM (SELECT label, email, min(ord) AS o FROM m WHERE email IS NOT NULL GROUP BY ALL) GROUP BY label),
      n AS (SELECT label, skill, max(skill_confidence) AS c FROM m GROUP BY ALL)
      SELECT n.label AS ord, any_value(l[2]) AS second_email, first(skill ORDER BY c DESC, skill) AS top_skill FROM n LEFT JOIN e ON n.label = e.label GROUP BY n.label""",
}

ORACLE_SQL["probe_paths"] = """
SELECT c_custkey AS id,
  CASE c_custkey % 7 WHEN 0 THEN '"c' || c_custkey || '"' WHEN 1 THEN '"a' || c_custkey || '"' WHEN 2 THEN c_custkey::VARCHAR WHEN 3 THEN '["p' || c_custkey || '","q"]' END AS email,
  CASE c_custkey % 7 WHEN 4 THEN '"f' || c_custkey || ' L"' WHEN 5 THEN '"F' || c_custkey || '"' WHEN 6 THEN '"n' || c_custkey || '"' END AS full_name
FROM customer
"""

_NORMALIZED = {"norm_phone": "phone", "norm_email": "email", "norm_name": "name", "norm_skill": "skill", "norm_country": "country", "norm_date": "date", "parse_years": "years", "split_skills": "skills"}
ORACLE_SQL["sql_functions"] = " UNION ALL ".join(f"SELECT '{name}' AS function, id, {column}::VARCHAR AS value FROM ({ORACLE_SQL[name]})" for name, column in _NORMALIZED.items())
