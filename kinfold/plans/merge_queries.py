"""Queries over merged records with links, education and provenance, the JSON sink and configurations, with DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normalize
from kinfold.operators import matching, project, rejects, survivorship
from kinfold.plans import config as configs
from kinfold.plans import pipeline
from kinfold.plans.driver_sql import CLUSTERED, title_sql
from kinfold.plans.reader_queries import joined
from kinfold.schema import EDUCATION, FIELDS, LINKS, PROVENANCE
from kinfold.scratch import Scratch
from kinfold.sources import json_parts
from kinfold.sources.inputs import Extracted

Query = Callable[[SparkSession, str], DataFrame]

# What the derived profiles do not have, from their position; in SQL that Spark and DuckDB both read.
PORTFOLIO = "CASE WHEN ord % 5 = 1 THEN 'site/' || cast(ord AS string) END"
OTHER = ("CASE WHEN ord % 4 = 0 THEN 'o' || cast(ord % 6 AS string) END", "CASE WHEN ord % 3 = 0 THEN 'z' END")
METHOD = "CASE WHEN ord % 3 = 0 THEN 'inferred' ELSE 'direct' END"


def _entry(n: int) -> tuple[str, str, str, str]:
    """Institution, degree, field and year of the n-th education entry of a profile."""
    x = f"(ord + {n})"
    return (
        f"CASE WHEN {x} % 2 = 0 THEN 'School' ELSE 'school ' END",
        f"CASE {x} % 4 WHEN 1 THEN 'BSc' WHEN 2 THEN 'MSc Hons' WHEN 3 THEN 'bsc x' END",
        f"CASE WHEN {x} % 3 = 0 THEN 'F' END",
        f"CASE WHEN {x} % 5 < 2 THEN 2000 + cast({x} % 5 AS int) END",
    )


ENTRIES = [_entry(0), _entry(7), _entry(0)]


def rich_profiles(profiles: DataFrame) -> DataFrame:
    source = survivorship.source_tag()
    entries = [F.struct(*(F.expr(e).alias(n) for e, n in zip(entry, ("institution", "degree", "field", "end_year"), strict=True))) for entry in ENTRIES]
    prov = [F.struct(F.lit(f).alias("field"), source.alias("source"), m.alias("method")) for f, m in (("full_name", F.lit("direct")), ("headline", F.expr(METHOD)))]
    made = {
        "links": F.struct(F.col("links.linkedin").alias("linkedin"), F.col("links.github").alias("github"), F.expr(PORTFOLIO).alias("portfolio"), F.filter(F.array(*map(F.expr, OTHER)), lambda x: x.isNotNull()).alias("other")).cast(LINKS),
        "education": F.array(*entries).cast(f"array<{EDUCATION}>"),
        "provenance": F.array(*prov).cast(f"array<{PROVENANCE}>"),
    }
    return profiles.select("ord", *(made[f].alias(f) if f in made else F.col(f) for f in FIELDS))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.plans.driver_queries import profiles

    scratch = Scratch(spark, "query")
    clustered = scratch.save(matching.clusters(rich_profiles(profiles(spark, sf_dir)), scratch), "clustered")
    return survivorship.merge(clustered, scratch)


def education_text() -> Column:
    return joined(F.transform("education", lambda e: F.concat_ws("|", F.trim(F.lower(e["institution"])), *(F.coalesce(e[c].cast("string"), F.lit("")) for c in ("degree", "field", "end_year")))))


def merge_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Education of merged records: entries folded by school, repeats among them."""
    return merged(spark, sf_dir).select("ord", education_text().alias("education"))


def merge_all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("ord", *(F.col(f"links.{c}").alias(c) for c in ("linkedin", "github", "portfolio")), joined(F.col("links.other")).alias("other"))


def merge_skill_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = joined(F.transform("skills", lambda s: F.concat(s["name"], F.lit("="), F.format_number(s["confidence"], 2), F.lit("<"), F.array_join(s["sources"], "+"))))
    return merged(spark, sf_dir).select("ord", text.alias("skills"))


PROVENANCE_FIELDS = ("full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education")


def merge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of merged records, a column for each field, and the order of the fields."""
    own = lambda f: joined(F.transform(F.filter("provenance", lambda p: p["field"] == f), lambda p: F.concat(p["source"], F.lit(":"), p["method"])))
    fields = joined(F.array_distinct(F.transform("provenance", lambda p: p["field"])))
    return merged(spark, sf_dir).select("ord", fields.alias("fields"), *(own(f).alias(f) for f in PROVENANCE_FIELDS))


def project_default_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default configuration over all merged records, nested values as columns and lists as text."""
    out = project.project(merged(spark, sf_dir), configs.PRESETS["default"])
    jobs = joined(F.transform("experience", lambda e: F.concat_ws("|", e["company"], e["title"], F.coalesce(e["start"], F.lit("")))))
    place = [F.col(f"location.{c}").alias(c) for c in ("city", "region", "country")]
    links = [F.col(f"links.{c}").alias(c) for c in ("linkedin", "github", "portfolio")]
    return out.select("ord", "candidate_id", "full_name", joined(F.col("emails")).alias("emails"), joined(F.col("phones")).alias("phones"), *place, *links, "headline", "years_experience", joined(F.col("skills")).alias("skills"), jobs.alias("experience"), education_text().alias("education"), F.size("provenance").alias("sources"), "overall_confidence")


JSON_CONFIG = {
    "fields": [{"path": "who.name", "from": "full_name"}, {"path": "who.mail", "from": "emails[0]", "type": "string"}, {"path": "place.city", "from": "location.city"}, {"path": "years", "from": "years_experience", "type": "number"}, {"path": "skills", "from": "skills[].name"}, {"path": "spot", "from": "location", "type": "string"}],
    "on_missing": "omit",
}


def json_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines; keys without a value are left out, and objects without keys."""
    return project.json_rows(merged(spark, sf_dir), JSON_CONFIG)


def variant_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as VARIANT objects, read back by path; their keys differ."""
    found = project.records(merged(spark, sf_dir), JSON_CONFIG)
    at = lambda path, kind="string": F.try_variant_get("record", path, kind)
    return found.select("ord", at("$.who.name").alias("name"), at("$.who.mail").alias("mail"), at("$.place.city").alias("city"), at("$.years", "double").alias("years"), F.array_join(F.array_sort(F.json_object_keys(F.to_json("record"))), "/").alias("keys"))


def array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records written as one indented array file, and read back from it in parts."""
    scratch = Scratch(spark, "query")
    pipeline.write_array(merged(spark, sf_dir), JSON_CONFIG, f"{scratch.root}/people.json")
    found, bad = json_parts.records(spark, f"{scratch.root}/people.json", scratch, ())
    at = lambda path: F.try_variant_get("v", path, "string")
    return found.select("pos", at("$.who.name").alias("name"), at("$.who.mail").alias("mail"), at("$.spot").alias("spot"), F.lit(bad.count()).alias("bad"))


REJECT_CONFIG = {"fields": [{"path": "mail", "from": "emails[0]", "required": True}, {"path": "phone", "from": "phones[0]"}, {"path": "headline"}], "on_missing": "error"}


def project_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a configuration leaves out, with the first reason, and how many share it."""
    found = project.rejected(merged(spark, sf_dir), REJECT_CONFIG)
    return found.join(F.broadcast(rejects.counted(found)), "reason").select("ord", "reason", "n")


def project_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that have all of three fields, under on_missing "error"."""
    config = {"fields": [{"path": "phone", "from": "phones[0]"}, {"path": "headline"}, {"path": "github", "from": "links.github"}], "on_missing": "error"}
    return project.project(merged(spark, sf_dir), config)


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service's reply about all records, written as one file by the workers and read back in parts."""
    scratch = Scratch(spark, "query")
    people, place = merged(spark, sf_dir), f"{scratch.root}/reply.json"
    pipeline.write_envelope(people, configs.PRESETS["custom"], "custom", Extracted(people, [("notes.txt", "unknown kind")]), place)
    about = spark.read.text(place).filter(F.col("value").startswith("], ")).select(F.from_json(F.regexp_replace("value", r"^\], ", "{"), "count long, skipped_files array<struct<file:string>>, config_used string").alias("a"))
    found, _ = json_parts.records(spark, place, scratch, ("candidates",))
    at = lambda path: F.try_variant_get("v", f"$.{path}", "string").alias(path)
    rows = found.select(at("full_name"), at("primary_email"), at("phone"))
    told = about.select(F.col("a.count").alias("count"), F.col("a.config_used").alias("config"), F.col("a.skipped_files")[0]["file"].alias("skipped"))
    return rows.crossJoin(F.broadcast(told))  # told is one row


#: Configurations with problems of every kind, as JSON text; {k} is a key of the table, {n} another.
CONFIG_TEXTS = (
    "[]", "{}", '{"fields": []}', '{"fields": [{k}]}', '{"fields": [{"path": ""}, {"from": "emails"}]}', '{"fields": [{"path": "f{k}"}, {"path": "f{k}"}]}', '{"fields": [{"path": "f{k}", "type": "list{k}"}]}',
    '{"fields": [{"path": "a", "normalize": "x{k}"}], "on_missing": "drop{k}"}', '{"fields": [{"path": "f{k}"}, {"path": "g{k}", "type": "string", "normalize": "ISO2"}]}',
)


def config_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said about configurations that can't be used, one for each part."""
    texts = F.get(F.array(*map(F.lit, CONFIG_TEXTS)), (F.col("p_partkey") % len(CONFIG_TEXTS)).cast("int"))
    made = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.replace(texts, F.lit("{k}"), F.col("p_partkey").cast("string")).alias("config"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [" / ".join(configs.problems(json.loads(c))) for c in batch["config"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(said, pa.string())], ["id", "problems"])

    return made.mapInArrow(checked, "id long, problems string")


PROBLEMS_EXPECTED = """
SELECT p_partkey AS id, replace(CASE p_partkey % 9 WHEN 0 THEN 'config must be a JSON object' WHEN 3 THEN 'fields[0] must be an object'
  WHEN 4 THEN 'fields[0].path is required and must be a string / fields[1].path is required and must be a string' WHEN 5 THEN 'fields[1].path ''f{k}'' is duplicated'
  WHEN 6 THEN 'fields[0].type ''list{k}'' is not one of [''any'', ''boolean'', ''number'', ''object'', ''string'', ''string[]'']'
  WHEN 7 THEN 'fields[0].normalize ''x{k}'' is not one of [''E164'', ''ISO2'', ''YYYY-MM'', ''canonical''] / on_missing ''drop{k}'' is not one of [''error'', ''null'', ''omit'']'
  WHEN 8 THEN '' ELSE 'config.fields must be a non-empty list' END, '{k}', p_partkey::VARCHAR) AS problems
FROM part
"""


def norm_skill_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of skills, canonical and without repeats."""
    raw = F.array(F.lit("JS"), F.lower("p_brand"), F.lit("javascript"), F.lit(" "), F.upper("p_brand"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), joined(normalize.skills(raw)).alias("skills"))


# Members of clusters with what rich_profiles() adds.
_RICH = f"""{CLUSTERED}, x AS (
  SELECT m.*, {PORTFOLIO} AS portfolio, {METHOD} AS method, list_filter([{", ".join(OTHER)}], lambda x: x IS NOT NULL) AS other FROM m
), first_ AS (
  SELECT label, any_value(size) AS size, first(candidate_id ORDER BY ord) AS candidate_id, first(full_name ORDER BY confidence DESC, rank, ord) AS full_name, first(source ORDER BY confidence DESC, rank, ord) AS best_source,
    first(headline ORDER BY confidence DESC, rank, ord) FILTER (WHERE headline <> '') AS headline, first(source || ':' || method ORDER BY confidence DESC, rank, ord) FILTER (WHERE headline <> '') AS p_headline,
    CASE WHEN any_value(size) = 1 THEN any_value(years_experience) ELSE first(years_experience ORDER BY confidence DESC, rank, ord) FILTER (WHERE years_experience <> 0) END AS years_experience,
    first(source ORDER BY confidence DESC, rank, ord) FILTER (WHERE years_experience <> 0) AS p_years,
    coalesce(first(city ORDER BY confidence DESC, rank, ord), first(city ORDER BY ord) FILTER (WHERE city IS NOT NULL)) AS city, coalesce(first(region ORDER BY confidence DESC, rank, ord), first(region ORDER BY ord) FILTER (WHERE region IS NOT NULL)) AS region,
    coalesce(first(country ORDER BY confidence DESC, rank, ord), first(country ORDER BY ord) FILTER (WHERE country IS NOT NULL)) AS country,
    first(linkedin ORDER BY ord) FILTER (WHERE linkedin IS NOT NULL) AS linkedin, first(github ORDER BY ord) FILTER (WHERE github IS NOT NULL) AS github, first(portfolio ORDER BY ord) FILTER (WHERE portfolio IS NOT NULL) AS portfolio, avg(confidence) AS mean
  FROM x GROUP BY label
), emails AS (
  SELECT label, string_agg(email, '/' ORDER BY o) AS emails, first(email ORDER BY o) AS first_email, list(src ORDER BY o) AS srcs FROM (SELECT label, email, min(ord) AS o, first(source ORDER BY ord) AS src FROM x WHERE email IS NOT NULL GROUP BY label, email) GROUP BY label
), phones AS (
  SELECT label, string_agg(phone, '/' ORDER BY o) AS phones, first(phone ORDER BY o) AS first_phone, list(src ORDER BY o) AS srcs FROM (SELECT label, phone, min(ord) AS o, first(source ORDER BY ord) AS src FROM x WHERE phone IS NOT NULL GROUP BY label, phone) GROUP BY label
), others AS (
  SELECT label, string_agg(v, '/' ORDER BY o, pos) AS other FROM (
    SELECT label, v, (first(ord ORDER BY ord, pos)) AS o, first(pos ORDER BY ord, pos) AS pos FROM (SELECT label, ord, unnest(other) AS v, unnest(range(len(other))) AS pos FROM x) GROUP BY label, v) GROUP BY label
), skill AS (
  SELECT label, skill, max(skill_confidence) AS c, list(source ORDER BY o) AS srcs FROM (SELECT label, skill, source, max(skill_confidence) AS skill_confidence, min(ord) AS o FROM x GROUP BY label, skill, source) GROUP BY label, skill
), skills AS (
  SELECT label, string_agg(skill || '=' || format('{{:.2f}}', c) || '<' || array_to_string(srcs, '+'), '/' ORDER BY c DESC, skill) AS details, flatten(list(srcs ORDER BY c DESC, skill)) AS srcs, list(skill ORDER BY c DESC, skill) AS names FROM skill GROUP BY label
), jobs AS (
  SELECT label, string_agg(e, '/' ORDER BY o) AS experience, list(src ORDER BY o) AS srcs FROM (
    SELECT label, lower(trim(company)) AS k1, lower(trim(title)) AS k2, first(company || '|' || title || '|' || coalesce(start, '') ORDER BY start IS NULL, ord) AS e, first(source ORDER BY start IS NULL, ord) AS src, min(ord) AS o FROM x GROUP BY label, k1, k2) GROUP BY label
), entry AS (
  {" UNION ALL ".join(f"SELECT label, ord, size, source, {n} AS pos, lower(trim({i})) AS school, {d} AS degree, {f} AS field, {y} AS year FROM m" for n, (i, d, f, y) in enumerate(ENTRIES))}
), item AS (
  SELECT *, coalesce(lower(split_part(degree, ' ', 1)), '') AS level, (degree IS NOT NULL)::INT + (field IS NOT NULL)::INT + (year IS NOT NULL)::INT AS rich,
    school || '|' || coalesce(degree, '') || '|' || coalesce(field, '') || '|' || coalesce(year::VARCHAR, '') AS e, row_number() OVER (PARTITION BY label, school ORDER BY ord, pos) AS n FROM entry
), fold AS (
  SELECT label, school, 0::BIGINT AS i, list_filter([{{'level': level, 'rich': rich, 'e': e, 'src': source}}], lambda x: false) AS acc FROM item WHERE n = 1
  UNION ALL
  SELECT label, school, n, CASE WHEN coalesce(place, 0) = 0 THEN list_append(acc, item) WHEN rich > acc[place].rich THEN acc[1:place - 1] || [item] || acc[place + 1:] ELSE acc END FROM (
    SELECT f.label, f.school, t.n, t.rich, f.acc, {{'level': t.level, 'rich': t.rich, 'e': t.e, 'src': t.source}} AS item,
      CASE WHEN t.level = '' THEN list_position(list_transform(f.acc, lambda x: x.rich), list_max(list_transform(f.acc, lambda x: x.rich))) ELSE list_position(list_transform(f.acc, lambda x: x.level = t.level OR x.level = ''), true) END AS place
    FROM fold f JOIN item t ON t.label = f.label AND t.school = f.school AND t.n = f.i + 1)
), folded AS (
  SELECT f.label, f.school, acc, o, p FROM fold f JOIN (SELECT label, school, max(n) AS last, min(ord) AS o, arg_min(pos, ord * 10 + pos) AS p FROM item GROUP BY label, school) l ON f.label = l.label AND f.school = l.school AND f.i = l.last
), schools AS (
  SELECT label, flatten(list(acc ORDER BY o, p)) AS acc FROM folded GROUP BY label
), learnt AS (
  SELECT i.label, CASE WHEN any_value(size) = 1 THEN string_agg(e, '/' ORDER BY ord, pos) ELSE any_value(array_to_string(list_transform(s.acc, lambda x: x.e), '/')) END AS education, any_value(list_transform(s.acc, lambda x: x.src)) AS srcs
  FROM item i JOIN schools s ON i.label = s.label GROUP BY i.label
), brought AS (
  SELECT label, list(source ORDER BY ord, source) AS srcs FROM (
    SELECT label, source, ord FROM (
      SELECT label, source, ord, row_number() OVER (PARTITION BY label ORDER BY ord) AS n FROM x WHERE linkedin IS NOT NULL) WHERE n = 1
    UNION ALL SELECT label, source, ord FROM (SELECT label, source, ord, row_number() OVER (PARTITION BY label ORDER BY ord) AS n FROM x WHERE github IS NOT NULL) WHERE n = 1
    UNION ALL SELECT label, source, ord FROM (SELECT label, source, ord, row_number() OVER (PARTITION BY label ORDER BY ord) AS n FROM x WHERE portfolio IS NOT NULL) WHERE n = 1
    UNION ALL SELECT label, first(source ORDER BY ord), min(ord) FROM (SELECT label, source, ord, unnest(other) AS v FROM x) GROUP BY label, v
  ) GROUP BY label
), scored AS (
  SELECT f.label, round(least(1.0, 0.6::DOUBLE * mean + 0.4::DOUBLE * ((6 + (emails IS NOT NULL)::INT + (phones IS NOT NULL)::INT + (headline IS NOT NULL)::INT) / 9.0::DOUBLE) + least(0.1::DOUBLE, 0.02::DOUBLE * (size - 1))), 3) AS overall_confidence
  FROM first_ f LEFT JOIN emails e ON f.label = e.label LEFT JOIN phones p ON f.label = p.label
)
"""


def _distinct(srcs: str, method: str) -> str:
    """Sources in order, each once, with the method."""
    return f"coalesce(array_to_string(list_transform(list_filter({srcs}, lambda s, i: list_position({srcs}, s) = i), lambda s: s || ':{method}'), '/'), '')"


_PARTS = "FROM first_ f LEFT JOIN emails e ON f.label = e.label LEFT JOIN phones p ON f.label = p.label LEFT JOIN others o ON f.label = o.label LEFT JOIN skills s ON f.label = s.label LEFT JOIN jobs j ON f.label = j.label LEFT JOIN learnt l ON f.label = l.label LEFT JOIN brought b ON f.label = b.label LEFT JOIN scored c ON f.label = c.label"
_PROV = {
    "full_name": "best_source || ':direct'", "emails": _distinct("e.srcs", "direct"), "phones": _distinct("p.srcs", "normalized"), "location": "best_source || ':normalized'", "links": _distinct("b.srcs", "merged"),
    "headline": "coalesce(p_headline, '')", "years_experience": "coalesce(p_years || ':direct', '')", "skills": _distinct("s.srcs", "merged"), "experience": _distinct("j.srcs", "merged"), "education": _distinct("l.srcs", "merged"),
}
_SINGLE = {"full_name": "best_source || ':direct'", "headline": "m1"}

ORACLE_SQL: dict[str, str] = {
    "merge_education": f"{_RICH} SELECT label AS ord, education FROM learnt",
    "merge_all_links": f"{_RICH} SELECT f.label AS ord, linkedin, github, portfolio, coalesce(other, '') AS other {_PARTS}",
    "merge_skill_details": f"{_RICH} SELECT label AS ord, details AS skills FROM skills",
    "merge_provenance": f"""{_RICH}, wide AS (
        SELECT f.label, size, {", ".join(f"CASE WHEN size > 1 THEN {sql} ELSE {_SINGLE[f] if f == 'full_name' else repr('')} END AS {f}" for f, sql in _PROV.items() if f != "headline")},
          CASE WHEN size > 1 THEN {_PROV["headline"]} ELSE (SELECT any_value(source || ':' || method) FROM x WHERE x.label = f.label) END AS headline {_PARTS})
      SELECT label AS ord, array_to_string(list_filter([{", ".join(f"CASE WHEN {f} <> '' THEN '{f}' END" for f in PROVENANCE_FIELDS)}], lambda x: x IS NOT NULL), '/') AS fields, {", ".join(PROVENANCE_FIELDS)} FROM wide""",
    "project_default_text": f"""{_RICH}, wide AS (
        SELECT f.label, f.size, {", ".join(f"{sql} AS p_{f}" for f, sql in _PROV.items())}, f.candidate_id, f.full_name, e.emails, p.phones, city, region, country, linkedin, github, portfolio, headline, years_experience, names, experience, education, overall_confidence {_PARTS})
      SELECT label AS ord, candidate_id, full_name, emails, phones, city, region, country, linkedin, github, portfolio, headline, years_experience,
        array_to_string(list_transform(names, lambda s: {title_sql("s")}), '/') AS skills, experience, education,
        CASE WHEN size = 1 THEN 2 ELSE {" + ".join(f"len(list_filter(string_split(p_{f}, '/'), lambda x: x <> ''))" for f in PROVENANCE_FIELDS)} END::INT AS sources, overall_confidence FROM wide""",
    "json_omit": f"""{_RICH}
      SELECT f.label AS ord, '{{' || array_to_string(list_filter(['"who": {{"name": "' || full_name || '"' || coalesce(', "mail": "' || first_email || '"', '') || '}}', '"place": {{"city": "' || city || '"}}', '"years": ' || years_experience::BIGINT,
        '"skills": ["' || array_to_string(names, '","') || '"]', '"spot": "{{' || replace('"city":' || coalesce('"' || city || '"', 'null') || ',"region":' || coalesce('"' || region || '"', 'null') || ',"country":' || coalesce('"' || country || '"', 'null'), '"', '\\"') || '}}"'], lambda x: x IS NOT NULL), ', ') || '}}' AS json {_PARTS}""",
    "variant_omit": f"""{_RICH}
      SELECT f.label AS ord, full_name AS name, first_email AS mail, city, years_experience::BIGINT::DOUBLE AS years,
        array_to_string(list_filter([CASE WHEN city IS NOT NULL THEN 'place' END, CASE WHEN len(names) > 0 THEN 'skills' END, CASE WHEN city IS NOT NULL OR region IS NOT NULL OR country IS NOT NULL THEN 'spot' END, 'who', CASE WHEN years_experience IS NOT NULL THEN 'years' END], lambda x: x IS NOT NULL), '/') AS keys {_PARTS}""",
    "array_file": f"""{_RICH}
      SELECT row_number() OVER (ORDER BY f.label) - 1 AS pos, full_name AS name, first_email AS mail,
        '{{' || '"city":' || coalesce('"' || city || '"', 'null') || ',"region":' || coalesce('"' || region || '"', 'null') || ',"country":' || coalesce('"' || country || '"', 'null') || '}}' AS spot, 0 AS bad {_PARTS}""",
    "project_rejects": f"""{_RICH}, r AS (SELECT f.label AS ord, CASE WHEN first_email IS NULL THEN 'required field ''mail'' is missing' WHEN first_phone IS NULL THEN 'field ''phone'' is missing' WHEN headline IS NULL THEN 'field ''headline'' is missing' END AS reason {_PARTS})
      SELECT ord, reason, count(*) OVER (PARTITION BY reason) AS n FROM r WHERE reason IS NOT NULL""",
    "project_error": f"{_RICH} SELECT f.label AS ord, first_phone AS phone, headline, github {_PARTS} WHERE first_phone IS NOT NULL AND headline IS NOT NULL AND github IS NOT NULL",
    "envelope": f"""{_RICH}, kept AS (SELECT full_name, first_email AS primary_email, first_phone AS phone {_PARTS} WHERE first_email IS NOT NULL)
      SELECT count(*) OVER () AS count, 'custom' AS config, 'notes.txt' AS skipped, full_name, primary_email, phone FROM kept""",
    "config_problems": PROBLEMS_EXPECTED,
    "norm_skill_list": f"SELECT p_partkey AS id, 'JavaScript/' || {title_sql('p_brand')} AS skills FROM part",
}
QUERIES: dict[str, Query] = {f.__name__: f for f in (merge_education, merge_all_links, merge_skill_details, merge_provenance, project_default_text, json_omit, variant_omit, array_file, project_rejects, project_error, envelope, config_problems, norm_skill_list)}
