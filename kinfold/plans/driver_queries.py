"""Registered queries of the engine over the driver's tables; driver_sql has the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normalize, sql, text
from kinfold.operators import matching, project, survivorship
from kinfold.plans import merge_queries, reader_queries
from kinfold.plans.config import PRESETS
from kinfold.plans.driver_sql import PROFILES, RAW
from kinfold.schema import EDUCATION, EXPERIENCE, FIELDS, LINKS, LOCATION, PROVENANCE, SKILL, as_list, empty
from kinfold.scratch import Scratch
from kinfold.sources import ats_json, csv, github, resume

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scalar(name: str, column: str, fn: Callable[[Column], Column]) -> Query:
    source, key, expression = RAW[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = _table(spark, sf_dir, source).select(F.col(key).alias("id"), F.expr(expression).alias("raw"))
        return raw.withColumn(column, fn(F.col("raw")))

    return query


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived profiles as canonical records with ord."""
    rows = spark.sql(PROFILES.replace("FROM customer", "FROM {customer}").replace("FROM supplier", "FROM {supplier}"), customer=_table(spark, sf_dir, "customer"), supplier=_table(spark, sf_dir, "supplier"))
    null = F.lit(None).cast("string")
    linked = F.coalesce("linkedin", "github").isNotNull()
    made = {
        "emails": as_list(F.col("email"), "string"),
        "phones": as_list(F.col("phone"), "string"),
        "location": F.struct("city", "region", "country").cast(LOCATION),
        "links": F.when(linked, F.struct("linkedin", "github", null.alias("portfolio"), empty("string").alias("other")).cast(LINKS)),
        "skills": F.array(F.struct(F.col("skill").alias("name"), F.col("skill_confidence").alias("confidence"), F.array("source").alias("sources"))).cast(f"array<{SKILL}>"),
        "experience": F.array(F.struct("company", "title", "start", null.alias("end"), null.alias("summary"))).cast(f"array<{EXPERIENCE}>"),
        "education": empty(EDUCATION),
        "provenance": F.array(F.struct(F.lit("full_name").alias("field"), "source", F.lit("direct").alias("method"))).cast(f"array<{PROVENANCE}>"),
        "overall_confidence": F.col("confidence"),
    }
    return rows.select(*(made[f].alias(f) if f in made else F.col(f) for f in FIELDS), F.col("ord").cast("long").alias("ord"))


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("ord", survivorship.source_tag().alias("source"), "candidate_id")


def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_keys(profiles(spark, sf_dir))


def key_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.key_hubs(match_keys(spark, sf_dir)).distinct()


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.clusters(profiles(spark, sf_dir), Scratch(spark, "query")).select("ord", "label")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "query")
    return survivorship.merge(scratch.save(matching.clusters(profiles(spark, sf_dir), scratch), "clustered"))


def _merged(columns: Callable[[], list[Column | str]]) -> Query:
    return lambda spark, sf_dir: merged(spark, sf_dir).select("ord", *columns())


def names_of(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x["name"]), "/")


def header_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two headers that mean the title, the first often blank."""
    first, second = F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", first.alias("Job Title"), second.alias("ROLE"))
    return rows.select(F.col("c_custkey").alias("id"), text.text_or_null(F.col("Job Title")).alias("first_title"), csv.mapped([(c, F.col(f"`{c}`")) for c in ("Job Title", "ROLE")])["title"].alias("title"))


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line as the header block, then the document under a section header."""
    body = F.concat_ws("\n", F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" Work  Experience : "), "text")
    split = resume.spread(_table(spark, sf_dir, "documents")).select("doc_id", resume.sections(body).alias("s"))
    split = Scratch(spark, "query").save(split, "sections")
    return split.select("doc_id", *(resume.section(F.col("s"), n).alias(n) for n in ("header", "experience")))


INDEXED = {"fields": [{"path": "second_email", "from": "emails[1]", "type": "string"}, {"path": "top_skill", "from": "skills[0].name"}]}


def project_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.project(merged(spark, sf_dir), INDEXED)


def project_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.project(merged(spark, sf_dir), PRESETS["custom"]).select("ord", "full_name", "primary_email", "phone")


def project_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default configuration over all derived profiles; nested, so without an equivalent in SQL."""
    return project.project(merged(spark, sf_dir), PRESETS["default"])


def doc_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resume.contacts(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", found["email"].alias("email"), found["phone"].alias("phone"))


def doc_top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, resume.TOP_LINES), "|").alias("top"))


def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read as a resume."""
    at = F.struct(F.lit("documents").alias("file"), F.lit(0).alias("start"), F.col("doc_id").alias("pos"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), "text", at.alias("at"))
    found = resume.profiles(docs, 2024)
    return found.select("candidate_id", "full_name", "headline", *(F.array_join(c, "/").alias(c) for c in ("emails", "phones")), F.round("overall_confidence", 6).alias("overall_confidence"))


def json_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return parsed.select("event_id", F.coalesce(ats_json.as_text(ats_json.at(F.col("v"), "k")), F.lit("")).alias("k"))


#: Objects in which an e-mail address stands in several places, or none that counts; {k} is a key.
PROBED = (
    '{"applicant": {"email": ""}, "contact": {"email": "c{k}"}, "email": "e{k}"}', '{"candidate": {"emailAddress": []}, "email_address": "a{k}"}', '{"applicant": {"email": null, "emailAddress": {k}}}',
    '{"person": {"email": ["p{k}", "q"]}, "email": "e{k}"}', '{"applicant": "no object", "firstName": " f{k} ", "last_name": "L"}', '{"applicant": {"firstName": "F{k}"}, "lastName": "", "name": "n"}', '{"name": "n{k}"}',
)


def probe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable value along the paths of two fields: empty ones are passed over, a list is taken as it is, two names are joined."""
    made = F.replace(F.get(F.array(*map(F.lit, PROBED)), (F.col("c_custkey") % len(PROBED)).cast("int")), F.lit("{k}"), F.col("c_custkey").cast("string"))
    parsed = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.try_parse_json(made).alias("v"))
    return parsed.select("id", *(F.to_json(ats_json.probe(F.col("v"), field)).alias(field) for field in ("email", "full_name")))


def language_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as languages of a user's repositories ("view" marks forks)."""
    own = _table(spark, sf_dir, "events").filter("event_type <> 'view'")
    counted = own.groupBy("user_id", F.col("event_type").alias("lang")).agg(F.count("*").alias("n"), F.min("event_id").alias("pos"))
    found = github.counted_skills(counted, "user_id")
    return found.select("user_id", F.posexplode("langs").alias("place", "s")).select("user_id", "place", "s.name", F.format_number("s.confidence", 2).alias("confidence"))


#: SQL functions by the query of the Column function that they equal, and the column that it returns.
SQL_FUNCTIONS = {
    "norm_phone": ("normalize_phone(raw)", "phone"), "norm_email": ("normalize_email(raw)", "email"), "norm_name": ("normalize_name(raw)", "name"), "norm_skill": ("normalize_skill(raw)", "skill"),
    "norm_country": ("normalize_country(raw)", "country"), "norm_date": ("normalize_date(raw)", "date"), "parse_years": ("parse_years(raw)", "years"), "split_skills": ("array_join(split_skills(raw), '/')", "skills"),
}


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalisers called from SQL text, over the same texts as the queries of the Column functions."""
    sql.register(spark)
    parts = [f"SELECT '{name}' AS function, {key} AS id, cast({call} AS string) AS value FROM (SELECT {key}, {RAW[name][2]} AS raw FROM {{{RAW[name][0]}}})" for name, (call, _) in SQL_FUNCTIONS.items() for key in [RAW[name][1]]]
    tables = {RAW[name][0] for name in SQL_FUNCTIONS}
    return spark.sql(" UNION ALL ".join(parts), **{t: _table(spark, sf_dir, t) for t in tables})


QUERIES: dict[str, Query] = {
    "sql_functions": sql_functions,
    "norm_phone": _scalar("norm_phone", "phone", normalize.phone),
    "norm_email": _scalar("norm_email", "email", normalize.email),
    "norm_name": _scalar("norm_name", "name", normalize.name),
    "norm_skill": _scalar("norm_skill", "skill", normalize.skill),
    "norm_country": _scalar("norm_country", "country", normalize.country),
    "norm_date": _scalar("norm_date", "date", normalize.date),
    "parse_years": _scalar("parse_years", "years", normalize.years),
    "split_skills": _scalar("split_skills", "skills", lambda c: F.array_join(text.split_list(c), "/")),
    "doc_contacts": doc_contacts,
    "doc_top_lines": doc_top_lines,
    "resume_profiles": resume_profiles,
    "json_probe": json_probe,
    "probe_paths": probe_paths,
    "language_skills": language_skills,
    "union_sources": union_sources,
    "match_keys": match_keys,
    "key_hubs": key_hubs,
    "clusters": clusters,
    "merge_scalars": _merged(lambda: ["candidate_id", "full_name", "headline", "years_experience"]),
    "merge_contacts": _merged(lambda: [F.array_join("emails", "/").alias("emails"), F.array_join("phones", "/").alias("phones")]),
    "merge_location": _merged(lambda: ["location.city", "location.region", "location.country"]),
    "merge_links": _merged(lambda: ["links.linkedin", "links.github"]),
    "merge_skills": _merged(lambda: [names_of("skills").alias("skills")]),
    "merge_experience": _merged(lambda: [F.array_join(F.transform("experience", lambda e: F.concat(e["company"], F.lit("@"), F.coalesce(e["start"], F.lit("")))), "/").alias("experience")]),
    "merge_confidence": _merged(lambda: ["overall_confidence"]),
    "header_alias": header_alias,
    "section_split": section_split,
    "project_index": project_index,
    "project_custom": project_custom,
    "project_default": project_default,
}


QUERIES |= reader_queries.QUERIES | merge_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole derived pipeline with the custom configuration."""
    return project.project(merged(spark, sf_dir), PRESETS["custom"])
