"""Nested JSON exports, read as VARIANT and probed along the known paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normalize, text
from kinfold.operators.positions import AT
from kinfold.operators.rejects import rejects
from kinfold.schema import EDUCATION, EXPERIENCE, FIELDS, LINKS, LOCATION, empty, filled, provenance, share
from kinfold.scratch import Scratch
from kinfold.sources import files, json_parts

# Paths of each value, tried in order; "firstName+lastName" joins the two.
PATHS = {
    "full_name": ["applicant.fullName", "applicant.name", "candidate.fullName", "candidate.name", "person.displayName", "person.name", "firstName+lastName", "name", "full_name", "fullName", "displayName"],
    "email": ["applicant.email", "applicant.emailAddress", "candidate.email", "candidate.emailAddress", "contact.email", "person.email", "email", "emailAddress", "email_address"],
    "phone": ["applicant.phone", "applicant.phoneNumber", "candidate.phone", "candidate.phoneNumber", "contact.phone", "person.phone", "phone", "phoneNumber", "phone_number", "mobile", "mobilePhone"],
    "linkedin": ["applicant.linkedinUrl", "candidate.linkedinUrl", "social.linkedin", "links.linkedin", "linkedinUrl", "linkedin_url", "linkedin"],
    "github": ["applicant.githubUrl", "candidate.githubUrl", "social.github", "links.github", "githubUrl", "github_url", "github"],
    "headline": ["applicant.headline", "candidate.headline", "applicant.summary", "candidate.summary", "applicant.bio", "profile.summary", "headline", "summary", "bio", "about"],
    "years_experience": ["applicant.yearsOfExperience", "candidate.yearsOfExperience", "yearsOfExperience", "years_of_experience", "experience_years", "totalExperience", "total_experience"],
    "skills": ["applicant.skills", "candidate.skills", "profile.skills", "skills", "skillSet", "skill_set", "technologies", "techStack"],
    "experience": ["applicant.workHistory", "candidate.workHistory", "applicant.experience", "candidate.experience", "workHistory", "work_history", "employmentHistory", "employment_history", "experience", "positions"],
    "education": ["applicant.education", "candidate.education", "education", "educationHistory", "education_history", "schoolHistory"],
    "city": ["applicant.location.city", "candidate.location.city", "location.city", "address.city", "city"],
    "country": ["applicant.location.country", "candidate.location.country", "location.country", "address.country", "country"],
    "region": ["applicant.location.state", "candidate.location.state", "location.state", "location.region", "address.state", "state", "region"],
    "id": ["applicant.id", "candidate.id", "applicantId", "candidateId", "id", "_id"],
    "first_name": ["applicant.firstName", "candidate.firstName", "firstName", "first_name"],
    "last_name": ["applicant.lastName", "candidate.lastName", "lastName", "last_name"],
}
# Keys under which an export wraps its list, and the names of the parts of list items.
WRAPPERS = ("candidates", "applicants", "results", "data", "records")
ITEM_KEYS = {
    "company": ["company", "employer", "organization", "companyName"],
    "title": ["title", "jobTitle", "position", "role"],
    "start": ["startDate", "start_date", "from", "startYear"],
    "end": ["endDate", "end_date", "to", "endYear"],
    "summary": ["description", "summary", "responsibilities"],
    "institution": ["institution", "school", "university", "college", "name"],
    "degree": ["degree", "qualification"],
    "field": ["field", "fieldOfStudy", "major"],
    "end_year": ["endYear", "graduationYear", "end_year"],
    "skill": ["name", "skill", "label"],
}
SOURCE = "ats_json"
SKILL_CONFIDENCE = 0.85


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")


def json_of(v: Column) -> Column:
    """The JSON text of a value; the word null where there is none."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def probe(v: Column, field: str) -> Column:
    """The first value along the field's paths that is not null, "" or []; no other is tried should it prove unusable."""
    found = []
    for path in PATHS[field]:
        if "+" in path:
            first, last = (F.coalesce(as_text(probe(v, n)), F.lit("")) for n in ("first_name", "last_name"))
            joined = F.struct(text.text_or_null(F.concat_ws(" ", first, last)).alias("n"))
            found.append(at(F.try_parse_json(F.to_json(joined)), "n"))
        else:
            found.append(at(v, path))
    return F.get(F.filter(F.array(*found), lambda x: ~json_of(x).isin("null", '""', "[]")), F.lit(0))


def either(v: Column, part: str) -> Column:
    """The first truthy value under an item's names of a part, as text."""
    values = F.array(*(at(v, key) for key in ITEM_KEYS[part]))
    truthy = F.filter(values, lambda x: ~json_of(x).isin("null", '""', "[]", "{}", "0", "0.0", "false"))
    return F.get(F.transform(F.slice(truthy, 1, 1), as_text), F.lit(0))


def as_text(v: Column) -> Column:
    """Stripped text of a string (null if empty), the digits of a number, True or False; null of lists and objects."""
    j = json_of(v)
    return (
        F.when(F.startswith(j, F.lit('"')), text.text_or_null(v.try_cast("string")))
        .when(j.rlike(r"^-?\d"), j)
        .when(j == "true", "True")
        .when(j == "false", "False")
    )


def items(v: Column) -> Column:
    """The elements of a list; null of anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.startswith(json_of(v), F.lit("{"))


def scalars(v: Column, fn: Callable[[Column], Column]) -> Column:
    """Different results of fn over a list's texts, or over a single value's."""
    return F.coalesce(text.ordered_distinct(F.coalesce(items(v), F.array(v)), lambda x: fn(F.coalesce(as_text(x), F.lit("")))), empty("string"))


def number(v: Column) -> Column:
    t = F.coalesce(as_text(v), F.lit(""))
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.when(t == "True", 1.0).when(t == "False", 0.0).otherwise(plain)


def skill_texts(v: Column) -> Column:
    """Skills as one delimited text, a list of texts, or a list of objects."""
    listed = F.filter(F.transform(items(v), lambda x: F.when(is_object(x), either(x, "skill")).when(F.startswith(json_of(x), F.lit('"')), as_text(x))), lambda s: s.isNotNull())
    one = F.when(F.startswith(json_of(v), F.lit('"')), text.split_list(v.try_cast("string")))
    return F.coalesce(listed, one, empty("string"))


def profiles(records: DataFrame) -> DataFrame:
    """One profile, with at, per object of records (v variant, pos its index in the export, FILE that export)."""
    got = records.filter(is_object(F.col("v")))
    got = got.select("pos", files.FILE, *(probe(F.col("v"), f).alias(f) for f in PATHS if f not in ("first_name", "last_name")))
    v = {c: F.col(c) for c in got.columns}
    job = lambda x: F.struct(*(F.coalesce(either(x, p), F.lit("")).alias(p) for p in ("company", "title")), *(normalize.date(either(x, p)).alias(p) for p in ("start", "end")), either(x, "summary").alias("summary"))
    year = lambda x: F.when(F.substring(either(x, "end_year"), 1, 4).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.substring(either(x, "end_year"), 1, 4)).try_cast("int"))
    school = lambda x: F.struct(*(either(x, p).alias(p) for p in ("institution", "degree", "field")), year(x).alias("end_year"))
    jobs = F.filter(F.transform(F.filter(items(v["experience"]), is_object), job), lambda e: (e["company"] != "") | (e["title"] != ""))
    schools = F.filter(F.transform(F.filter(items(v["education"]), is_object), school), lambda e: e["institution"].isNotNull())
    linkedin, github = as_text(v["linkedin"]), as_text(v["github"])
    city, region, given = as_text(v["city"]), as_text(v["region"]), as_text(v["country"])
    names = F.filter(F.transform(skill_texts(v["skills"]), normalize.skill), lambda s: s != "")
    out = got.select(
        F.coalesce(as_text(v["id"]), F.concat(files.stem(F.col(files.FILE)), F.lit("_ats_"), F.col("pos"))).alias("candidate_id"),
        normalize.name(as_text(v["full_name"])).alias("full_name"),
        scalars(v["email"], normalize.email).alias("emails"),
        scalars(v["phone"], normalize.phone).alias("phones"),
        F.when(F.coalesce(city, region, given).isNotNull(), F.struct(city.alias("city"), region.alias("region"), F.coalesce(normalize.country(given), given).alias("country")).cast(LOCATION)).alias("location"),
        F.when(F.coalesce(linkedin, github).isNotNull(), F.struct(linkedin.alias("linkedin"), github.alias("github"), F.lit(None).cast("string").alias("portfolio"), empty("string").alias("other")).cast(LINKS)).alias("links"),
        as_text(v["headline"]).alias("headline"),
        number(v["years_experience"]).alias("years_experience"),
        F.transform(names, lambda s: F.struct(s.alias("name"), F.lit(SKILL_CONFIDENCE).alias("confidence"), F.array(F.lit(SOURCE)).alias("sources"))).alias("skills"),
        F.coalesce(jobs, empty(EXPERIENCE)).cast(f"array<{EXPERIENCE}>").alias("experience"),
        F.coalesce(schools, empty(EDUCATION)).cast(f"array<{EDUCATION}>").alias("education"),
        F.struct(F.col(files.FILE).alias("file"), F.lit(0).alias("start"), "pos").cast(AT).alias("at"),
    )
    has = {c: F.col(c).isNotNull() for c in ("full_name", "location", "links", "headline", "years_experience")} | {c: filled(F.col(c)) for c in ("emails", "phones", "skills", "experience", "education")}
    entries = [("full_name", "direct"), ("emails", "direct"), ("phones", "normalized"), ("links", "direct"), ("headline", "direct"), ("years_experience", "direct"), ("skills", "normalized"), ("experience", "normalized"), ("education", "normalized"), ("location", "normalized")]
    out = out.withColumn("provenance", provenance(SOURCE, *((f, has[f], how) for f, how in entries)))
    out = out.withColumn("overall_confidence", share([has[c] for c in ("full_name", "emails", "phones", "location", "skills", "experience")]))
    return out.select(*FIELDS, "at")


def records(texts: DataFrame, column: str = "value") -> DataFrame:
    """FILE, v and pos of each record of whole exports: a list, an object that wraps a list, or one object; other texts give none."""
    doc = F.try_parse_json(F.regexp_replace(F.col(column), "^﻿", ""))
    parsed = texts.select(files.FILE, doc.alias("doc"))
    wrapped = F.coalesce(*(items(at(F.col("doc"), key)) for key in WRAPPERS))
    listed = F.coalesce(items(F.col("doc")), F.when(is_object(F.col("doc")), F.coalesce(wrapped, F.array("doc"))))
    return parsed.select(files.FILE, F.posexplode(listed).alias("pos", "v"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of an export, or of all exports in a folder, of any size."""
    return read_noted(spark, path)[0]


def read_noted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles, and the rejects: exports that give no records, and items that are no objects."""
    found, bad = json_parts.records(spark, path, Scratch(spark, "json"), WRAPPERS)
    files_only = rejects(bad, F.col(files.FILE), F.lit(None), F.col("reason"))
    items_only = rejects(found.filter(~is_object(F.col("v"))), F.col(files.FILE), F.col("pos"), F.lit("item is no object"))
    return profiles(found), files_only.unionByName(items_only)
