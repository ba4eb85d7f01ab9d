"""Delimited files with a header of any of the known spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normalize, text
from kinfold.operators.positions import AT
from kinfold.operators.rejects import rejects
from kinfold.schema import FIELDS, LINKS, LOCATION, as_list, empty, filled, provenance, share
from kinfold.scratch import Scratch
from kinfold.sources import csv_parts, files

# Columns, with the header spellings that mean each.
HEADERS = {
    "full_name": ["name", "full_name", "candidate_name", "fullname", "candidate"],
    "email": ["email", "email_address"],
    "phone": ["phone", "phone_number", "mobile", "tel"],
    "current_company": ["current_company", "company", "employer", "organization"],
    "title": ["title", "job_title", "current_title", "position", "role"],
    "location": ["location"],
    "city": ["city"],
    "country": ["country"],
    "region": ["region", "state"],
    "linkedin": ["linkedin", "linkedin_url", "linkedin_profile"],
    "github": ["github", "github_url", "github_profile"],
    "skills": ["skills", "skill_set", "technologies", "tech_stack", "expertise"],
    "years_experience": ["years_experience", "years", "experience_years"],
    "education": ["education"],
    "degree": ["degree"],
    "school": ["school", "university", "institution"],
    "headline": ["headline", "summary", "bio"],
    "notes": ["notes"],
    "id": ["id", "candidate_id"],
}
SOURCE = "csv"
SKILL_CONFIDENCE = 0.9
NOTES_CHARS = 200


def header_name(raw: str) -> str:
    return raw.strip().lower().replace(" ", "_").replace("-", "_")


def mapped(columns: list[tuple[str, Column]]) -> dict[str, Column]:
    """For each canonical column the first non-empty value, in the header's order; null where no header means it."""
    known, values = normalize.meanings(HEADERS), {}
    for name, value in columns:
        if (canonical := known.get(header_name(name))) is not None:
            values.setdefault(canonical, []).append(text.text_or_null(value))
    return {c: F.coalesce(*values[c]) if c in values else F.lit(None).cast("string") for c in dict.fromkeys(known.values())}


def profiles(rows: DataFrame, index: str, m: dict[str, Column]) -> DataFrame:
    """One profile per row that has any known value, with at; ``index`` names the column with the row's number in its file (FILE), m are the mapped columns."""
    parts = F.transform(F.split(m["location"], ","), text.strip)
    code = lambda c: F.coalesce(normalize.country(c), c)
    city = F.coalesce(m["city"], F.get(parts, F.lit(0)))
    region = F.coalesce(m["region"], F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))))
    country = F.coalesce(code(m["country"]), code(F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).when(F.size(parts) == 2, F.get(parts, F.lit(1)))))
    placed = F.coalesce(m["location"], m["city"], m["region"], m["country"]).isNotNull()
    linked = F.coalesce(m["linkedin"], m["github"]).isNotNull()
    worked, learnt = F.coalesce(m["current_company"], m["title"]).isNotNull(), F.coalesce(m["school"], m["degree"]).isNotNull()
    names = F.filter(F.transform(text.split_list(m["skills"]), normalize.skill), lambda s: s != "")
    null = F.lit(None).cast("string")
    blank = lambda c: F.coalesce(c, F.lit(""))
    out = rows.filter(F.coalesce(*m.values()).isNotNull()).select(
        F.coalesce(m["id"], F.concat(files.stem(F.col(files.FILE)), F.lit("_row"), F.col(index))).alias("candidate_id"),
        normalize.name(m["full_name"]).alias("full_name"),
        as_list(normalize.email(m["email"]), "string").alias("emails"),
        as_list(normalize.phone(m["phone"]), "string").alias("phones"),
        F.when(placed, F.struct(city.alias("city"), region.alias("region"), country.alias("country")).cast(LOCATION)).alias("location"),
        F.when(linked, F.struct(m["linkedin"].alias("linkedin"), m["github"].alias("github"), null.alias("portfolio"), empty("string").alias("other")).cast(LINKS)).alias("links"),
        F.coalesce(m["headline"], F.substring(m["notes"], 1, NOTES_CHARS)).alias("headline"),
        normalize.years(m["years_experience"]).alias("years_experience"),
        F.transform(names, lambda s: F.struct(s.alias("name"), F.lit(SKILL_CONFIDENCE).alias("confidence"), F.array(F.lit(SOURCE)).alias("sources"))).alias("skills"),
        as_list(F.struct(blank(m["current_company"]).alias("company"), blank(m["title"]).alias("title"), null.alias("start"), null.alias("end"), null.alias("summary")), FIELDS["experience"][6:-1], worked).alias("experience"),
        as_list(F.struct(blank(m["school"]).alias("institution"), m["degree"].alias("degree"), null.alias("field"), F.lit(None).cast("int").alias("end_year")), FIELDS["education"][6:-1], learnt).alias("education"),
        m["headline"].isNotNull().alias("__stated"),
        F.struct(F.col(files.FILE).alias("file"), F.lit(0).alias("start"), F.col(index).alias("pos")).cast(AT).alias("at"),
    )
    has = {c: F.col(c).isNotNull() for c in ("full_name", "location", "links", "headline", "years_experience")} | {c: filled(F.col(c)) for c in ("emails", "phones", "skills", "experience", "education")}
    method = F.when(F.col("__stated"), "direct").otherwise("inferred")
    entries = [("full_name", "direct"), ("emails", "direct"), ("phones", "normalized"), ("location", "normalized"), ("links", "direct"), ("headline", method), ("years_experience", "normalized"), ("skills", "normalized"), ("experience", "direct"), ("education", "direct")]
    out = out.withColumn("provenance", provenance(SOURCE, *((f, has[f], how) for f, how in entries)))
    out = out.withColumn("overall_confidence", share([has[c] for c in ("full_name", "emails", "phones", "location", "skills", "experience")]))
    return out.select(*FIELDS, "at")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a file, or of all files in a folder."""
    return read_noted(spark, path)[0]


def read_noted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles of a file, or of all files in a folder, whose headers have to agree; and the rejects.

    Rows with more cells than the header and rows without a known value are rejects; short rows are
    filled with nulls.  Of columns with one name the last counts.  Files of any size are read in parts.
    """
    found = csv_parts.rows(spark, path, Scratch(spark, "csv"))
    heads = found.filter("n = 0").select("cells").distinct().limit(2).collect()
    if len(heads) > 1:
        raise ValueError("the files' headers differ")
    header = heads[0]["cells"] if heads else []
    last = {name: i for i, name in enumerate(header)}
    m = mapped([(name, F.get("cells", F.lit(i))) for name, i in last.items()])
    rows = found.filter("n > 0").withColumn("__index", F.col("n") - 1)
    fits, known = F.size("cells") <= len(header), F.coalesce(*m.values()).isNotNull()
    why = F.when(~fits, "more cells than the header").when(~known, "no known value")
    return profiles(rows.filter(fits), "__index", m), rejects(rows.filter(why.isNotNull()), F.col(files.FILE), F.col("__index"), why)
