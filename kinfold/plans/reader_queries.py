"""Queries that run the readers over files written from the star-schema tables, and DuckDB SQL that expects their results from the tables."""

from __future__ import annotations

import io
import xml.sax.saxutils
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.positions import AT
from kinfold.plans.driver_sql import title_sql
from kinfold.scratch import Scratch
from kinfold.sources import ats_json, csv, github, inputs, resume

Query = Callable[[SparkSession, str], DataFrame]


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of SQL over the driver's tables."""
    names = [t for t in ("customer", "supplier", "events", "documents", "pages") if f"{{{t}}}" in sql]
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON text are no parameters
    for t in names:
        sql = sql.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def _tables(sql: str) -> str:
    """The same SQL for DuckDB, where the tables are views."""
    for t in ("customer", "supplier", "events", "documents", "pages"):
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def joined(values: Column) -> Column:
    return F.array_join(values, "/")


def flat(profiles: DataFrame) -> DataFrame:
    """Profiles with every list as text, and ids without the names of the files that Spark wrote."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return profiles.select(
        F.regexp_replace("candidate_id", "^.*_(row|ats_)", "$1").alias("candidate_id"),
        "full_name",
        joined(F.col("emails")).alias("emails"),
        joined(F.col("phones")).alias("phones"),
        *(F.col(f"location.{c}").alias(c) for c in ("city", "region", "country")),
        *(F.col(f"links.{c}").alias(c) for c in ("linkedin", "github", "portfolio")),
        "headline",
        "years_experience",
        joined(F.transform("skills", lambda s: F.concat(s["name"], F.lit("="), F.format_number(s["confidence"], 2), F.lit("<"), joined(s["sources"])))).alias("skills"),
        joined(F.transform("experience", lambda e: F.concat_ws("|", e["company"], e["title"], blank(e["start"]), blank(e["end"]), blank(e["summary"])))).alias("experience"),
        joined(F.transform("education", lambda e: F.concat_ws("|", e["institution"], blank(e["degree"]), blank(e["field"]), blank(e["end_year"].cast("string"))))).alias("education"),
        joined(F.transform("provenance", lambda p: F.concat_ws(":", p["field"], p["method"]))).alias("provenance"),
        F.round("overall_confidence", 6).alias("overall_confidence"),
    )


def _share(parts: str, n: int) -> str:
    return f"round(({parts}) / {n}.0::DOUBLE, 6) AS overall_confidence"


def _present(*fields: tuple[str, str]) -> str:
    """Provenance in SQL: (condition, entry) of each field, those present, in order."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{e}' END" for c, e in fields) + "], lambda x: x IS NOT NULL), '/') AS provenance"


# Rows of delimited files: three files, cells with blanks, separators and surplus text, empty rows.
CSV_ROWS = """
SELECT CAST(c_custkey % 3 + 3 * floor(c_custkey / 30000) AS INT) AS part, c_custkey AS k,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 2 = 1 THEN 'c' || cast(c_custkey AS string) END AS id,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 5 <> 0 THEN '  ' || lower(c_name) END AS name,
  CASE WHEN c_custkey % 30 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'bad' ELSE ' U' || cast(c_custkey AS string) || '@Example.COM ' END AS email,
  CASE WHEN c_custkey % 30 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '98' || lpad(cast(c_custkey AS string), 8, '0') WHEN c_custkey % 3 = 1 THEN '+1 (415) ' || lpad(cast(c_custkey AS string), 7, '0') END AS phone,
  CASE WHEN c_custkey % 30 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'City' || cast(c_custkey % 10 AS string) || ', Region, india' WHEN c_custkey % 4 = 1 THEN 'City, Norway' WHEN c_custkey % 4 = 2 THEN ' Lone ' END AS location,
  CASE WHEN c_custkey % 30 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'k8s, js,, ' WHEN c_custkey % 3 = 1 THEN 'python3;' || c_mktsegment END AS skills,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 2 = 0 THEN 'about ' || cast(c_custkey % 11 AS string) || '.5 years' END AS years,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 3 = 0 THEN 'Co' || cast(c_custkey % 7 AS string) END AS company,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 6 = 0 THEN 'Dev "x", lead' END AS title,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 7 = 0 THEN 'School' || cast(c_custkey % 5 AS string) END AS school,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 14 = 0 THEN 'BSc' END AS degree,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 5 = 2 THEN rpad('n' || cast(c_custkey AS string), 230, 'x') END AS notes,
  CASE WHEN c_custkey % 30 <> 0 AND c_custkey % 8 = 3 THEN 'in/' || cast(c_custkey AS string) END AS linkedin
FROM {customer}
"""
#: The columns' headers in the files.
CSV_HEADERS = {"id": "Candidate ID", "name": "Candidate Name", "email": "email address", "phone": "Mobile", "location": "Location", "skills": "Tech-Stack", "years": "years", "company": "Employer", "title": "Job Title", "school": "University", "degree": "Degree", "notes": "Notes", "linkedin": "LinkedIn_URL"}


def csv_folder(spark: SparkSession, sf_dir: str, scratch: Scratch) -> str:
    rows = _made(spark, sf_dir, CSV_ROWS).repartition("part").sortWithinPartitions("part", "k")
    rows = rows.select("part", *(F.col(c).alias(h) for c, h in CSV_HEADERS.items()))
    place = f"{scratch.root}/csv"
    rows.write.partitionBy("part").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(place)
    return place


def csv_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of delimited files as profiles."""
    return flat(csv.read(spark, csv_folder(spark, sf_dir, Scratch(spark, "query"))))


_CSV = f"""
WITH r AS ({_tables(CSV_ROWS)}),
v AS (
  SELECT part, k, row_number() OVER (PARTITION BY part ORDER BY k) - 1 AS i, id, {title_sql("trim(name)")} AS full_name,
    CASE WHEN email LIKE '%@%' THEN lower(trim(email)) END AS email, CASE WHEN phone LIKE '98%' THEN '+91' || phone WHEN phone IS NOT NULL THEN '+1415' || lpad(k::VARCHAR, 7, '0') END AS phone,
    CASE k % 4 WHEN 0 THEN 'City' || (k % 10) WHEN 1 THEN 'City' WHEN 2 THEN 'Lone' END AS city, CASE WHEN k % 4 = 0 THEN 'Region' END AS region, CASE k % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'NO' END AS country,
    location IS NOT NULL AS placed, linkedin, left(notes, 200) AS headline, CASE WHEN years IS NOT NULL THEN (k % 11) + 0.5::DOUBLE END AS years_experience,
    CASE k % 3 WHEN 0 THEN 'Kubernetes=0.90<csv/JavaScript=0.90<csv' WHEN 1 THEN 'Python=0.90<csv/' || {title_sql("split_part(skills, ';', 2)")} || '=0.90<csv' ELSE '' END AS skills,
    CASE WHEN company IS NOT NULL THEN company || '|' || coalesce(title, '') || '|||' ELSE '' END AS experience, CASE WHEN school IS NOT NULL THEN school || '|' || coalesce(degree, '') || '||' ELSE '' END AS education
  FROM r
), kept AS (SELECT * FROM v WHERE k % 30 <> 0)
"""
CSV_EXPECTED = f"""{_CSV}
SELECT coalesce(id, 'row' || i) AS candidate_id, full_name, coalesce(email, '') AS emails, coalesce(phone, '') AS phones, CASE WHEN placed THEN city END AS city, CASE WHEN placed THEN region END AS region, CASE WHEN placed THEN country END AS country,
  linkedin, NULL::VARCHAR AS github, NULL::VARCHAR AS portfolio, headline, years_experience, skills, experience, education,
  {_present(("full_name IS NOT NULL", "full_name:direct"), ("email IS NOT NULL", "emails:direct"), ("phone IS NOT NULL", "phones:normalized"), ("placed", "location:normalized"), ("linkedin IS NOT NULL", "links:direct"), ("headline IS NOT NULL", "headline:inferred"), ("years_experience IS NOT NULL", "years_experience:normalized"), ("skills <> ''", "skills:normalized"), ("experience <> ''", "experience:direct"), ("education <> ''", "education:direct"))},
  {_share("(full_name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + placed::INT + (skills <> '')::INT + (experience <> '')::INT", 6)}
FROM kept
"""

# Records of nested exports: three files, other names for the same parts, items that are no objects.
ATS_RECORDS = """
SELECT CAST(s_suppkey % 3 + 3 * floor(s_suppkey / 30000) AS INT) AS part, s_suppkey AS k,
  CASE WHEN s_suppkey % 10 = 3 THEN '"no object"' ELSE
  '{"applicant": {' || CASE WHEN s_suppkey % 4 = 0 THEN '"firstName": " ann", "lastName": "' || lower(s_name) || '"' ELSE '"fullName": "' || lower(s_name) || '"' END
    || CASE s_suppkey % 3 WHEN 0 THEN ', "email": ["S' || cast(s_suppkey AS string) || '@x.ORG", "s' || cast(s_suppkey AS string) || '@x.org", "bad"]' WHEN 1 THEN ', "emailAddress": "t' || cast(s_suppkey AS string) || '@x.org"' ELSE ', "email": ""' END
    || ', "yearsOfExperience": ' || CASE s_suppkey % 3 WHEN 0 THEN cast(s_suppkey % 9 AS string) WHEN 1 THEN '" 4.5 "' ELSE '"5d"' END
    || ', "skills": ' || CASE s_suppkey % 3 WHEN 0 THEN '[{"name": "aws"}, {"label": "py"}, 5, ""]' WHEN 1 THEN '"js| go lang"' ELSE '[]' END
    || CASE WHEN s_suppkey % 2 = 0 THEN ', "location": {"city": "Oslo", "country": "norway"}' ELSE '' END
    || CASE WHEN s_suppkey % 5 = 0 THEN ', "githubUrl": " gh/' || cast(s_suppkey AS string) || ' "' ELSE '' END || '}'
    || CASE WHEN s_suppkey % 2 = 0 THEN ', "applicantId": ' || cast(s_suppkey AS string) ELSE '' END
    || CASE WHEN s_suppkey % 6 < 3 THEN ', "phone": ' || cast(9800000000 + s_suppkey AS string) ELSE '' END
    || CASE WHEN s_suppkey % 4 < 2 THEN ', "workHistory": [{"employer": "E' || cast(s_suppkey % 5 AS string) || '", "role": "R", "from": "Jan 2020", "to": "present", "description": "d"}, {"description": "none"}, "x"]' ELSE '' END
    || CASE WHEN s_suppkey % 5 < 2 THEN ', "education": [{"school": "S", "degree": "BSc", "major": "M", "graduationYear": "2019-05"}, {"degree": "no school"}]' ELSE '' END
    || CASE WHEN s_suppkey % 7 = 0 THEN ', "summary": "About ' || s_name || '"' ELSE '' END || '}' END AS record
FROM {supplier}
"""


#: Exports as tools write them: an object with its list among other members, one record a line, and indented; every file has other lines before and after the records.
ATS_FRAMES = {
    0: ('{"meta": {"made": "2024", "tags": ["[", "}"]},\n "applicants": [', ']\n}\n'),
    1: ('{"data": [', '], "next": null}'),
    2: ("[", "\n]\n"),
}


def ats_folder(spark: SparkSession, sf_dir: str, scratch: Scratch) -> str:
    """Exports of records in three shapes, line by line; and a damaged one, an empty one and one of a single record."""
    rows = _made(spark, sf_dir, ATS_RECORDS)
    indented = F.when(F.col("part") % 3 == 2, F.replace("record", F.lit(', "'), F.lit(',\n    "'))).otherwise(F.col("record"))
    first = F.broadcast(rows.groupBy("part").agg(F.min("k").alias("first")))
    lines = rows.join(first, "part").select("part", "k", F.concat(F.when(F.col("k") == F.col("first"), "").otherwise(","), indented).alias("value"))
    shape = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in ATS_FRAMES.items() for x in (k, v[i]))), F.col("part") % 3)
    ends = first.select("part", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("k"), shape(0).alias("value")), F.struct(F.lit(1 << 60).alias("k"), shape(1).alias("value")))).alias("x")).select("part", "x.*")
    place = f"{scratch.root}/ats"
    lines.unionByName(ends).repartition("part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(place)
    return place


def bad_exports(spark: SparkSession, sf_dir: str, scratch: Scratch) -> str:
    """Exports that give nothing: the second half of a file, lines of JSON, a number; one file for each supplier under 10."""
    text = "CASE s_suppkey % 4 WHEN 0 THEN '[{}, {\"name\": \"x\"' WHEN 1 THEN '{}' || chr(10) || '{}' WHEN 2 THEN '7' ELSE '{\"name\": \"' || s_name || '\"}' END"
    place = f"{scratch.root}/bad"
    _made(spark, sf_dir, f"SELECT s_suppkey AS part, {text} AS value FROM {{supplier}} WHERE s_suppkey < 10").repartition("part").write.partitionBy("part").text(place)
    return place


def ats_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of nested exports as profiles."""
    return flat(ats_json.read(spark, ats_folder(spark, sf_dir, Scratch(spark, "query"))))


_ATS = f"""
WITH v AS (
  SELECT s_suppkey % 3 AS part, s_suppkey AS k, row_number() OVER (PARTITION BY s_suppkey % 3 + 3 * floor(s_suppkey / 30000) ORDER BY s_suppkey) - 1 AS i, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR END AS id,
    {title_sql("CASE WHEN s_suppkey % 4 = 0 THEN 'ann ' ELSE '' END || s_name")} AS full_name,
    CASE s_suppkey % 3 WHEN 0 THEN 's' || s_suppkey || '@x.org' WHEN 1 THEN 't' || s_suppkey || '@x.org' END AS email, CASE WHEN s_suppkey % 6 < 3 THEN '+91' || (9800000000 + s_suppkey) END AS phone,
    s_suppkey % 2 = 0 AS placed, CASE WHEN s_suppkey % 5 = 0 THEN 'gh/' || s_suppkey END AS github, CASE WHEN s_suppkey % 7 = 0 THEN 'About ' || s_name END AS headline,
    CASE s_suppkey % 3 WHEN 0 THEN (s_suppkey % 9)::DOUBLE WHEN 1 THEN 4.5::DOUBLE END AS years_experience,
    CASE s_suppkey % 3 WHEN 0 THEN 'AWS=0.85<ats_json/Python=0.85<ats_json' WHEN 1 THEN 'JavaScript=0.85<ats_json/Go=0.85<ats_json' ELSE '' END AS skills,
    CASE WHEN s_suppkey % 4 < 2 THEN 'E' || (s_suppkey % 5) || '|R|2020-01||d' ELSE '' END AS experience, CASE WHEN s_suppkey % 5 < 2 THEN 'S|BSc|M|2019' ELSE '' END AS education
  FROM supplier
), kept AS (SELECT * FROM v WHERE k % 10 <> 3)
"""
ATS_EXPECTED = f"""{_ATS}
SELECT coalesce(id, 'ats_' || i) AS candidate_id, full_name, coalesce(email, '') AS emails, coalesce(phone, '') AS phones, CASE WHEN placed THEN 'Oslo' END AS city, NULL::VARCHAR AS region, CASE WHEN placed THEN 'NO' END AS country,
  NULL::VARCHAR AS linkedin, github, NULL::VARCHAR AS portfolio, headline, years_experience, skills, experience, education,
  {_present(("full_name IS NOT NULL", "full_name:direct"), ("email IS NOT NULL", "emails:direct"), ("phone IS NOT NULL", "phones:normalized"), ("github IS NOT NULL", "links:direct"), ("headline IS NOT NULL", "headline:direct"), ("years_experience IS NOT NULL", "years_experience:direct"), ("skills <> ''", "skills:normalized"), ("experience <> ''", "experience:normalized"), ("education <> ''", "education:normalized"), ("placed", "location:normalized"))},
  {_share("(full_name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + placed::INT + (skills <> '')::INT + (experience <> '')::INT", 6)}
FROM kept
"""

# Captured payloads of code-hosting users, one a line; every ninth has no user.
PAYLOADS = """
SELECT s_suppkey AS k, '{"username": "u' || cast(s_suppkey AS string) || '"' || CASE WHEN s_suppkey % 9 = 8 THEN '' ELSE
  ', "user": {"name": "' || lower(s_name) || '", "bio": " dev ", "blog": "' || CASE s_suppkey % 3 WHEN 0 THEN 'site.dev' WHEN 1 THEN 'https://b.me' ELSE '' END || '"'
    || CASE WHEN s_suppkey % 2 = 0 THEN ', "email": "G' || cast(s_suppkey AS string) || '@x.org", "location": "Oslo"' ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN ', "company": "@@corp"' ELSE '' END || ', "html_url": "' || CASE WHEN s_suppkey % 5 = 0 THEN 'https://github.com/own' ELSE '' END || '"}'
    || ', "repos": [' || CASE WHEN s_suppkey % 3 < 2 THEN '{"language": "js"}, {"fork": true, "language": "C"}, {"language": "Go"}, {"language": "Go"}, {"language": null}' ELSE '' END || ']'
    || CASE WHEN s_suppkey % 4 = 1 THEN ', "social_accounts": [{"provider": "x", "url": "https://x.com/a"}, {"provider": "linkedin", "url": " in/' || cast(s_suppkey AS string) || ' "}]' ELSE '' END
    || CASE WHEN s_suppkey % 6 < 2 THEN ', "readme": {"encoding": "base64", "content": "' || '{README}' || '"}' ELSE '' END END || '}' AS value
FROM {supplier}
"""
#: `Go` `Rust` `a/b` `123` and a badge ![Docker](https://img.shields.io/badge/My_Tool-blue), as base64.
README_TEXT = "`Go` `Rust` `a/b` `123` ![Docker](https://img.shields.io/badge/My_Tool-blue)"


def _payloads() -> str:
    import base64

    return PAYLOADS.replace("{README}", base64.b64encode(README_TEXT.encode()).decode())


def payload_folder(spark: SparkSession, sf_dir: str, scratch: Scratch) -> str:
    place = f"{scratch.root}/payloads"
    _made(spark, sf_dir, _payloads()).repartitionByRange(2, "k").sortWithinPartitions("k").select("value").write.text(place)
    return place


def github_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of captured payloads as profiles."""
    return flat(github.read(spark, payload_folder(spark, sf_dir, Scratch(spark, "query"))))


_GITHUB = f"""
WITH v AS (
  SELECT s_suppkey AS k, {title_sql("lower(s_name)")} AS full_name, CASE WHEN s_suppkey % 2 = 0 THEN 'g' || s_suppkey || '@x.org' END AS email, s_suppkey % 2 = 0 AS placed, CASE WHEN s_suppkey % 4 = 0 THEN 'corp||||' ELSE '' END AS experience,
    CASE WHEN s_suppkey % 4 = 1 THEN 'in/' || s_suppkey END AS linkedin, CASE WHEN s_suppkey % 5 = 0 THEN 'https://github.com/own' ELSE 'https://github.com/u' || s_suppkey END AS github,
    CASE s_suppkey % 3 WHEN 0 THEN 'https://site.dev' WHEN 1 THEN 'https://b.me' END AS portfolio, s_suppkey % 3 < 2 AS coded, s_suppkey % 6 < 2 AS told
  FROM supplier WHERE s_suppkey % 9 <> 8
), s AS (
  SELECT *, array_to_string(list_filter([CASE WHEN coded THEN 'Go=0.80<github/JavaScript=0.65<github' END, CASE WHEN told AND NOT coded THEN 'Go=0.80<github' END, CASE WHEN told THEN 'Rust=0.80<github/Docker=0.80<github/My Tool Blue=0.80<github' END], lambda x: x IS NOT NULL), '/') AS skills FROM v
), c AS (
  SELECT *, 2 + (email IS NOT NULL)::INT + placed::INT + (skills <> '')::INT + (experience <> '')::INT AS filled FROM s
)
"""
GITHUB_EXPECTED = f"""{_GITHUB}
SELECT 'github_u' || k AS candidate_id, full_name, coalesce(email, '') AS emails, '' AS phones, CASE WHEN placed THEN 'Oslo' END AS city, NULL::VARCHAR AS region, NULL::VARCHAR AS country, linkedin, github, portfolio, 'dev' AS headline, NULL::DOUBLE AS years_experience, skills, experience, '' AS education,
  {_present(("true", "full_name:direct"), ("email IS NOT NULL", "emails:direct"), ("true", "headline:direct"), ("true", "links:direct"), ("placed", "location:inferred"), ("experience <> ''", "experience:inferred"), ("coded", "skills:inferred"), ("linkedin IS NOT NULL", "links:direct"), ("told", "skills:direct"))},
  round(CASE WHEN coded AND skills <> '' AND filled <= 2 THEN least(filled / 6.0::DOUBLE, 0.6::DOUBLE) ELSE filled / 6.0::DOUBLE END, 6) AS overall_confidence
FROM c
"""

# Resumes: name, headline, contact line and sections in the usual and some unusual forms; some without anything usable.
RESUMES = """
SELECT c_custkey AS k, CASE WHEN c_custkey % 25 = 0 THEN '12 34' ELSE
  CASE WHEN c_custkey % 3 = 0 THEN chr(10) || ' jo van  der ' || CASE WHEN c_custkey % 2 = 0 THEN 'berg' ELSE 'meer' END ELSE 'Ann Lee, Jr.' END || chr(10)
  || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' Senior ' || c_mktsegment || ' ' || chr(10) END
  || 'R' || cast(c_custkey AS string) || '@Example.org | ' || CASE WHEN c_custkey % 5 < 3 THEN '+1 (415) ' || lpad(cast(c_custkey AS string), 7, '0') ELSE 'no call' END || ' | linkedin.com/in/p-' || cast(c_custkey AS string) || chr(10)
  || 'Summary:' || chr(10) || 'Builds ' || lower(c_mktsegment) || '. Likes tea.' || chr(10)
  || CASE WHEN c_custkey % 2 = 0 THEN 'Work Experience' || chr(10) || 'Engineer at Acme' || chr(10) || 'Jan 2018 - Present' || chr(10) || 'Did work' || chr(10) || 'More' || chr(10) || chr(10) || 'Intern - Beta Corp, 201' || cast(c_custkey % 7 AS string) || ' - 2017' || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 3 < 2 THEN 'EDUCATION :' || chr(10) || 'IIT Delhi' || chr(10) || 'B.Tech in CS, 2016' || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 4 < 2 THEN 'Skills' || chr(10) || '• Python, K8s' || chr(10) || '- Go lang' ELSE '' END END AS text
FROM {customer}
"""


def resume_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes' texts as profiles."""
    made = _made(spark, sf_dir, RESUMES)
    at = F.struct(F.lit("resumes").alias("file"), F.lit(0).alias("start"), F.col("k").alias("pos")).cast(AT)
    return flat(resume.profiles(made.select(F.col("k").cast("string").alias("stem"), "text", at.alias("at")), 2024))


RESUME_EXPECTED = f"""
WITH v AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'Jo Van Der ' || CASE WHEN c_custkey % 2 = 0 THEN 'Berg' ELSE 'Meer' END ELSE 'Ann Lee, Jr.' END AS full_name,
    'r' || c_custkey || '@example.org' AS email, CASE WHEN c_custkey % 5 < 3 THEN '+1415' || lpad(c_custkey::VARCHAR, 7, '0') WHEN c_custkey % 2 = 0 THEN '+201' || c_custkey % 7 || '2017' END AS phone, 'https://linkedin.com/in/p-' || c_custkey AS linkedin,
    CASE WHEN c_custkey % 4 = 0 THEN 'Builds ' || lower(c_mktsegment) || '.' ELSE 'Senior ' || c_mktsegment END AS headline,
    CASE WHEN c_custkey % 2 = 0 THEN 2024 - least(2018, 2010 + c_custkey % 7)::DOUBLE END AS years_experience,
    CASE WHEN c_custkey % 4 < 2 THEN 'Python=0.80<resume/K8S Go Lang=0.80<resume' ELSE '' END AS skills,
    CASE WHEN c_custkey % 2 = 0 THEN 'Acme|Engineer|2018-01||Did work More/Beta Corp|Intern|201' || c_custkey % 7 || '|2017|' ELSE '' END AS experience, CASE WHEN c_custkey % 3 < 2 THEN 'IIT Delhi|B.Tech|CS|2016' ELSE '' END AS education
  FROM customer WHERE c_custkey % 25 <> 0
)
SELECT 'resume_' || k AS candidate_id, full_name, email AS emails, coalesce(phone, '') AS phones, NULL::VARCHAR AS city, NULL::VARCHAR AS region, NULL::VARCHAR AS country, linkedin, NULL::VARCHAR AS github, NULL::VARCHAR AS portfolio, headline, years_experience, skills, experience, education,
  {_present(("true", "full_name:direct"), ("true", "emails:direct"), ("phone IS NOT NULL", "phones:normalized"), ("true", "links:direct"), ("true", "headline:direct"), ("experience <> ''", "experience:normalized"), ("education <> ''", "education:normalized"), ("skills <> ''", "skills:normalized"), ("years_experience IS NOT NULL", "years_experience:inferred"))},
  {_share("3 + (phone IS NOT NULL)::INT + (experience <> '')::INT + (education <> '')::INT + (skills <> '')::INT", 7)}
FROM v
"""


def docx_bytes(text: str | None) -> bytes | None:
    """A document of one paragraph a line."""
    if text is None:
        return None
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{xml.sax.saxutils.escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        file.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as DOCX and read back; every tenth is cut off, every eleventh of another kind."""
    as_docx = F.pandas_udf(lambda s: s.map(docx_bytes), "binary")
    whole = as_docx("text")
    content = F.when(F.col("doc_id") % 10 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    path = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, ".doc").otherwise(".docx"))
    made = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL").select(path.alias("path"), content.alias("content"))
    return resume.texts(made)


DOCX_EXPECTED = """
SELECT doc_id || CASE WHEN doc_id % 11 = 0 THEN '.doc' ELSE '.docx' END AS path, CASE WHEN doc_id % 10 <> 0 AND doc_id % 11 <> 0 THEN text END AS text FROM documents WHERE text IS NOT NULL
"""


def read_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of four kinds read as one, in order; inputs that are missing or of no known kind are left out and named."""
    found = _read(spark, sf_dir)
    ranked = found.profiles.select(F.regexp_replace("candidate_id", "^.*_(row|ats_)", "$1").alias("candidate_id"), "full_name", "ord")
    last = ranked.agg(F.count_distinct("ord").alias("different"), F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(last)).select("candidate_id", "full_name", (F.col("different") == F.col("n")).alias("unique_ord"), F.lit(len(found.skipped)).alias("skipped"))


def _read(spark: SparkSession, sf_dir: str) -> inputs.Extracted:
    scratch = Scratch(spark, "query")
    items = [inputs.Input(csv_folder(spark, sf_dir, scratch), "csv"), inputs.Input("notes.txt"), inputs.Input(f"{scratch.root}/missing", "csv")]
    items += [inputs.Input(payload_folder(spark, sf_dir, scratch), "github"), inputs.Input(ats_folder(spark, sf_dir, scratch), "ats_json"), inputs.Input(bad_exports(spark, sf_dir, scratch), "ats_json")]
    return inputs.read_all(spark, items)


READ_EXPECTED = f"""
SELECT candidate_id, full_name, true AS unique_ord, 4 AS skipped FROM (
  SELECT candidate_id, full_name FROM ({CSV_EXPECTED}) UNION ALL SELECT candidate_id, full_name FROM ({ATS_EXPECTED}) UNION ALL SELECT candidate_id, full_name FROM ({GITHUB_EXPECTED})
  UNION ALL SELECT 'ats_0', {title_sql("s_name")} FROM supplier WHERE s_suppkey < 10 AND s_suppkey % 4 = 3
)
"""


def read_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same inputs leave out, with the reasons: rows, items, payloads and whole files."""
    told = F.col("reason") != "no user"  # payloads have places of no meaning of their own
    found = _read(spark, sf_dir).rejects.select("input", "reason", F.when(told, F.col("pos")).alias("pos"), F.when(told, F.col("file")).alias("file"))
    return found.groupBy("input", "reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("pos").cast("long"), F.lit(-1)).alias("places"), F.count_distinct("file").alias("files"))


REJECTS_EXPECTED = f"""
WITH r AS ({_tables(CSV_ROWS)}),
c AS (SELECT k, part, row_number() OVER (PARTITION BY part ORDER BY k) - 1 AS i FROM r),
a AS (SELECT s_suppkey AS k, s_suppkey % 3 + 3 * floor(s_suppkey / 30000) AS part, row_number() OVER (PARTITION BY s_suppkey % 3 + 3 * floor(s_suppkey / 30000) ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT 0 AS input, 'no known value' AS reason, count(*) AS n, sum(i)::BIGINT AS places, count(DISTINCT part) AS files FROM c WHERE k % 30 = 0
UNION ALL SELECT 3, 'no user', count(*), -1, 0 FROM a WHERE k % 9 = 8
UNION ALL SELECT 4, 'item is no object', count(*), sum(i)::BIGINT, count(DISTINCT part) FROM a WHERE k % 10 = 3
UNION ALL SELECT 5, CASE k % 4 WHEN 2 THEN 'neither a list nor an object' ELSE 'no valid JSON' END, count(*), -1, count(*) FROM a WHERE k < 10 AND k % 4 <> 3 GROUP BY ALL
"""

def input_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How input specifications are read: pages' URLs and file names in turn, with and without a kind."""
    endings = F.array(*(F.lit(x) for x in SPEC_ENDINGS))
    specs = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.get(endings, (F.col("page_id") % len(SPEC_ENDINGS)).cast("int"))).alias("spec"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inputs.Input.parse(s) for s in batch["spec"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["spec"], pa.array([i.path for i in found], pa.string()), pa.array([i.kind for i in found], pa.string())], ["page_id", "spec", "path", "kind"])

    return specs.filter("spec IS NOT NULL").mapInArrow(parsed, "page_id long, spec string, path string, kind string")


SPEC_ENDINGS = (".CSV", " .json ", ":resume", ".pdf", ".docx:csv", ".txt", ":unknown", "", "/github.com/x", ".csv:github")
SPECS_EXPECTED = """
WITH s AS (SELECT page_id, url || ['.CSV', ' .json ', ':resume', '.pdf', '.docx:csv', '.txt', ':unknown', '', '/github.com/x', '.csv:github'][page_id % 10 + 1] AS spec FROM pages WHERE url IS NOT NULL),
p AS (SELECT *, regexp_extract(spec, ':(csv|ats_json|github|resume)$', 1) AS given FROM s),
q AS (SELECT page_id, spec, given, CASE WHEN given <> '' THEN left(spec, length(spec) - length(given) - 1) ELSE spec END AS path FROM p)
SELECT page_id, spec, path, CASE WHEN given <> '' THEN given WHEN contains(lower(path), 'github.com') THEN 'github'
  WHEN regexp_matches(trim(path), '[^/]\\.(csv|CSV)$') THEN 'csv' WHEN regexp_matches(trim(path), '[^/]\\.json$') THEN 'ats_json' WHEN regexp_matches(trim(path), '[^/]\\.(pdf|docx)$') THEN 'resume' END AS kind
FROM q
"""


def usernames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User names in URLs and bare."""
    raw = "CASE s_suppkey % 5 WHEN 0 THEN 'https://github.com/u-' || cast(s_suppkey AS string) || '/' WHEN 1 THEN ' name' || cast(s_suppkey AS string) || ' ' WHEN 2 THEN 'https://github.com/u/repo' WHEN 3 THEN 'no name' END"
    return _made(spark, sf_dir, f"SELECT s_suppkey AS id, {raw} AS raw FROM {{supplier}}").select("id", github.username(F.col("raw")).alias("username"))


USERNAMES_EXPECTED = "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'u-' || s_suppkey WHEN 1 THEN 'name' || s_suppkey END AS username FROM supplier"


def skill_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which different words of all documents could be a skill."""
    words = _made(spark, sf_dir, "SELECT DISTINCT explode(regexp_extract_all(text, '[!-~]+', 0)) AS token FROM {documents}")
    return words.select("token", github.is_skill_token(F.col("token")).alias("fits"))


TOKENS_EXPECTED = r"""
SELECT token, length(token) BETWEEN 2 AND 30 AND NOT (starts_with(lower(token), 'http://') OR starts_with(lower(token), 'https://') OR starts_with(lower(token), 'www.') OR starts_with(token, '/') OR starts_with(token, '..')
  OR length(translate(token, '0123456789.', '')) = 0 OR length(translate(token, '#$%@*_=-', '')) = 0 OR length(translate(token, '/\{}<>=', '')) < length(token) OR (length(token) = 6 AND length(translate(lower(token), '0123456789abcdef', '')) = 0)) AS fits
FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[!-~]+')) AS token FROM documents)
"""

# A text without section headers is one header block: name line, the line after it as headline, contacts.
_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_CALL = r"\+?\d[\d\s\-().]{7,}\d"
RESUME_PROFILES_EXPECTED = rf"""
WITH d AS (
  SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents WHERE regexp_matches(text, '\S')
), n AS (
  SELECT *, list_filter(lines, lambda x: NOT regexp_matches(x, '{_MAIL}|(?i:linkedin\.com/in/[A-Za-z0-9\-_%]+|github\.com/[A-Za-z0-9\-]+)') AND NOT regexp_matches(x, '\p{{Nd}}')
    AND regexp_full_match(regexp_replace(x, '[.,]', '', 'g'), '\p{{L}}+(\s+\p{{L}}+){{0,4}}'))[1] AS name FROM d
), h AS (
  SELECT *, lines[list_position(lines, name) + 1] AS after,
    lower(nullif(regexp_extract(text, '{_MAIL}'), '')) AS email, coalesce(nullif(regexp_extract(array_to_string(string_split(text, chr(10))[1:15], chr(10)), '{_CALL}'), ''), nullif(regexp_extract(text, '{_CALL}'), '')) AS call FROM n
), k AS (
  SELECT *, trim(regexp_replace(name, '\s+', ' ', 'g')) AS plain, CASE WHEN NOT regexp_matches(after, '{_MAIL}') AND NOT regexp_matches(after, '{_CALL}') THEN after END AS headline, regexp_replace(call, '[^0-9+]', '', 'g') AS digits FROM h
), f AS (
  SELECT *, CASE WHEN length(plain) >= 2 THEN {title_sql("plain")} END AS full_name, CASE WHEN starts_with(digits, '+') THEN digits WHEN length(digits) = 10 THEN '+91' || digits WHEN length(digits) > 7 THEN '+' || digits END AS number FROM k
), p AS (
  SELECT *, CASE WHEN length(ltrim(number, '+')) BETWEEN 7 AND 15 THEN number END AS phone FROM f
)
SELECT 'resume_' || doc_id AS candidate_id, full_name, headline, coalesce(email, '') AS emails, coalesce(phone, '') AS phones,
  {_share("(full_name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (headline IS NOT NULL)::INT", 7)}
FROM p WHERE full_name IS NOT NULL OR email IS NOT NULL OR phone IS NOT NULL OR headline IS NOT NULL
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (csv_profiles, ats_profiles, github_profiles, resume_read, docx_text, read_sources, read_rejects, input_specs, usernames, skill_tokens)}
ORACLE_SQL: dict[str, str] = {
    "csv_profiles": CSV_EXPECTED, "ats_profiles": ATS_EXPECTED, "github_profiles": GITHUB_EXPECTED, "resume_read": RESUME_EXPECTED, "docx_text": DOCX_EXPECTED,
    "resume_profiles": RESUME_PROFILES_EXPECTED, "read_sources": READ_EXPECTED, "read_rejects": REJECTS_EXPECTED, "input_specs": SPECS_EXPECTED, "usernames": USERNAMES_EXPECTED, "skill_tokens": TOKENS_EXPECTED,
}
