"""Code-hosting profiles from captured API payloads, one JSON object a line:
{"username", "user": {...}, "repos": [...], "social_accounts": [...], "readme": {...}}."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions import normalize, text
from kinfold.operators.positions import AT
from kinfold.operators.rejects import rejects
from kinfold.schema import EDUCATION, EXPERIENCE, FIELDS, LINKS, LOCATION, SKILL, as_list, empty, filled, provenance, share
from kinfold.scratch import Scratch
from kinfold.sources import github_live

SOURCE = "github"
PAYLOAD = (
    "username string, user struct<name:string,email:string,bio:string,html_url:string,blog:string,location:string,company:string>, "
    "repos array<struct<fork:boolean,language:string>>, social_accounts array<struct<provider:string,url:string>>, readme struct<content:string,encoding:string>"
)
README_CONFIDENCE = 0.8
# The patterns of skills in a readme.
CODE_SPAN = r"`([^`\n]{2,30})`"
BADGE_ALT = r"(?i)!\[([^\]]{1,40})\]\([^)]*shields\.io[^)]*\)"
BADGE_LABEL = r"(?i)shields\.io/badge/([A-Za-z0-9_.\-+]{2,30})"
NOT_A_SKILL = r"(?i)^(https?://|www\.|/|\.\.|[\d.]+$|[#$%@*_=\-]+$)|[/\\{}<>=]|^[0-9a-f]{6}$"


def username(raw: Column) -> Column:
    """The name in a profile URL, or a bare name."""
    s = text.strip(raw)
    return F.coalesce(text.first_match(s, r"github\.com/([A-Za-z0-9\-]+)/?$", 1), text.first_match(s, r"^[A-Za-z0-9\-]+$"))


def is_skill_token(t: Column) -> Column:
    """Two to thirty characters, at most three words; no URL, path, number, punctuation or colour."""
    return F.length(t).between(2, 30) & ~t.rlike(NOT_A_SKILL) & (F.size(F.split(text.collapse(t), " ")) <= 3)


def readme_tokens(readme: Column) -> Column:
    """Code spans, then badges' alternative texts, then badges' labels, those that look like skills."""
    body = F.decode(F.try_to_binary(F.regexp_replace(readme["content"], r"\s", ""), F.lit("base64")), "UTF-8")
    found = [F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(1)), text.strip) for p in (CODE_SPAN, BADGE_ALT)]
    found.append(F.transform(F.regexp_extract_all(body, F.lit(BADGE_LABEL), F.lit(1)), lambda t: text.strip(F.translate(t, "_-", "  "))))
    return F.when(readme["encoding"] == "base64", F.filter(F.concat(*found), is_skill_token))


def language_skills(users: DataFrame, key: str) -> DataFrame:
    """key and langs: a skill for each language of the repositories that are no forks, most used first.

    Confidence is 0.5 + 0.45 times the language's share, 0.95 at most, to two places as the binary
    value rounds (a small Arrow UDF: Spark's round takes the decimal value).
    """
    repos = users.select(key, F.posexplode("repos").alias("pos", "repo")).filter(~F.coalesce(F.col("repo.fork"), F.lit(False)))
    named = repos.select(key, "pos", text.text_or_null(F.col("repo.language")).alias("lang")).filter("lang IS NOT NULL")
    return counted_skills(named.groupBy(key, "lang").agg(F.count("*").alias("n"), F.min("pos").alias("pos")), key)


def counted_skills(counted: DataFrame, key: str) -> DataFrame:
    """As language_skills(), from key, lang, n (its repositories that are no forks) and pos (the first of them)."""
    total = F.sum("n").over(Window.partitionBy(key))
    places = F.pandas_udf(lambda s: s.map(lambda x: round(x, 2)), "double")
    scored = counted.withColumn("confidence", places(F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.45) * (F.col("n") / total))))
    scored = scored.withColumn("name", normalize.skill(F.col("lang"))).filter("name <> ''")
    best = scored.groupBy(key, "name").agg(F.min(F.struct((-F.col("n")).alias("o"), "pos", "confidence")).alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("b", "name")))
    listed = F.transform(ordered, lambda s: F.struct(s["name"].alias("name"), s["b"]["confidence"].alias("confidence"), F.array(F.lit(SOURCE)).alias("sources")))
    return best.groupBy(key).agg(listed.cast(f"array<{SKILL}>").alias("langs"))


def profiles(payloads: DataFrame) -> DataFrame:
    """One profile per captured user, from rows with at; a payload without a user gives none."""
    users = payloads.filter(F.col("user").isNotNull() & F.col("username").isNotNull())
    users = users.join(language_skills(users, "at"), "at", "left")
    u = {f: text.text_or_null(F.col(f"user.{f}")) for f in ("name", "email", "bio", "blog", "location", "company")}
    portfolio = F.when(u["blog"].rlike("^https?://"), u["blog"]).otherwise(F.concat(F.lit("https://"), u["blog"]))
    social = F.filter(F.transform(F.coalesce("social_accounts", F.array().cast("array<struct<provider:string,url:string>>")), lambda a: F.struct(a["provider"].alias("provider"), text.text_or_null(a["url"]).alias("url"))), lambda a: a["url"].isNotNull() & ((F.coalesce(a["provider"], F.lit("")) == "linkedin") | F.contains(F.lower(a["url"]), F.lit("linkedin.com"))))
    linkedin = F.get(social, F.lit(0))["url"]
    langs = F.coalesce(F.col("langs"), empty(SKILL))
    named = F.coalesce(F.array_distinct(F.filter(F.transform(readme_tokens(F.col("readme")), normalize.skill), lambda s: s != "")), empty("string"))
    extra = F.array_except(named, F.transform(langs, lambda s: s["name"]))
    told = F.transform(extra, lambda s: F.struct(s.alias("name"), F.lit(README_CONFIDENCE).alias("confidence"), F.array(F.lit(SOURCE)).alias("sources"))).cast(f"array<{SKILL}>")
    company = text.text_or_null(F.regexp_replace(u["company"], "^@+", ""))
    null = F.lit(None).cast("string")
    out = users.select(
        F.concat(F.lit("github_"), "username").alias("candidate_id"),
        normalize.name(u["name"]).alias("full_name"),
        as_list(F.lower(u["email"]), "string").alias("emails"),
        empty("string").alias("phones"),
        F.when(u["location"].isNotNull(), F.struct(u["location"].alias("city"), null.alias("region"), null.alias("country")).cast(LOCATION)).alias("location"),
        F.struct(linkedin.alias("linkedin"), F.coalesce(F.nullif(F.col("user.html_url"), F.lit("")), F.concat(F.lit("https://github.com/"), "username")).alias("github"), portfolio.alias("portfolio"), empty("string").alias("other")).cast(LINKS).alias("links"),
        u["bio"].alias("headline"),
        F.lit(None).cast("double").alias("years_experience"),
        F.concat(langs, told).alias("skills"),
        as_list(F.struct(company.alias("company"), F.lit("").alias("title"), null.alias("start"), null.alias("end"), null.alias("summary")), EXPERIENCE, company.isNotNull()).alias("experience"),
        empty(EDUCATION).alias("education"),
        F.col("at").cast(AT).alias("at"),
        linkedin.isNotNull().alias("__social"),
        filled(langs).alias("__langs"),
        filled(told).alias("__told"),
        (F.size("repos") > 0).alias("__repos"),
    )
    has = {c: F.col(c).isNotNull() for c in ("full_name", "location", "headline")} | {c: filled(F.col(c)) for c in ("emails", "skills", "experience")}
    prov = provenance(SOURCE, ("full_name", has["full_name"], "direct"), ("emails", has["emails"], "direct"), ("headline", has["headline"], "direct"), ("links", F.lit(True), "direct"), ("location", has["location"], "inferred"), ("experience", has["experience"], "inferred"), ("skills", F.col("__langs"), "inferred"), ("links", F.col("__social"), "direct"), ("skills", F.col("__told"), "direct"))
    base = share([has[c] for c in ("full_name", "emails", "headline", "location", "skills", "experience")])
    weak = F.coalesce(F.col("__repos"), F.lit(False)) & has["skills"] & (F.round(base * 6) <= 2)
    out = out.withColumn("provenance", prov).withColumn("overall_confidence", F.when(weak, F.least(base, F.lit(0.6))).otherwise(base))
    return out.select(*FIELDS, "at")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of files of captured payloads; a large file is read by several tasks."""
    return read_noted(spark, path)[0]


def read_noted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles, and the rejects: payloads without a user."""
    rows = spark.read.schema(PAYLOAD).option("recursiveFileLookup", True).json(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("pos"))
    rows = Scratch(spark, "payloads").save(rows.withColumn("at", place), "payloads")
    none = F.col("user").isNull() | F.col("username").isNull()
    return profiles(rows), rejects(rows.filter(none), F.col("at.file"), F.col("at.pos"), F.lit("no user"))


def payloads_of(fetched: DataFrame) -> DataFrame:
    """Payloads, and problem, from rows of live parts as JSON text."""
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(PAYLOAD).fields}
    return fetched.select("username", *(F.from_json(part, kinds[part]).alias(part) for part in github_live.CALLS), "problem")


def live(spark: SparkSession, users: list[str], **options: object) -> DataFrame:
    """Rows of github_live.SCHEMA for some users, fetched by the workers; see there for options and problems."""
    spark.dataSource.register(github_live.CodeProfiles)
    reader = spark.read.format("code_profiles").option("users", ",".join(users))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def fetch(names: DataFrame, column: str = "username", client: github_live.Client | None = None) -> DataFrame:
    """Payloads of a table of user names or profile URLs, fetched by the workers, with the problem where there is no user."""
    own = client or github_live.Client()

    def calls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(list(own.payloads(iter(frame["name"]))), columns=[c.split(" ")[0] for c in github_live.SCHEMA.split(", ")])

    known = names.select(username(F.col(column)).alias("name")).filter("name IS NOT NULL")
    return payloads_of(known.mapInPandas(calls, github_live.SCHEMA))
