"""One record from each cluster: which values survive, where they come from, how sure they are.

Everything is aggregation by cluster label with partial results: values are exploded, reduced by
(label, value), and only then listed, so that a record that very many inputs share is never gathered
as a whole.  A cluster of one record is passed through as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.components import counted_side
from kinfold.schema import EDUCATION, EXPERIENCE, FIELDS, LINKS, LOCATION, PROVENANCE, SKILL, empty, filled, source_tag
from kinfold.scratch import Scratch

# Sources by priority among equal confidences, and those whose ids are preferred.
PRIORITY = ("ats_json", "csv", "github")
STRUCTURED = ("ats_json", "csv")
#: Fields whose presence counts for confidence.
COMPLETE = ("full_name", "emails", "phones", "location", "headline", "skills", "experience", "education", "links")


def rank(source: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for i, name in reversed(list(enumerate(PRIORITY))):
        out = F.when(source == name, i).otherwise(out)
    return out


def entries(field: str, sources: Column, method: str) -> Column:
    """Provenance entries of a field, one for each different source, in order."""
    return F.transform(F.array_distinct(sources), lambda s: F.struct(F.lit(field).alias("field"), s.alias("source"), F.lit(method).alias("method"))).cast(f"array<{PROVENANCE}>")


def text_there(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def winners(members: DataFrame) -> DataFrame:
    """Per label: the scalar fields' winners, location, links, the id, and what confidence needs.

    The winner has a value, the highest confidence, then the first source by priority, then comes first.
    """
    key = F.struct((-F.col("overall_confidence")).alias("c"), rank(F.col("src")).alias("r"), "ord")

    def best(value: Column, there: Column, order: Column = key) -> Column:
        return F.min_by(value, F.when(there, order))

    def with_method(field: str) -> Column:
        own = F.get(F.filter("provenance", lambda p: p["field"] == field), F.lit(0))["method"]
        return F.struct(F.col(field).alias("value"), F.col("src").alias("source"), F.coalesce(own, F.lit("direct")).alias("method"))

    first = lambda path: best(F.col(path), text_there(F.col(path)), F.col("ord"))
    owned = lambda path: best(F.struct(F.col(path).alias("value"), "ord", "src"), text_there(F.col(path)), F.col("ord"))
    return members.groupBy("label").agg(
        F.count("*").alias("n"),
        F.avg("overall_confidence").alias("mean"),
        best(with_method("full_name"), text_there(F.col("full_name"))).alias("w_name"),
        best(with_method("headline"), text_there(F.col("headline"))).alias("w_headline"),
        best(with_method("years_experience"), F.coalesce(F.col("years_experience") != 0, F.lit(False))).alias("w_years"),
        best(F.struct("location", "src"), F.col("location").isNotNull()).alias("w_location"),
        *(first(f"location.{c}").alias(f"l_{c}") for c in ("city", "region", "country")),
        *(owned(f"links.{c}").alias(f"k_{c}") for c in ("linkedin", "github", "portfolio")),
        F.max(F.col("links").isNotNull()).alias("has_links"),
        F.coalesce(best(F.col("candidate_id"), F.col("src").isin(*STRUCTURED), F.col("ord")), F.min_by("candidate_id", "ord")).alias("candidate_id"),
    )


def union_of(members: DataFrame, field: str, method: str) -> DataFrame:
    """label, the field's different values in the order in which they first occur, and the sources that brought them first."""
    one = members.select("label", "ord", "src", F.posexplode(field).alias("pos", "value")).filter("value <> ''")
    seen = one.groupBy("label", "value").agg(F.min(F.struct("ord", "pos", "src")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "value")))
    return seen.groupBy("label").agg(listed.alias("l")).select("label", F.transform("l", lambda x: x["value"]).alias(field), entries(field, F.transform("l", lambda x: x["at"]["src"]), method).alias(f"p_{field}"))


def other_links(members: DataFrame) -> DataFrame:
    """label and the different other links with the record that brought each first."""
    one = members.select("label", "ord", "src", F.posexplode("links.other").alias("pos", "value")).filter("value IS NOT NULL")
    seen = one.groupBy("label", "value").agg(F.min(F.struct("ord", "pos", "src")).alias("at"))
    return seen.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("others"))


def merged_skills(members: DataFrame) -> DataFrame:
    """Highest confidence per name, sources in the order of their first mention; sorted by confidence, then name."""
    one = members.select("label", "ord", F.posexplode("skills").alias("pos", "s")).select("label", "ord", "pos", "s.name", "s.confidence", F.posexplode("s.sources").alias("at", "source"))
    by_source = one.groupBy("label", "name", "source").agg(F.max("confidence").alias("confidence"), F.min(F.struct("ord", "pos", "at")).alias("at"))
    by_name = by_source.groupBy("label", "name").agg(F.max("confidence").alias("confidence"), F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("sources"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "name", "confidence", "sources")))
    listed = by_name.groupBy("label").agg(order.alias("l"))
    skills = F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence"), x["sources"].alias("sources")))
    return listed.select("label", skills.cast(f"array<{SKILL}>").alias("skills"), entries("skills", F.flatten(F.transform("l", lambda x: x["sources"])), "merged").alias("p_skills"))


def merged_experience(members: DataFrame) -> DataFrame:
    """Per company and title, without regard to case, the first of the entries with most of start, end and summary."""
    one = members.select("label", "ord", "src", F.posexplode("experience").alias("pos", "e"))
    fold = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    rich = sum(text_there(F.col(f"e.{c}")).cast("int") for c in ("start", "end", "summary"))
    keyed = one.withColumns({"k1": fold("e.company"), "k2": fold("e.title"), "rich": -rich}).filter("k1 <> '' OR k2 <> ''")
    chosen = keyed.groupBy("label", "k1", "k2").agg(F.min_by(F.struct("e", "src"), F.struct("rich", "ord", "pos")).alias("x"), F.min(F.struct("ord", "pos")).alias("at"))
    listed = chosen.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("l"))
    return listed.select("label", F.transform("l", lambda i: i["x"]["e"]).cast(f"array<{EXPERIENCE}>").alias("experience"), entries("experience", F.transform("l", lambda i: i["x"]["src"]), "merged").alias("p_experience"))


def fold_school(items: Column) -> Column:
    """Entries of one school, in order, folded: a degree level keeps its richest entry, the first of equals.

    An entry without degree joins the richest entry so far; one with a degree joins the first of its
    level or without degree.  A richer one takes the place, others are dropped.
    """
    start = F.filter(items, lambda x: F.lit(False))

    def step(acc: Column, item: Column) -> Column:
        top = F.array_max(F.transform(acc, lambda x: x["rich"]))
        fits = F.transform(acc, lambda x: F.when(item["level"] == "", x["rich"] == top).otherwise((x["level"] == item["level"]) | (x["level"] == "")))
        at = F.array_position(fits, F.lit(True))
        placed = F.transform(acc, lambda x, i: F.when((i == at - 1) & (item["rich"] > x["rich"]), item).otherwise(x))
        return F.when(F.coalesce(at, F.lit(0)) > 0, placed).otherwise(F.concat(acc, F.array(item)))

    return F.aggregate(items, start, step)


def merged_education(members: DataFrame) -> DataFrame:
    """Schools in the order in which they first occur, the entries of each folded."""
    one = members.select("label", "ord", "src", F.posexplode("education").alias("pos", "e"))
    one = one.withColumn("school", F.lower(F.trim(F.coalesce("e.institution", F.lit(""))))).filter("school <> ''")
    level = F.lower(F.get(F.split(F.trim(F.coalesce("e.degree", F.lit(""))), r"\s+"), F.lit(0)))
    rich = text_there(F.col("e.degree")).cast("int") + text_there(F.col("e.field")).cast("int") + F.coalesce(F.col("e.end_year") != 0, F.lit(False)).cast("int")
    one = one.withColumns({"level": level, "rich": rich, "at": F.struct("ord", "pos", "src")})
    # Slots change hands only where an entry is richer than all before it: a slot without degree is as rich as any
    # when it is made, so only such an entry can take it.  Between those places each level has one slot
    # that it goes to, and there the first entry of each richness decides: others of its level and richness change nothing.
    # So parts of a school's entries meet as minima, and at most twelve of each level are folded.
    marks = one.groupBy("label", "school").agg(*(F.min(F.when(F.col("rich") >= k, F.col("at"))).alias(f"from{k}") for k in (1, 2, 3)))
    epoch = sum(F.coalesce(F.col("at") >= F.col(f"from{k}"), F.lit(False)).cast("int") for k in (1, 2, 3))
    items = one.join(marks, ["label", "school"]).groupBy("label", "school", "level", "rich", epoch.alias("epoch")).agg(F.min("at").alias("at"), F.min_by("e", "at").alias("e")).groupBy("label", "school").agg(F.array_sort(F.collect_list(F.struct("at", "level", "rich", "e"))).alias("items"))
    folded = items.select("label", F.get("items", F.lit(0))["at"].alias("first"), fold_school(F.col("items")).alias("kept"))
    listed = folded.groupBy("label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "kept"))), lambda s: s["kept"])).alias("l"))
    return listed.select("label", F.transform("l", lambda i: i["e"]).cast(f"array<{EDUCATION}>").alias("education"), entries("education", F.transform("l", lambda i: i["at"]["src"]), "merged").alias("p_education"))


def confidence(mean: Column, n: Column) -> Column:
    """0.6 of the mean, 0.4 of completeness, up to 0.1 for agreeing records; 0 for an empty record."""
    there = [filled(F.col(c)) if FIELDS[c].startswith("array") else text_there(F.col(c)) if FIELDS[c] == "string" else F.col(c).isNotNull() for c in COMPLETE]
    count = sum(F.coalesce(t, F.lit(False)).cast("int") for t in there)
    blend = F.lit(0.6) * mean + F.lit(0.4) * (count / F.lit(float(len(COMPLETE)))) + F.least(F.lit(0.1), F.lit(0.02) * (n - 1))
    return F.when(count == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), blend), 3))


def merge(clustered: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One canonical record per label (kept as ord), from profiles with label.

    Only records that share a label are saved again, once for all that is gathered from them.
    """
    scratch = scratch or Scratch(clustered.sparkSession, "merge")
    members = clustered.withColumn("src", source_tag())
    shared = members.filter(F.col("label") != F.col("ord")).select("label").distinct()
    side = counted_side(scratch.save(shared, "shared-labels"))
    many = scratch.save(members.join(side, "label", "left_semi"), "members")
    single = members.join(side, "label", "left_anti")
    single = single.withColumn("overall_confidence", confidence(F.col("overall_confidence"), F.lit(1))).select(F.col("label").alias("ord"), *FIELDS)
    parts = [union_of(many, "emails", "direct"), union_of(many, "phones", "normalized"), other_links(many), merged_skills(many), merged_experience(many), merged_education(many)]
    wide = winners(many)
    for part in parts:
        wide = wide.join(part, "label", "left")
    kinds = {"emails": "string", "phones": "string", "skills": SKILL, "experience": EXPERIENCE, "education": EDUCATION}
    for c, kind in kinds.items():
        wide = wide.withColumn(c, F.coalesce(c, empty(kind))).withColumn(f"p_{c}", F.coalesce(f"p_{c}", empty(PROVENANCE)))
    scalar = lambda field, w: F.when(F.col(w).isNotNull(), F.array(F.struct(F.lit(field).alias("field"), F.col(f"{w}.source").alias("source"), F.col(f"{w}.method").alias("method")))).otherwise(empty(PROVENANCE)).cast(f"array<{PROVENANCE}>")
    place = F.struct(*(F.coalesce(F.nullif(F.col(f"w_location.location.{c}"), F.lit("")), F.col(f"l_{c}")).alias(c) for c in ("city", "region", "country"))).cast(LOCATION)
    kept = ("linkedin", "github", "portfolio")
    others = F.coalesce(F.col("others"), F.array().cast("array<struct<at:struct<ord:bigint,pos:int,src:string>,value:string>>"))
    brought = F.concat(F.array(*(F.when(F.col(f"k_{c}").isNotNull(), F.struct(F.col(f"k_{c}.ord").alias("ord"), F.col(f"k_{c}.src").alias("src"))) for c in kept)), F.transform(others, lambda o: F.struct(o["at"]["ord"].alias("ord"), o["at"]["src"].alias("src"))))
    linked = F.transform(F.array_sort(F.filter(brought, lambda b: b.isNotNull())), lambda b: b["src"])
    merged = wide.select(
        F.col("label").alias("ord"),
        "candidate_id",
        F.col("w_name.value").alias("full_name"),
        "emails",
        "phones",
        F.when(F.col("w_location").isNotNull(), place).alias("location"),
        F.when(F.col("has_links"), F.struct(*(F.col(f"k_{c}.value").alias(c) for c in kept), F.transform(others, lambda o: o["value"]).alias("other")).cast(LINKS)).alias("links"),
        F.col("w_headline.value").alias("headline"),
        F.col("w_years.value").alias("years_experience"),
        "skills",
        "experience",
        "education",
        F.concat(
            scalar("full_name", "w_name"), F.col("p_emails"), F.col("p_phones"),
            F.when(F.col("w_location").isNotNull(), entries("location", F.array(F.col("w_location.src")), "normalized")).otherwise(empty(PROVENANCE)),
            entries("links", linked, "merged"), scalar("headline", "w_headline"), scalar("years_experience", "w_years"),
            F.col("p_skills"), F.col("p_experience"), F.col("p_education"),
        ).alias("provenance"),
        "mean",
        "n",
    )
    merged = merged.withColumn("overall_confidence", confidence(F.col("mean"), F.col("n"))).select("ord", *FIELDS)
    return single.unionByName(merged)
