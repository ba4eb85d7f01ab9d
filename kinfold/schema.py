"""The canonical record: one row per person and source before merging, one per person after."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKILL = "struct<name:string,confidence:double,sources:array<string>>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:int>"
LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
PROVENANCE = "struct<field:string,source:string,method:string>"

#: Field names and types in the order in which a record is serialised.
FIELDS = {
    "candidate_id": "string",
    "full_name": "string",
    "emails": "array<string>",
    "phones": "array<string>",
    "location": LOCATION,
    "links": LINKS,
    "headline": "string",
    "years_experience": "double",
    "skills": f"array<{SKILL}>",
    "experience": f"array<{EXPERIENCE}>",
    "education": f"array<{EDUCATION}>",
    "provenance": f"array<{PROVENANCE}>",
    "overall_confidence": "double",
}
_PLAIN = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _parsed(kind: str) -> T.DataType:
    """The type that a type string of this module means; needs no session, unlike Spark's own parser."""
    if kind.startswith("array<"):
        return T.ArrayType(_parsed(kind[6:-1]))
    if kind.startswith("struct<"):
        parts, depth = [""], 0
        for ch in kind[7:-1]:
            depth += (ch == "<") - (ch == ">")
            if ch == "," and not depth:
                parts.append("")
            else:
                parts[-1] += ch
        return T.StructType([T.StructField(n, _parsed(t)) for n, _, t in (p.partition(":") for p in parts)])
    return _PLAIN[kind]


PROFILE = T.StructType([T.StructField(n, _parsed(t)) for n, t in FIELDS.items()])
#: Profiles with the global position that all order-dependent rules refer to.
ORDERED_PROFILE = T.StructType([*PROFILE.fields, T.StructField("ord", T.LongType())])


def empty(kind: str) -> Column:
    """An empty array of the given element type."""
    return F.array().cast(f"array<{kind}>")


def as_list(value: Column, kind: str, where: Column | None = None) -> Column:
    """[value] if it is not null (or ``where`` holds), else []."""
    return F.when(value.isNotNull() if where is None else where, F.array(value.cast(kind))).otherwise(empty(kind))


def provenance(source: str, *entries: tuple[str, Column, Column | str]) -> Column:
    """Entries (field, whether it is present, method) of one source, those present, in order."""
    listed = [F.when(there, F.struct(F.lit(field).alias("field"), F.lit(source).alias("source"), (F.lit(method) if isinstance(method, str) else method).alias("method"))) for field, there, method in entries]
    return F.filter(F.array(*listed), lambda e: e.isNotNull()).cast(f"array<{PROVENANCE}>")


def share(parts: list[Column]) -> Column:
    """The share of conditions that hold: the confidence of a source's record."""
    return sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts), F.lit(0)) / F.lit(float(len(parts)))


def filled(array: Column) -> Column:
    return F.size(array) > 0


def source_tag() -> Column:
    """The source of a record is that of its first provenance entry."""
    return F.coalesce(F.get(F.col("provenance"), F.lit(0))["source"], F.lit("unknown"))
