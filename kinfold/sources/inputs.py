"""Inputs: what kind a path is, and all inputs as one ordered DataFrame of profiles."""

from __future__ import annotations

import datetime
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.positions import AT, unique, with_ord
from kinfold.operators.rejects import REJECT, rejects
from kinfold.schema import FIELDS, ORDERED_PROFILE
from kinfold.scratch import Scratch
from kinfold.sources import ats_json, csv, github, resume

KINDS = ("csv", "ats_json", "github", "resume")
SUFFIXES = {".csv": "csv", ".json": "ats_json", ".pdf": "resume", ".docx": "resume"}


def detect(path: str) -> str | None:
    """The kind of a path or URL; null if it does not tell, as for plain text."""
    low = path.strip().lower()
    return "github" if "github.com" in low else SUFFIXES.get(os.path.splitext(low)[1])


@dataclass
class Input:
    path: str
    kind: str | None = None

    def __post_init__(self) -> None:
        self.kind = self.kind or detect(self.path)

    @staticmethod
    def parse(spec: str) -> Input:
        """path[:kind]; what follows the last colon counts only if it is a kind, so URLs stay whole."""
        path, _, kind = spec.rpartition(":")
        return Input(path, kind) if path and kind in KINDS else Input(spec)


@dataclass
class Extracted:
    """All profiles; the inputs, or their files, that gave none; and what was left out inside them (REJECT and input)."""

    profiles: DataFrame
    skipped: list[tuple[str, str]] = field(default_factory=list)
    rejects: DataFrame | None = None


def read_one(spark: SparkSession, item: Input, as_of_year: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Profiles, and what was left out."""
    if item.kind == "csv":
        return csv.read_noted(spark, item.path)
    if item.kind == "ats_json":
        return ats_json.read_noted(spark, item.path)
    if item.kind == "resume":
        return resume.read_noted(spark, item.path, as_of_year or datetime.date.today().year)
    if "github.com" not in item.path.lower() and not re.fullmatch(r"[A-Za-z0-9-]+", item.path.strip()):
        return github.read_noted(spark, item.path)  # captured payloads
    name = spark.createDataFrame([(item.path,)], "raw string").select(github.username(F.col("raw"))).first()[0]
    place = F.struct(F.lit(item.path).alias("file"), F.lit(0).alias("start"), F.lit(0).alias("pos")).cast(AT)
    fetched = Scratch(spark, "live").save(github.live(spark, [name] if name else []), "live")
    return github.profiles(github.payloads_of(fetched).withColumn("at", place)), rejects(fetched.filter("problem IS NOT NULL"), F.lit(item.path), F.lit(None), F.col("problem"))


def read_all(spark: SparkSession, items: list[Input], as_of_year: int | None = None) -> Extracted:
    """All profiles, with ord: the inputs in the caller's order, a folder's files by name, records in each file's.

    Every input is read and saved before the next.  One of unknown kind, or that can't be opened or
    read to its end, adds no rows and is named in ``skipped``; so are, by number and first name, the files
    of an input that could be opened but hold nothing that can be read.  ``rejects`` has each of those files,
    and each row, item and document that gave no profile, with its reason.
    """
    scratch = Scratch(spark, "inputs")
    out, left, skipped = None, spark.createDataFrame([], f"input int, {REJECT}"), []
    for i, item in enumerate(items):
        if item.kind not in KINDS:
            skipped.append((item.path, "unknown kind"))
            continue
        try:
            found, rejected = read_one(spark, item, as_of_year)
            found = scratch.save(found.withColumn("input", F.lit(i)).select(*FIELDS, "input", "at"), f"input-{i}")
            if rejected is not None:
                rejected = scratch.save(rejected.select(F.lit(i).alias("input"), "file", "pos", "reason"), f"rejects-{i}")
                for row in rejected.filter("pos IS NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("file").alias("file")).orderBy("reason").collect():
                    skipped.append((item.path, row["reason"] + (f": {row['file']}" if row["n"] == 1 else f": {row['n']} files, first {row['file']}")))
                left = left.unionByName(rejected)
        except Exception as error:  # noqa: BLE001  one bad input does not stop the others
            scratch.drop(f"input-{i}")
            skipped.append((item.path, str(error).strip().splitlines()[0]))
            continue
        out = found if out is None else out.unionByName(found)
    if out is None:
        return Extracted(spark.createDataFrame([], ORDERED_PROFILE), skipped, left)
    return Extracted(unique(with_ord(out, scratch).select(*ORDERED_PROFILE.names), scratch), skipped, left)
