"""From inputs to records: read, cluster, merge, project, write."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import matching, project, survivorship
from kinfold.plans.config import checked
from kinfold.scratch import Scratch
from kinfold.sources.inputs import Extracted, Input, read_all


def canonical(profiles: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One record per person, with ord: the position of the person's first record."""
    scratch = scratch or Scratch(profiles.sparkSession, "profiles")
    saved = scratch.save(profiles, "profiles")
    merged = survivorship.merge(scratch.save(matching.clusters(saved, scratch), "clustered"), scratch)
    scratch.drop("profiles", "keys")
    return merged


def run(spark: SparkSession, items: list[Input], config: dict, as_of_year: int | None = None) -> tuple[DataFrame, Extracted]:
    """Projected records (ordered by ord when collected) and what was extracted, with the inputs that were skipped."""
    checked(config)
    extracted = read_all(spark, items, as_of_year)
    return project.project(canonical(extracted.profiles), config), extracted


def _plain(value: object) -> object:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def to_dicts(rows: list[Row], config: dict) -> list[dict]:
    """Rows as JSON objects: whole numbers without a fraction, and missing keys left out under "omit"."""
    numbers = [e["path"] for e in config["fields"] if e.get("type") == "number"]
    omitted = [e["path"] for e in config["fields"]] if config.get("on_missing") == "omit" else []
    out = []
    for row in rows:
        record = _plain(row)
        record.pop("ord", None)
        for path in numbers:
            owner, leaf = _owner(record, path)
            if owner is not None and isinstance(owner.get(leaf), float) and owner[leaf].is_integer():
                owner[leaf] = int(owner[leaf])
        for path in omitted:
            owner, leaf = _owner(record, path)
            if owner is not None and owner.get(leaf) is None:
                owner.pop(leaf, None)
                _prune(record, path)
        out.append(record)
    return out


def _owner(record: dict, path: str) -> tuple[dict | None, str]:
    *parents, leaf = path.split(".")
    for p in parents:
        record = record.get(p) if isinstance(record, dict) else None
    return (record if isinstance(record, dict) else None), leaf


def _prune(record: dict, path: str) -> None:
    """Drop parents of an omitted path that are empty now."""
    parts = path.split(".")[:-1]
    while parts:
        owner, leaf = _owner(record, ".".join(parts))
        if owner is None or owner.get(leaf):
            return
        owner.pop(leaf, None)
        parts.pop()


def write_json(canonical: DataFrame, config: dict, folder: str) -> None:
    """Records in the shape of the configuration as JSON lines, in order, written by the workers to a folder."""
    lines = project.json_rows(canonical, config)
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("json").write.mode("errorifexists").text(folder)


def write_array(canonical: DataFrame, config: dict, path: str) -> None:
    """Records in the shape of the configuration as one indented JSON array in one file, byte by byte as Python's json writes it.

    The workers write the parts of the array in order, each with the separators it needs; the parts are
    then joined on the file system, as a stream of bytes that no process holds.
    """
    scratch = Scratch(canonical.sparkSession, "array")
    texts = scratch.save(project.indented_rows(canonical, config), "texts")
    _write_list(texts.withColumn("json", F.concat(F.lit("  "), "json")), scratch, path, "[\n", "\n]\n", "[]\n")


def write_envelope(canonical: DataFrame, config: dict, config_name: str, extracted: Extracted, path: str) -> None:
    """A service's reply in one file: the records, one a line, their number, the inputs that were skipped and the configuration's name."""
    scratch = Scratch(canonical.sparkSession, "envelope")
    texts = scratch.save(project.json_rows(canonical, config), "texts")
    skipped = [{"file": file, "reason": reason} for file, reason in extracted.skipped]
    about = json.dumps({"count": texts.count(), "skipped_files": skipped, "config_used": config_name}, ensure_ascii=False)
    head, tail = '{"candidates": [\n', "\n], " + about[1:] + "\n"
    _write_list(texts, scratch, path, head, tail, head + tail)


def _write_list(texts: DataFrame, scratch: Scratch, path: str, head: str, tail: str, empty: str) -> None:
    """The texts (ord, json) with commas between them, in order, as one file with a head and a tail."""
    first, last = texts.agg(F.min("ord"), F.max("ord")).first()
    # a text file ends each of its rows with a line break: every record but the last one brings the comma before it
    lines = texts.select("ord", F.concat("json", F.when(F.col("ord") == last, "").otherwise(",")).alias("value"))
    place = f"{scratch.root}/parts"
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.text(place)
    # the last row's line break is the tail's first
    join_parts(texts.sparkSession, place, path, empty if first is None else head, "" if first is None else tail.removeprefix("\n"))


def join_parts(spark: SparkSession, folder: str, path: str, head: str = "", tail: str = "") -> None:
    """The files that a job wrote to a folder as one file, in their order, between a head and a tail."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    system, out_system = source.getFileSystem(conf), target.getFileSystem(conf)
    parts = sorted((f.getPath() for f in system.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())
    out = out_system.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for part in parts:
            read = system.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            finally:
                read.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()


def json_array(canonical: DataFrame, config: dict) -> Iterator[str]:
    """The pieces of one JSON array of all records, in order; one partition at a time reaches the driver."""
    before = "[\n  "
    for row in project.json_rows(canonical, config).orderBy("ord").toLocalIterator():
        yield before + row["json"]
        before = ",\n  "
    yield "[]" if before.startswith("[") else "\n]"


def to_json(records: DataFrame, config: dict) -> str:
    """All projected records, in order, as one JSON array in memory: for few records; see json_array and write_json."""
    return json.dumps(to_dicts(records.orderBy("ord").collect(), config), indent=2, ensure_ascii=False)


def envelope(records: DataFrame, extracted: Extracted, config: dict, config_name: str) -> dict:
    """The records with their number, the inputs that were skipped and the configuration's name, as a service replies."""
    found = to_dicts(records.orderBy("ord").collect(), config)
    skipped = [{"file": path, "reason": reason} for path, reason in extracted.skipped]
    return {"candidates": found, "count": len(found), "skipped_files": skipped, "config_used": config_name}
