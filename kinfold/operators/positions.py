"""One order over all inputs: every record gets a position of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from kinfold.operators.components import counted_side
from kinfold.scratch import Scratch

#: Where a record comes from: its file, the offset of the part of it that one task read, the place in that part.
AT = "struct<file:string,start:bigint,pos:bigint>"


def with_ord(records: DataFrame, scratch: Scratch) -> DataFrame:
    """records with ord instead of input (int) and at (AT): unique, in the order of input, file, start and pos.

    The parts of files are range partitioned and counted up, so that no task sees all of them; what
    one task sees whole are the sums of the ranges.
    """
    order = ["input", "file", "start"]
    parts = records.groupBy("input", F.col("at.file").alias("file"), F.col("at.start").alias("start")).agg(F.min("at.pos").alias("low"), (F.max("at.pos") - F.min("at.pos") + 1).alias("n"))
    parts = parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    parts = scratch.save(parts, "parts")
    ranges = parts.groupBy("range").agg(F.sum("n").alias("all"))
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("all").over(so_far), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(ranges), "range")
    starts = scratch.save(starts.select("input", "file", "start", (F.col("before") + F.col("inside") - F.col("low")).alias("first")), "starts")
    placed = records.withColumns({"file": F.col("at.file"), "start": F.col("at.start")}).join(counted_side(starts), order)
    return placed.withColumn("ord", F.col("first") + F.col("at.pos")).drop(*order, "first", "at")


def unique(records: DataFrame, scratch: Scratch, name: str = "ordered") -> DataFrame:
    """records, saved; an error if two of them have one ord: readers promise a place of its own to each.

    Records with one ord meet in a task by their hash; only how many there are reaches the driver.
    """
    seen = Observation()
    saved = scratch.save(records.observe(seen, F.count("*").alias("n"), F.count_if(F.col("ord").isNull()).alias("none")), name)
    different = saved.select("ord").distinct().count()
    if seen.get["none"] or different != seen.get["n"]:
        raise ValueError(f"{seen.get['n']} records have {different} positions")
    return saved
