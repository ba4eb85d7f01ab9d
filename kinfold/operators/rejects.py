"""What a step leaves out, and why: rows beside a result instead of rows that vanish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A file or input, the place in it (null for the whole), and why nothing came of it.
REJECT = "file string, pos long, reason string"


def rejects(rows: DataFrame, file: Column, pos: Column, reason: Column) -> DataFrame:
    return rows.select(file.cast("string").alias("file"), pos.cast("long").alias("pos"), reason.cast("string").alias("reason"))


def counted(found: DataFrame) -> DataFrame:
    """reason and n: how many rows each reason left out."""
    return found.groupBy("reason").agg(F.count("*").alias("n"))
