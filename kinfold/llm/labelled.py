"""Bounded samples of labelled documents for the classifiers, and the folds they may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A classifier learns from so many labelled documents at most: those of the lowest hash of doc_id.
SAMPLE = 12_000


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 0 by 5.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``rows`` labelled documents that aren't held out.

    Labels other than 0 and 1 and null ones are left out; an id labelled twice counts as 1 if one label does.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
