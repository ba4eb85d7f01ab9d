"""Exact duplicates by content-defined chunk recipes; DataFrame functions only.

Each text is cut where its own characters say so.  Equal chunks become one identifier: the 64-bit
hash of the chunk, with an ordinal for the (hardly ever) several different chunks of one hash, which
are found by comparing the chunks themselves.  A document is then the ordered list of its chunks'
identifiers, its recipe, and documents are compared and moved as recipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import KEY, marked, with_key
from kinfold.scratch import Scratch

# Letters that about every second word of an alphabet ends with.
VOWELS = "aeiouyàáâäèéêëìíïòóôöùúüαεηιουωаеёиоуыэюяאהוית" + "ايهةوی"
#: In scripts that may have no blanks, the first quarter of each row of 32 (India to Georgia) or 1024 (East Asia) code points.
QUARTERS = "".join(rf"\x{{{b:X}}}-\x{{{b + step // 4 - 1:X}}}" for low, high, step in ((0x0900, 0x1100, 32), (0x2C00, 0xD800, 1024)) for b in range(low, high, step))
#: A chunk has LEAST to MOST characters and ends where its text says so: after a vowel and a blank before none, or at the end of a quarter.
LEAST, MOST = 512, 2048
CHUNK = rf"(?s).{{{LEAST - 3},{MOST - 3}}}?(?:[{VOWELS}][ \n\t][^{VOWELS} \n\t]|(?=[\x{{900}}-\x{{FFFF}}])[{QUARTERS}][^{QUARTERS}])|.{{1,{MOST}}}"


def chunks(text: Column) -> Column:
    """The chunks of a text; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def collisions(docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Chunks whose 64-bit hash a different chunk has too: digest, chunk, ordinal from 0; None if there are none.

    Every chunk of every row is compared: equal ones meet map-side, each distinct one is shuffled once.
    """
    parts = docs.select(F.explode(chunks(F.coalesce(F.col("text"), F.lit("")))).alias("chunk")).select(F.xxhash64("chunk").alias("digest"), "chunk")
    several = parts.distinct().groupBy("digest").count().filter("count > 1").select("digest")
    several = scratch.save(several, "clashes")
    if several.isEmpty():
        return None
    found = parts.join(several, "digest").distinct().groupBy("digest").agg(F.array_sort(F.collect_list("chunk")).alias("all"))
    return scratch.save(found.select("digest", F.posexplode("all").alias("ordinal", "chunk")).filter("ordinal > 0"), "ordinals")


def recipes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """KEY, doc_id, text_sha256 and recipe of each row of docs (which has KEY), saved.

    A recipe is the ordered list of struct(digest, ordinal); an empty text has an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    clash = collisions(docs, scratch)
    plain = docs.select(KEY, "doc_id", F.sha2(text, 256).alias("text_sha256"), chunks(text).alias("chunks"))
    if clash is None:
        listed = plain.select(KEY, "doc_id", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"))
        return scratch.save(listed.withColumn("ordinals", F.lit("")), "recipes")
    at = plain.select(KEY, F.posexplode("chunks").alias("at", "chunk")).join(clash, "chunk")
    odd = at.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("at", "ordinal"))).cast("string").alias("ordinals"))
    listed = plain.select(KEY, "doc_id", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe")).join(odd, KEY, "left")
    return scratch.save(listed.withColumn("ordinals", F.coalesce("ordinals", F.lit(""))), "recipes")


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: KEY, doc_id, keep_id, group_size, kept, text_sha256.

    Needs doc_id and text; other columns, of whatever name, are not read.  Null text counts as
    empty.  Of equal texts the row with the largest doc_id stays (null is below all others); of rows
    that repeat the same doc_id and text, the last in the input's files.  An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    return _groups(with_key(docs.select("doc_id", "text"), scratch), scratch)


def _groups(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    listed = recipes(keyed, scratch)
    same = listed.groupBy("recipe", "ordinals").agg(F.max(F.struct("doc_id", KEY)).alias("best"), F.count("*").alias("n")).filter("n > 1")
    same = scratch.save(same, "groups").select(F.col("recipe").alias("__r"), F.col("ordinals").alias("__o"), "best", "n")
    out = listed.join(same, (F.col("recipe") == F.col("__r")) & (F.col("ordinals") == F.col("__o")), "left")
    single = F.col("n").isNull()
    return out.select(
        KEY,
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col(f"best.{KEY}") == F.col(KEY))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns of docs; ties and nulls as in groups().

    A column by the name of KEY is kept as it is.  Texts are not shuffled: rows go by bitmaps of their places.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    own = docs.withColumnRenamed(KEY, f"{KEY}_given")
    keyed = with_key(own, scratch)
    gone = _groups(keyed.select(KEY, "doc_id", "text"), scratch).filter(~F.col("kept")).select(KEY)
    kept = marked(keyed, gone, scratch, "gone", keep=False).drop(KEY).withColumnRenamed(f"{KEY}_given", KEY)
    scratch.drop("recipes", "groups", "clashes", "ordinals")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
