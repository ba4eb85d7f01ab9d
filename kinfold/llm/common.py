"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.scratch import Scratch

#: A word is a longest run of characters other than these: space, and U+0009 to U+000D.
BLANKS = "\t\n\x0b\x0c\r "
#: str.translate table that turns each of them into a space, so that str.split(" ") is exact.
TO_SPACE = {ord(c): " " for c in BLANKS}
#: The largest number of rows that an operator broadcasts as a lookup; beyond, it joins by shuffle.
BROADCAST_ROWS = 200_000
#: Name of the row identity that with_key adds.
KEY = "__row_key"
#: Rows that a bitmap of marked() tells about, and the most bytes of bitmaps that are broadcast at once.
BITS, BITMAP_BYTES = 1 << 15, 64 << 20


def words_of(text: str) -> list[str]:
    """The words of a text, in order."""
    return [w for w in text.translate(TO_SPACE).split(" ") if w] if text else []


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of all words of the texts, one text after the other, the place in the different words; the texts' numbers of words; the different words.

    Null texts have none.  Arrow's ASCII white space is space and U+0009 to U+000D.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null("")))
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    sizes = np.diff(np.concatenate([[0], np.cumsum(filled)])[ends])
    found = flat.filter(pa.array(filled)).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), sizes, found.dictionary.to_numpy(zero_copy_only=False).tolist()


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), without building them: the starts of words are counted."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(flat, "[^w]+", "")).cast("long")


def with_key(docs: DataFrame, scratch: Scratch, name: str = "keyed") -> DataFrame:
    """docs with one more column KEY, struct(f, r), that tells apart all rows, repeated ones too.

    It is the file and the position in it that a Parquet scan knows; any other DataFrame is written first.
    A column of docs by that name is not read.
    """
    plain = docs.drop(KEY)
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias(KEY)
    try:
        return plain.select("*", place)
    except AnalysisException:
        return scratch.save(plain, name).select("*", place)


def marked(keyed: DataFrame, keys: DataFrame, scratch: Scratch, name: str, keep: bool) -> DataFrame:
    """Rows of keyed whose KEY is among keys (keep), or those whose KEY is not; no row of keyed is shuffled.

    The keys become bitmaps, one for each file and BITS successive rows, that are broadcast.  Should
    they take more than BITMAP_BYTES, the files are dealt into slices: each slice's rows are saved before
    the next slice's bitmaps are broadcast, so that BITMAP_BYTES bounds what a process holds; every file
    is still read once.
    """
    own, m = F.col(KEY), free("__marks", keyed)
    bucket, bit = F.shiftright(own["r"], 15), own["r"].bitwiseAND(BITS - 1)
    bits = keys.groupBy(own["f"].alias("file"), bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    bits = scratch.save(bits, name)
    slices = max(1, math.ceil(bits.count() * (BITS // 8) / BITMAP_BYTES))
    byte = F.conv(F.hex(F.substring(F.col(f"{m}.bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, bit.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    out = None
    for i in range(slices):
        mine = lambda file: F.pmod(F.xxhash64(file), F.lit(slices)) == i if slices > 1 else F.lit(True)  # noqa: E731, B023
        side = F.broadcast(bits.filter(mine(F.col("file"))).select(F.struct("file", "bucket", "bits").alias(m)))
        part = keyed.filter(mine(own["f"]))
        part = part.join(side, (own["f"] == F.col(f"{m}.file")) & (bucket == F.col(f"{m}.bucket")), "left").filter(hit if keep else ~hit).drop(m)
        if slices > 1:
            part = scratch.save(part, f"{name}-{i}")
            gc.collect()  # the driver's references keep a broadcast alive
        out = part if out is None else out.unionByName(part)
    return out


def free(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has been counted and is small; else joins shuffle it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def global_rank(df: DataFrame, order: list[Column], name: str, scratch: Scratch, label: str) -> DataFrame:
    """df, saved, with its 0-based position in the given order; no task sees more than a range of it.

    The rows are range partitioned and sorted; only one count for each partition reaches the driver.
    """
    saved = scratch.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), label)
    part = F.shiftright(F.col(name), 33)
    before, total = {}, 0
    for row in saved.groupBy(part.alias("p")).count().orderBy("p").collect():
        before[row["p"]] = total
        total += row["count"]
    if not before:
        return saved
    offsets = F.broadcast(saved.sparkSession.createDataFrame(list(before.items()), "__p long, __before long"))
    ranked = saved.join(offsets, part == F.col("__p"))
    return ranked.withColumn(name, F.col("__before") + F.col(name).bitwiseAND((1 << 33) - 1)).drop("__p", "__before")


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text at most, so that workers stay small."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        for i, n in enumerate(pc.binary_length(text).to_pylist()):
            if size and size + (n or 0) > chars:
                yield batch.slice(start, i - start)
                release()
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
            release()


def release() -> None:
    """Give freed memory back to the machine: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def gives_back(function: Callable) -> Callable:
    """Decorates what workers run on batches (mapInArrow): at the end of a task, freed memory goes back.

    Workers stay alive between stages; without this an idle one keeps what its largest task needed.
    """

    @functools.wraps(function)
    def wrapped(*given: object) -> Iterator:
        try:
            yield from function(*given)
        finally:
            gc.collect()
            release()

    return wrapped
