"""The rows of delimited files of any size, found by all tasks at once.

Quoted cells may hold line breaks, so a line tells nothing about where rows begin.  Spark reads lines
and tasks join these to blocks.  A block begins where a row does or inside a quoted cell; it is saved
with what it makes of either (inside or not at its end), and these effects are composed over the
blocks of a file.  With the state that each block begins in, its rows are read; a row that blocks
divide is put together first.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.operators.components import counted_side
from kinfold.scratch import Scratch
from kinfold.sources.files import FILE

#: Bytes of a block, and what may stand before a file's first character.
BLOCK_BYTES, BOM = 4_000_000, b"\xef\xbb\xbf"
#: A quotation mark opens a cell at the cell's beginning only; doubled ones do not close it.
OPEN, REST = re.compile(rb'(?:(?<=[,\n])|\A)"'), re.compile(rb'(?:[^"]++|"")*+"')
BLOCKS = f"{FILE} string, start long, block int, data binary, outside_ends_inside boolean, inside_ends_inside boolean"
#: A row read in a block (its number among those that end there, its cells), or a part of one that blocks divide (text; whether the row begins there).
ROWS = f"{FILE} string, start long, block int, k long, cells array<string>, part binary, begins boolean"


def row_ends(data: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of the line breaks that end rows, and whether the end lies inside a quoted cell."""
    spans, at = [], 0
    while True:
        if not inside:
            found = OPEN.search(data, at)
            if found is None:
                break
            at = found.end()
        closed = REST.match(data, at)
        spans += [at, closed.end() if closed else len(data)]
        inside = closed is None
        if inside:
            break
        at = closed.end()
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    return breaks[np.searchsorted(np.array(spans, np.int64), breaks, "right") % 2 == 0], inside


def read_rows(data: bytes) -> Iterator[list[str]]:
    """Cells of each row that is no empty line."""
    csv.field_size_limit(1 << 31)
    return (row for row in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline="")) if row)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, size, number = None, [], 0, 0

    def block() -> pa.RecordBatch:
        data = b"".join(held)
        data = data if number or key[1] else data.removeprefix(BOM)
        values = (*key, number, data, row_ends(data, False)[1], row_ends(data, True)[1])
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split(" ")[0] for c in BLOCKS.split(", ")])

    for batch in batches:
        for *now, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (now != key or size > BLOCK_BYTES):
                yield block()
                held, size, number = [], 0, number + 1
            if now != key:
                key, number = now, 0
            held += [line, b"\n"]
            size += len(line) + 1
    if held:
        yield block()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS of blocks that also have inside."""
    for batch in batches:
        for file, start, block, data, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends, still = row_ends(data, inside)
            first = (int(ends[0]) + 1 if len(ends) else len(data)) if inside else 0
            last = int(ends[-1]) + 1 if len(ends) else first
            out, k = [], 0
            if inside:
                out.append((None, None, data[:first], False))
            for cells in read_rows(data[first:last]):
                out.append((k, cells, None, None))
                k += 1
            if still and last < len(data):
                out.append((k, None, data[last:], True))
            for a in range(0, len(out), 10_000):
                some = out[a : a + 10_000]
                place = [pa.array([v] * len(some), t) for v, t in ((file, pa.string()), (start, pa.int64()), (block, pa.int32()))]
                kinds = (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays(place + [pa.array(x, t) for x, t in zip(zip(*some, strict=True), kinds, strict=True)], [c.split(" ")[0] for c in ROWS.split(", ")])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FILE, n and cells of rows put together: FILE, n, data."""
    for batch in batches:
        rows = [next(read_rows(data), []) for data in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.string()))], [FILE, "n", "cells"])


def rows(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """FILE, n (from 0 in each file, empty lines not counted) and cells of all rows of all files below a path, saved."""
    meta = F.col("_metadata")
    lines = spark.read.text(path, wholetext=False, recursiveFileLookup=True)
    lines = lines.select(meta["file_path"].alias(FILE), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("line"))
    blocks = scratch.save(lines.mapInArrow(_blocks, BLOCKS), "blocks")
    key = [FILE, "start", "block"]
    order = Window.partitionBy(FILE).orderBy("start", "block")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # effects are constant (0 or 1 at the end, whatever the beginning), keep the state or turn it; since the last constant one, turns count
    fixed = F.col("outside_ends_inside") == F.col("inside_ends_inside")
    turns = F.when(~fixed, F.col("outside_ends_inside").cast("int")).otherwise(0)
    told = blocks.drop("data").withColumn("total", F.coalesce(F.sum(turns).over(so_far), F.lit(0)))
    since = F.last(F.when(fixed, F.struct(F.col("outside_ends_inside").cast("int").alias("state"), F.col("total"))), ignorenulls=True).over(so_far)
    states = told.withColumn("since", since).select(*key, ((F.coalesce("since.state", F.lit(0)) + F.col("total") - F.coalesce("since.total", F.lit(0))) % 2 == 1).alias("inside"))
    states = scratch.save(states, "states")
    found = blocks.join(counted_side(states), key).select(*key, "data", "inside").mapInArrow(_rows, ROWS)
    found = scratch.save(found, "found")
    scratch.drop("blocks")
    sizes = found.groupBy(*key).agg(F.count("k").alias("n"))
    firsts = scratch.save(sizes.select(*key, F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before")), "firsts")
    placed = found.join(counted_side(firsts), key).withColumn("n", F.col("before") + F.coalesce("k", F.lit(-1)))
    parts = placed.filter(F.col("part").isNotNull()).groupBy(FILE, "n").agg(F.sort_array(F.collect_list(F.struct("start", "block", "part"))).alias("parts"))
    joined = F.aggregate(F.transform("parts", lambda p: F.hex(p["part"])), F.lit(""), lambda a, b: F.concat(a, b))
    whole = parts.select(FILE, "n", F.unhex(joined).alias("data")).mapInArrow(_whole, f"{FILE} string, n long, cells array<string>")
    return scratch.save(placed.filter(F.col("cells").isNotNull()).select(FILE, "n", "cells").unionByName(whole), "rows")
