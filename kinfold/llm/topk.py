"""Exact search of the k highest inner products.

Queries go to the workers in blocks of bounded size, one after the other; each task multiplies a
block with tiles of its shard, selects k per query and tile, and keeps the best k.  A block's lists
are saved and its broadcast ends before the next block starts.  The lists are merged in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.scratch import Scratch

#: Numbers in a block of queries that is broadcast, and rows of a tile of candidates and of queries.
BLOCK_NUMBERS, TILE_ROWS, TILE_QUERIES = 1 << 22, 1024, 4096
LARGEST = 2**63 - 1


def valid_vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vec_id and v, the vector as doubles; without rows whose vector is null or holds a null or non-finite component."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.filter(F.col(embedding).isNotNull() & fine).select("vec_id", x.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(q: np.ndarray, x: np.ndarray, scale: int = 64) -> np.ndarray:
    """Exact inner products of floor(scale * component): in floating point while all partial sums stay below 2^53, else in Python's integers, held to 64 bits."""
    with np.errstate(over="ignore"):
        a, b = np.floor(scale * q), np.floor(scale * x)
        bound = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, q.shape[1])
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(lambda e: math.floor(scale * e) if abs(e) < 2.0**53 else scale * int(e), otypes=[object])
    exact = whole(q) @ whole(x).T
    return np.vectorize(lambda s: max(-LARGEST, min(LARGEST, s)), otypes=[np.int64])(exact)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to smaller ids; both arrays have a row for each query."""
    order = np.argsort(ids, axis=1, kind="stable")
    score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    order = np.argsort(~score, axis=1, kind="stable")[:, :k]  # ~ does not overflow
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def tile_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As best_of, for a tile whose columns (ids) ascend: partial selection instead of a full sort."""
    if score.shape[1] <= k:
        return best_of(score, np.broadcast_to(ids, score.shape), k)
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k, None]
    above, equal = score > kth, score == kth
    take = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))
    at = np.nonzero(take)[1].reshape(len(score), k)
    return best_of(np.take_along_axis(score, at, 1), ids[at], k)


NONE = -(2**63)  # the score of no candidate


def top_k(df: DataFrame, k: int = 20, every: int = 20, embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, all if fewer.

    Queries are rows whose vec_id is divisible by ``every``; candidates are all other rows of valid
    vectors, each row being its own, so a repeated row finds its twin.  Ties go to the smaller
    vec_id; a null vec_id is no query and, as a candidate, comes last.  Vectors of different length
    count as padded with zeros.  Scores beyond 64 bits are held at the limit.  Other columns of df
    are not read; an empty df gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.save(valid_vectors(df, embedding).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    blocks = max(1, math.ceil(n * width / BLOCK_NUMBERS))
    lists = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("vec_id", "uid", "v").toArrow()
        sent = spark.sparkContext.broadcast((part["uid"].to_numpy(), part["vec_id"].to_numpy(), matrix(part["v"], width)))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, names, q = sent.value
            best = np.full((len(q), k), NONE), np.full((len(q), k), LARGEST)
            for batch in batches:
                for start in range(0, batch.num_rows, TILE_ROWS):
                    tile = batch.slice(start, TILE_ROWS)
                    ids, uids = tile["vec_id"].fill_null(LARGEST).to_numpy(), tile["uid"].to_numpy()
                    order = np.lexsort((uids, ids))
                    ids, uids, x = ids[order], uids[order], matrix(tile["v"], q.shape[1])[order]
                    for at in range(0, len(q), TILE_QUERIES):
                        these = slice(at, at + TILE_QUERIES)
                        s = products(q[these], x, scale)
                        s[own[these, None] == uids] = NONE
                        s, found = tile_best(s, ids, k)
                        merged = best_of(np.hstack([best[0][these], s]), np.hstack([best[1][these], found]), k)
                        best[0][these], best[1][these] = merged
            real = best[0] != NONE
            keep = real.any(axis=1)
            counts = real[keep].sum(axis=1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            hits = [pa.ListArray.from_arrays(offsets, pa.array(x[keep][real[keep]], pa.int64())) for x in (best[1], best[0])]
            yield pa.RecordBatch.from_arrays([pa.array(own[keep], pa.int64()), pa.array(names[keep], pa.int64()), *hits], ["uid", "query_id", "ids", "scores"])

        found = rows.select("uid", "vec_id", "v").mapInArrow(score, "uid long, query_id long, ids array<long>, scores array<long>")
        found = scratch.save(found.withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(64))), f"lists-{b}")
        sent.destroy()
        lists = found if lists is None else lists.unionByName(found)
    each = lists.select("uid", "query_id", "shard", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
    each = each.select("uid", "query_id", "shard", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    for keys in (["uid", "shard"], ["uid"]):  # the merge tree: shards of tasks first, then queries
        each = each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return each.select("query_id", "rank", F.when(F.col("vec_id") != LARGEST, F.col("vec_id")).alias("vec_id"), "score")
