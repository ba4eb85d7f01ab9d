"""Similarity join of documents on word n-grams: a MinHash LSH forest, then exact verification.

Texts of one shingle set are one class.  Each tree of the forest is the trie of the signatures of
the classes' representatives, DEPTH minimum hashes long: texts with a prefix in common share a node.
Prefixes are shortened until all trees together find a pair at the threshold with the wanted recall,
which takes most nodes to depth ``shortest``.  A node that is still full there is left at the depth at
which it splits, as long as the other trees keep the recall of each of its texts.  Texts of shared nodes form components.
A small component is verified whole; of a large one, only the texts of each node, unless that is more
work.  All verification is exact, in tiles of bounded size, as sums of products of shingle matrices; a
tile returns counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import KEY, gives_back, marked, slices, small_side, with_key
from kinfold.operators.components import connected_components
from kinfold.scratch import Scratch

WIDTH, THRESHOLD = 5, 0.8
#: Trees, the length of their signatures, and the share of pairs at the threshold that the forest has to find.
TREES, DEPTH, RECALL = 20, 8, 0.999
#: A node beyond FULL texts is full.
FULL = 64
#: A component or node beyond WHOLE texts, or so many shingles, is verified in tiles of two blocks.
WHOLE, BLOCK, BLOCK_SHINGLES = 256, 128, 1_000_000
COLUMNS = 4096
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FACTORS = np.random.default_rng(11).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall_of(threshold: float, depths: list[int]) -> float:
    """The share of pairs at the threshold that share a node in a tree, the trees being cut at these depths."""
    return 1 - math.prod(1 - threshold**d for d in depths)


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The depth that prefixes are shortened to, from ``depth`` on, until the recall is reached (or 1)."""
    length = depth
    while length > 1 and recall_of(threshold, [length] * trees) < recall:
        length -= 1
    return length


def spare_trees(threshold: float, trees: int, length: int, depth: int, recall: float) -> int:
    """How many trees may stay at the full depth while the others, at ``length``, keep the recall."""
    return max(n for n in range(trees + 1) if n == 0 or recall_of(threshold, [depth] * n + [length] * (trees - n)) >= recall)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted different 64-bit hashes of each text's runs of ``width`` words; a shorter text is one run, one without words has none."""
    lists = [t.encode().split() if t else [] for t in texts]  # bytes.split(): at space and U+0009 to U+000D
    flat = np.empty(sum(map(len, lists)), dtype=object)
    flat[:] = [w for x in lists for w in x]
    codes, words = pd.factorize(flat)
    word = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[codes] if len(flat) else np.empty(0, np.uint64)
    run = np.zeros(max(len(word) - width + 1, 0), np.uint64)
    for i in range(width):
        run = (run ^ word[i : i + len(run)]) * M1
        run ^= run >> np.uint64(29)
    run *= M2
    run ^= run >> np.uint64(32)
    out, start = [], 0
    for x in lists:
        n = len(x)
        if n >= width:
            out.append(np.unique(run[start : start + n - width + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(word[start : start + n].tobytes(), 1)] if n else [], np.uint64))
        start += n
    return out


def signatures(shingles: np.ndarray, length: int, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """For each tree the hash of the signature's first ``length`` minimum hashes, and the next ones, 16 bits of each; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    factors = FACTORS[: trees * DEPTH]
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * factors).min(axis=0))
    rows = (least >> np.uint64(16)).reshape(trees, DEPTH)
    rest = np.zeros(trees, np.uint64)
    for i, column in enumerate(rows[:, length : length + 4].T):
        rest |= (column & np.uint64(0xFFFF)) << np.uint64(16 * i)
    return np.array([xxhash.xxh64_intdigest(r[:length].tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64), rest.view(np.int64)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, exactly; columns of the incidence matrix are taken in turn."""
    n = len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    several = count[column] > 1
    row, column = row[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), np.float64)
    for start in range(0, int((count > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        total += part @ part.T
    return total.astype(np.int64)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of the threshold or more."""
    least = Fraction(threshold).limit_denominator(1000)
    size, both = np.array([len(s) for s in sets], np.int64), overlaps(sets)
    hits = both * least.denominator >= (size[:, None] + size[None, :] - both) * least.numerator
    np.fill_diagonal(hits, False)
    return hits


def roots(hits: np.ndarray) -> np.ndarray:
    """The smallest index of each index's connected component."""
    label = np.arange(len(hits))
    while True:
        new = np.minimum(label, np.where(hits, label[None, :], len(hits)).min(axis=1, initial=len(hits)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sketches(keyed: DataFrame, width: int, length: int, trees: int) -> DataFrame:
    @gives_back
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            sets = shingle_sets(batch["text"].to_pylist(), width)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            pairs = [signatures(s, length, trees) for s in sets]
            lists = [pa.array([p[i] for p in pairs], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch[KEY], batch["doc_id"], pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *lists], [KEY, "doc_id", "digest", "size", "prefixes", "rest"])

    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    return keyed.select(KEY, "doc_id", "text").mapInArrow(sketch, f"{KEY} {kinds[KEY]}, doc_id {kinds['doc_id']}, digest binary, size long, prefixes array<long>, rest array<long>")


def _forest(cells: DataFrame, scratch: Scratch, length: int, spare: int) -> DataFrame:
    """rep, tree, cell, node, n: the nodes of at least two texts that each text is left in, saved.

    cells has rep, tree, cell (the node at depth ``length``) and rest (the signature's next numbers).
    """
    sizes = scratch.save(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    open_ = scratch.save(cells.join(small_side(sizes, sizes.count()), "cell").select("rep", "tree", "cell", F.col("cell").alias("node"), "rest", "n"), "depth-0")
    full = open_.filter(F.col("n") > FULL)
    texts = scratch.save(full.groupBy("rep").agg(F.count("*").alias("trees")), "full-texts")
    deep = full.join(small_side(texts, texts.count()), "rep").groupBy("cell").agg(F.max("trees").alias("trees"))
    deep = scratch.save(deep.filter(F.col("trees") <= spare).select("cell"), "deepened")
    side = small_side(deep, deep.count())
    done, now = open_.join(side, "cell", "left_anti"), open_.join(side, "cell", "left_semi")
    for step in range(min(4, DEPTH - length) if not deep.isEmpty() else 0):
        child = now.withColumn("node", F.xxhash64("node", F.shiftright("rest", 16 * step).bitwiseAND(0xFFFF), F.lit(step))).drop("n")
        sizes = scratch.save(child.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), f"sizes-{step}")
        now = scratch.save(child.join(small_side(sizes, sizes.count()), "node").select(*open_.columns), f"depth-{step + 1}")
        last = step + 1 == DEPTH - length
        done = done.unionByName(now if last else now.filter(F.col("n") <= FULL))
        now = now.filter(F.col("n") > FULL)
    out = scratch.save(done.drop("rest"), "nodes")
    scratch.drop("sizes", "full-texts", "deepened", *(f"depth-{i}" for i in range(DEPTH)), *(f"sizes-{i}" for i in range(DEPTH)))
    return out


def _tiles(wanted: DataFrame, width: int) -> DataFrame:
    """group, tile, side, node, copies, tree, trees, shingles: each text once for each tile that its block takes part in."""

    @gives_back
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            rows = []
            for row, s in zip(batch.select(["node", "copies", "trees", "groups"]).to_pylist(), shingle_sets(batch["text"].to_pylist(), width), strict=True):
                blob, trees = s.tobytes(), np.array(row["trees"] or [], np.int64).tobytes()
                for g in row["groups"]:
                    b, own = g["blocks"], g["block"]
                    rows += [(g["group"], min(own, k) * b + max(own, k), int(own > k), row["node"], row["copies"], g["tree"], trees, blob) for k in range(b)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.binary()) for c in columns[6:])], ["group", "tile", "side", "node", "copies", "tree", "trees", "shingles"])

    return wanted.select("node", "copies", "trees", "groups", "text").mapInArrow(spread, "group long, tile long, side long, node long, copies long, tree long, trees binary, shingles binary")


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """node, root (the smallest node linked to it in the tile), links (documents), texts (shingle sets) of linked texts."""

    def verify(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("node")
        node, copies, side, tree = (table[c].to_numpy() for c in ("node", "copies", "side", "tree"))
        hits = linked([np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]], threshold)
        if side.any():  # a tile of two blocks: pairs within a block are another tile's
            hits &= side[:, None] != side[None, :]
        if len(tree) and tree[0] > 0:  # the pairs that share a node of an earlier tree are counted there
            nodes = np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in table["trees"]])
            for t in range(int(tree[0])):
                own = nodes[:, t]
                hits &= ~((own[:, None] == own[None, :]) & (own != 0)[:, None])
        some = hits.any(axis=1)
        columns = node[some], node[roots(hits)][some], (hits @ copies)[some], hits.sum(axis=1)[some]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "root", "links", "texts"])

    return tiles.groupBy("group", "tile").applyInArrow(verify, "node long, root long, links long, texts long")


def _blocks(n: str, shingles: str) -> Column:
    whole = (F.col(n) <= WHOLE) & (F.col(shingles) <= 2 * BLOCK_SHINGLES)
    return F.when(whole, 1).otherwise(F.ceil(F.greatest(F.col(n) / BLOCK, F.col(shingles) / BLOCK_SHINGLES))).cast("long")


def _work(texts: DataFrame, nodes: DataFrame, scratch: Scratch, trees: int) -> DataFrame:
    """KEY, node, copies, trees (node of each tree, 0: none), groups (struct of group, tree, blocks, block) of each text to verify, saved.

    texts has node, label, KEY, size, copies; nodes is the forest.  A group is a whole component (its
    label), or, where the component is large and its nodes are less work, a node.  Nodes of the same texts are one group.
    """
    stats = texts.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    stats = scratch.save(stats.withColumn("blocks", _blocks("n", "shingles")), "stats")
    large = stats.filter("blocks > 1")
    base = texts.join(small_side(stats.select("label", "blocks"), stats.count()), "label")
    block = lambda group: F.pmod(F.xxhash64("node", group), F.col("blocks"))
    kind = "array<struct<group:bigint,tree:bigint,blocks:bigint,block:bigint>>"
    if large.isEmpty():
        whole = F.array(F.struct(F.col("label").alias("group"), F.lit(0).alias("tree"), "blocks", block("label").alias("block"))).cast(kind)
        return scratch.save(base.select(KEY, "node", "copies", F.lit(None).cast("array<long>").alias("trees"), whole.alias("groups")), "wanted")
    sized = texts.select(F.col("node").alias("rep"), "label", "size").join(small_side(large.select("label"), large.count()), "label")
    inside = scratch.save(nodes.select("rep", "tree", F.xxhash64("tree", "node").alias("place")).join(sized, "rep"), "inside")
    same = inside.groupBy("place").agg(F.min("tree").alias("tree"), F.first("label").alias("label"), F.count("*").alias("n"), F.sum("size").alias("shingles"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members"), F.min("rep").alias("least"))
    same = scratch.save(same, "places")
    one = same.groupBy("label", "n", "members", "least").agg(F.min_by(F.struct("place", "tree", "shingles"), F.struct("tree", "place")).alias("p"))
    one = scratch.save(one.select("label", "n", "p.*"), "different-places")
    cost = one.groupBy("label").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
    by_node = scratch.save(cost.join(stats, "label").filter(F.col("cost") < F.col("n").cast("double") * F.col("n")).select("label"), "by-node")
    picked = one.join(small_side(by_node, by_node.count()), "label").withColumn("blocks", _blocks("n", "shingles"))
    picked = scratch.save(picked.select("place", F.col("tree").cast("long").alias("tree"), "blocks"), "picked")
    node_groups = inside.join(small_side(picked.drop("tree"), picked.count()), "place").withColumnRenamed("rep", "node")
    node_groups = node_groups.groupBy("node").agg(
        F.collect_list(F.struct(F.col("place").alias("group"), F.col("tree").cast("long").alias("tree"), "blocks", block("place").alias("block"))).cast(kind).alias("own"),
        *(F.max(F.when(F.col("tree") == t, F.col("place"))).alias(f"t{t}") for t in range(trees)),
    )
    node_groups = scratch.save(node_groups.select("node", "own", F.array(*(F.coalesce(F.col(f"t{t}"), F.lit(0)) for t in range(trees))).alias("trees")), "node-groups")
    marks = by_node.withColumn("split", F.lit(True))
    base = base.join(small_side(marks, by_node.count()), "label", "left").join(small_side(node_groups, node_groups.count()), "node", "left")
    whole = F.array(F.struct(F.col("label").alias("group"), F.lit(0).alias("tree"), "blocks", block("label").alias("block"))).cast(kind)
    groups = F.when(F.col("split").isNull(), whole).otherwise(F.coalesce("own", F.array().cast(kind)))
    out = scratch.save(base.select(KEY, "node", "copies", "trees", groups.alias("groups")), "wanted")
    scratch.drop("inside", "places", "different-places", "by-node", "picked", "node-groups")
    return out


def groups(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: KEY, doc_id, class_id, n_links, n_copies, n_texts, stays.

    Documents are linked if the Jaccard similarity of their sets of ``width``-word runs is at least
    ``threshold``; classes are the connected components, named by their smallest doc_id.  n_links
    counts the documents linked to a document: n_copies of its own shingle set, the rest of n_texts
    other sets.  One row of a class stays, of the smallest doc_id (null last), the first in the files
    if it repeats.

    Needs doc_id and text; other columns are not read.  Words are runs of anything but space and
    U+0009 to U+000D.  Texts of fewer words than ``width`` are one run; null texts and texts without
    words are linked to nothing, so each stays.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    return _groups(with_key(docs.select("doc_id", "text"), scratch), scratch, width, threshold, trees, recall)


def _groups(keyed: DataFrame, scratch: Scratch, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    length = prefix_length(threshold, trees, DEPTH, recall)
    rows = scratch.save(_sketches(keyed, width, length, trees).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    some = rows.filter("size > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    classes = scratch.save(some.groupBy("digest").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"), first), "classes")

    alone = some.select(F.col("rid").alias("rep"), F.arrays_zip("prefixes", "rest").alias("z")).join(classes.select("rep"), "rep")
    cells = scratch.save(alone.select("rep", F.posexplode("z").alias("tree", "z")).select("rep", "tree", F.col("z.prefixes").alias("cell"), F.col("z.rest").alias("rest")), "cells")
    nodes = _forest(cells, scratch, length, spare_trees(threshold, trees, length, DEPTH, recall))
    hubs = scratch.save(nodes.groupBy("tree", "node").agg(F.min("rep").alias("hub")).select(F.xxhash64("tree", "node").alias("place"), "hub"), "hubs")
    edges = nodes.withColumn("place", F.xxhash64("tree", "node")).join(small_side(hubs, hubs.count()), "place").select(F.col("rep").alias("u"), F.col("hub").alias("v")).filter("u != v")
    members = connected_components(edges, scratch, "candidates")
    scratch.drop("cells", "hubs")

    sized = members.join(some.select(F.col("rid").alias("node"), KEY, "size", "digest"), "node").join(classes.select(F.col("rep").alias("node"), "copies"), "node")
    sized = scratch.save(sized.select("node", "label", KEY, "size", "copies"), "sized")
    wanted = _work(sized, nodes, scratch, trees)
    found = marked(keyed.select(KEY, "text"), wanted.select(KEY), scratch, "wanted-places", keep=True).join(small_side(wanted, wanted.count()), KEY)
    links = scratch.save(_verified(_tiles(found, width), threshold), "links")
    joined = connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch, "classes-joined")
    scratch.drop("sized", "stats", "wanted", "wanted-places", "candidates", "nodes")

    total = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    notable = classes.join(total.withColumnRenamed("node", "rep"), "rep", "left").join(joined.select(F.col("node").alias("rep"), "label"), "rep", "left")
    notable = scratch.save(notable.filter("copies > 1 OR links IS NOT NULL").withColumn("class", F.coalesce("label", "rep")), "notable")
    best = scratch.save(notable.groupBy("class").agg(F.min("best").alias("first")), "best")
    notable = notable.drop("best").join(small_side(best, best.count()), "class")
    notable = scratch.save(notable.select("digest", "copies", "links", "texts", "first"), "decided")
    scratch.drop("links", "classes-joined", "notable", "best", "classes")
    out = rows.drop("prefixes", "rest").join(notable, "digest", "left")
    alone = F.col("first").isNull()
    return out.select(
        KEY,
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(alone, 0).otherwise(F.col("copies") - 1).cast("long").alias("n_copies"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        (alone | (F.col("first.rid") == F.col("rid"))).alias("stays"),
    )


def dedup(docs: DataFrame, **how: object) -> DataFrame:
    """One row of each class, with all columns of docs; nulls and ties as in groups().

    A column by the name of KEY is kept as it is.  Rows go by bitmaps of their places, so that texts
    which aren't candidates are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    keyed = with_key(docs.withColumnRenamed(KEY, f"{KEY}_given"), scratch)
    gone = _groups(keyed.select(KEY, "doc_id", "text"), scratch, **how).filter(~F.col("stays")).select(KEY)
    kept = marked(keyed, gone, scratch, "gone", keep=False).drop(KEY).withColumnRenamed(f"{KEY}_given", KEY)
    scratch.drop("sketches", "decided")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
