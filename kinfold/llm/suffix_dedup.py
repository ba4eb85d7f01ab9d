"""Removal of byte strings that stand in an earlier document, by sorted suffixes.

A string of LENGTH bytes belongs to the least hash among its grams, so equal strings belong to equal
hashes wherever they stand.  Successive strings of one hash are a fragment.  Texts are saved in blocks.
Each string also has WIDTH of its bytes on one side of its least gram; the hashes of these, which equal
strings share too, go to parts of a block's own, and one bit for each returns: whether several
documents have it.  Fragments without such a hash can't hold anything shared and are not moved, however
large the corpus is.  The others are dealt by hash to shards; a shard sorts the suffixes of its
different fragments by external induced sorting, which also gives the prefix that neighbours have in
common.  Suffixes that share LENGTH bytes or more are one group, and its smallest doc_id decides for
all of them.  What is to go returns to the fragments' documents as spans.

Documents with equal texts count once, by the row with the smallest doc_id; the others go whole.  A hash that very many different fragments have (around a line that very many documents repeat) would
make one shard large: its fragments are cut into single strings, dealt by their own hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinfold.llm.common import KEY, gives_back, marked, slices, small_side, with_key
from kinfold.llm.induced_sort import sorted_suffixes, words_of
from kinfold.scratch import Scratch

#: Bytes of a string that repeats, of the grams that are hashed, and of a gram with what follows or precedes it: each string has either.
LENGTH, GRAM = 50, 16
WIDTH = (LENGTH + GRAM) // 2
#: Places that are hashed at once; bits that tell them apart.
STRETCH, PLACE = 1 << 14, np.uint64(15)
#: Bits of a hash that a part compares; bytes of text for a part, and the least and most parts, as powers of two.
LOW, PART_BYTES, PARTS = 31, 48_000_000, (6, 13)
#: Bytes of bits that are broadcast at once.
BIT_BYTES = 32 << 20
#: Most strings of a fragment; bytes of fragments in a shard; share of all fragments beyond which a hash is cut into strings, if it has so many at least.
LONGEST, SHARD_BYTES, HOT_SHARE, HOT_LEAST = 256, 6_000_000, 200, 20_000
#: The doc_id of documents that have none: below all others.
NO_ID = -(1 << 63)
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3

BLOCK = "block long, text binary, size array<int>, f array<string>, r array<long>, doc_id array<long>"
ANCHORED = "block long, fid long, anchor long, fragment binary, low long, high long, f string, r long, doc_id long, at array<struct<fid:long,start:int>>"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    x, n = data.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        x = x[:-n] * np.uint64(pow(ODD, n, 1 << 64)) + x[n:]
        n *= 2
    x ^= x >> np.uint64(29)
    x *= MIX
    x ^= x >> np.uint64(32)
    return x


def least_hashes(data: np.ndarray) -> np.ndarray:
    """The least hash of a gram in the LENGTH bytes from each place on, and in the lowest PLACE bits where it first stands in its stretch; taken over stretches that stay in the processor's cache."""
    out = np.empty(len(data) - LENGTH + 1, np.uint64)
    places, above = np.arange(STRETCH + LENGTH - GRAM, dtype=np.uint64), ~np.uint64((1 << int(PLACE)) - 1)
    for at in range(0, len(out), STRETCH):
        x, width, n = gram_hashes(data[at : at + STRETCH + LENGTH - 1]), LENGTH - GRAM + 1, 1
        x &= above
        x |= places[: len(x)]
        while 2 * n <= width:
            x = np.minimum(x[:-n], x[n:])
            n *= 2
        np.minimum(x[: len(x) - (width - n)], x[width - n :], out=out[at : at + STRETCH])
    return out


def side_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the WIDTH bytes from each of these places on."""
    words, x = words_of(data), np.zeros(len(at), np.uint64)
    for skip in (*range(0, WIDTH - 8, 8), WIDTH - 8):
        x ^= words[at + skip]
        x *= MIX
        x ^= x >> np.uint64(32)
    return x


def fragments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of strings with one least hash: text, start in the bytes, number of strings, hash; and all hashes of sides, with the runs that have them.  offsets: the texts' starts, and the end."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    least = least_hashes(data)
    n = np.maximum(0, np.diff(offsets) - LENGTH + 1)  # strings of each text
    some = np.flatnonzero(n)
    change = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=change[1:])
    change[offsets[some]] = True
    start = np.flatnonzero(change)
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start < offsets[text] + n[text]
    start, text = start[inside], text[inside]
    stop = np.minimum(np.append(start[1:], len(least)), offsets[text] + n[text])
    gram = start - start % STRETCH + (least[start] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    hashes = least[start] >> PLACE
    opened = np.ones(len(start), bool)  # a gram that repeats gives several pieces of one run
    np.logical_or(text[1:] != text[:-1], hashes[1:] != hashes[:-1], out=opened[1:])
    opens, reach = np.flatnonzero(opened), WIDTH - GRAM
    left, right = np.flatnonzero(gram - start >= reach), np.flatnonzero(gram - stop + 1 < reach)
    sides = side_hashes(data, np.concatenate([gram[left] - reach, gram[right]]))
    run = (np.cumsum(opened) - 1)[np.concatenate([left, right])]
    return text[opens], start[opens], np.add.reduceat(stop - start, opens) if len(opens) else none, hashes[opens], sides, run


def pieces(start: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings in pieces of LONGEST at most: the run, start and number of strings of each."""
    n = -(-runs // LONGEST)
    of = np.repeat(np.arange(len(runs)), n)
    skip = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * LONGEST
    return of, start[of] + skip, np.minimum(runs[of] - skip, LONGEST)


def blocks_of(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows of BLOCK, saved: the texts of a few MB each that have a string at all; and all their bytes."""
    columns = [c.split(" ")[0] for c in BLOCK.split(", ")]

    @gives_back
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            texts = batch["text"].cast(pa.large_binary())
            batch = batch.filter(pc.greater_equal(pc.binary_length(texts), LENGTH))  # null: no
            if not batch.num_rows:
                continue
            texts, key = batch["text"].cast(pa.large_binary()), batch[KEY]
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            blob = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0])
            text = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(blob)], np.int32)), blob])
            ids = batch["doc_id"].cast(pa.int64()).fill_null(NO_ID)
            lists = (pa.array(np.diff(offsets).astype(np.int32)), pc.struct_field(key, "f"), pc.struct_field(key, "r"), ids)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), text, *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], columns)
            block += 1

    seen = Observation()
    rows = keyed.select(KEY, "doc_id", "text").mapInArrow(packed, BLOCK).observe(seen, F.sum(F.length("text")).alias("bytes"))
    blocks = scratch.save(rows, "blocks", large_rows=True)
    return blocks, seen.get["bytes"] or 0


def bytes_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block, and its texts' starts and end."""
    return np.frombuffer(batch["text"][i].as_buffer(), np.uint8), np.concatenate([[0], np.cumsum(batch["size"][i].values.to_numpy())]).astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shared_bits(blocks: DataFrame, power: int, scratch: Scratch) -> DataFrame:
    """block, and as bits for each of 2**power parts, whether other documents too have the block's different hashes of sides, in ascending order; parts and blocks without any are left out."""
    low, drop = np.uint64((1 << LOW) - 1), np.uint64(64 - LOW - power)

    @gives_back
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch["block"].to_pylist()):
                text, _, _, _, sides, run = fragments(*bytes_of(batch, i))
                if not len(sides):
                    continue
                pair = distinct(sides >> drop << np.uint64(20) | text[run].astype(np.uint64)) >> np.uint64(20)  # a code for each of its documents, of which a block has fewer than 2**20
                new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                code = pair[new]
                sent = ((code & low) << np.uint64(1) | (np.diff(np.append(new, len(pair))) > 1)).astype(np.uint32)
                part = (code >> np.uint64(LOW)).astype(np.int32)
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                blobs = [sent[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), block)), pa.array(part[cut]), pa.array(blobs, pa.binary())], ["block", "part", "codes"])

    @gives_back
    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> pa.RecordBatch:
            stop = np.cumsum([len(x) for _, x in held]) // 4
            code = np.frombuffer(b"".join(x for _, x in held), np.uint32).astype(np.uint64)
            code = np.sort(code << np.uint64(32) | np.arange(len(code), dtype=np.uint64))
            own, several = code >> np.uint64(33), code >> np.uint64(32) & np.uint64(1) > 0
            same = own[1:] == own[:-1]
            several[1:] |= same
            several[:-1] |= same
            bits = np.zeros(len(code), bool)
            bits[(code & np.uint64(0xFFFFFFFF)).astype(np.int64)] = several
            rows = [(block, np.packbits(bits[a:b]).tobytes()) for (block, _), a, b in zip(held, np.concatenate([[0], stop[:-1]]), stop, strict=True) if bits[a:b].any()]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([now] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "part", "bits"])

        for batch in batches:
            for block, part, codes in zip(*(batch[c].to_pylist() for c in ("block", "part", "codes")), strict=True):
                if part != now:
                    if held:
                        yield told()
                    now, held = part, []
                held.append((block, codes))
        if held:
            yield told()

    dealt = blocks.select("block", "text", "size").mapInArrow(asked, "block long, part int, codes binary").repartition("part").sortWithinPartitions("part")
    bits = scratch.save(dealt.mapInArrow(answered, "block long, part int, bits binary"), "bits")
    return scratch.save(bits.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("bits")), "told")


def ranges(told: DataFrame) -> list[tuple[int, int]]:
    """Ranges of blocks (first, last), of which each has BIT_BYTES of bits or those of one task's blocks."""
    size = F.aggregate("bits", F.lit(0).cast("long"), lambda x, y: x + F.length(y["bits"]) + 16)
    found, held = [], 0
    for row in told.groupBy(F.shiftright("block", 40).alias("task")).agg(F.sum(size).alias("size")).orderBy("task").toLocalIterator():
        first, last = row["task"] << 40, (row["task"] + 1 << 40) - 1
        if found and held + row["size"] <= BIT_BYTES:
            found[-1] = found[-1][0], last
            held += row["size"]
        else:
            found.append((first, last))
            held = row["size"]
    return found


def anchored(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, list[str], int, int]:
    """Rows of ANCHORED, saved, their tables, and the number and bytes of fragments: the different fragments of each block, and where its documents have them."""
    columns = [c.split(" ")[0] for c in ANCHORED.replace("struct<fid:long,start:int>", "").split(", ")]
    blocks, size = blocks_of(keyed, scratch)
    power = min(max(PARTS[0], (size // PART_BYTES).bit_length()), PARTS[1])
    drop = np.uint64(64 - LOW - power)

    @gives_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch["block"].to_pylist()):
                data, offsets = bytes_of(batch, i)
                text, start, runs, hashes, sides, run = fragments(data, offsets)
                sides >>= drop
                codes = distinct(sides)
                bounds = np.searchsorted(codes, np.arange((1 << power) + 1, dtype=np.uint64) << np.uint64(LOW))
                several = np.zeros(len(codes), bool)
                for told in batch["bits"][i].as_py():
                    a, b = bounds[told["part"]], bounds[told["part"] + 1]
                    several[a:b] = np.unpackbits(np.frombuffer(told["bits"], np.uint8), count=b - a)
                codes = codes[several]
                held = codes[np.minimum(np.searchsorted(codes, sides), len(codes) - 1)] == sides
                kept = np.zeros(len(runs), bool)
                kept[run[held]] = True
                keep = np.flatnonzero(kept)
                of, start, strings = pieces(start[keep], runs[keep])
                text, hashes, size = text[keep][of], hashes[keep][of], strings + LENGTH - 1
                stop = np.cumsum(size)
                flat = data[np.repeat(start - (stop - size), size) + np.arange(stop[-1])]
                coded = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                ids = batch["doc_id"][i].values.to_numpy()
                order = np.argsort(code, kind="stable")
                opens = np.flatnonzero(np.diff(code[order], prepend=-1))
                owner = ids[text[order]]
                n = len(opens)
                low, high = np.minimum.reduceat(owner, opens), np.maximum.reduceat(owner, opens)
                none = lambda kind, n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x) for x in (np.full(n, block), np.arange(n), hashes[order[opens]].view(np.int64))), coded.dictionary, pa.array(low), pa.array(high),
                        none(pa.string(), n), none(pa.int64(), n), none(pa.int64(), n), none(AT, n),
                    ],
                    columns,
                )
                mine, opens = np.unique(text, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(opens, len(text)), pa.int32()), pa.StructArray.from_arrays([pa.array(code), pa.array((start - offsets[text]).astype(np.int32))], ["fid", "start"]))
                m = len(mine)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, block)), none(pa.int64(), m), none(pa.int64(), m), none(pa.binary(), m), none(pa.int64(), m), none(pa.int64(), m),
                        batch["f"][i].values.take(pa.array(mine)), batch["r"][i].values.take(pa.array(mine)), pa.array(ids[mine]), lists,
                    ],
                    columns,
                )

    told = shared_bits(blocks, power, scratch)
    out, names, n, size = None, [], 0, 0
    for first, last in ranges(told):  # each range is saved before the next one's bits are broadcast
        own, seen = F.col("block").between(first, last), Observation()
        found = blocks.filter(own).join(F.broadcast(told.filter(own)), "block").mapInArrow(cut, ANCHORED)
        found = found.observe(seen, F.count("fid").alias("n"), F.sum(F.length("fragment")).alias("bytes"))
        names.append(f"anchored-{len(names)}")
        part = scratch.save(found.withColumn("kind", F.when(F.col("fid").isNull(), "places").otherwise("fragments")), names[-1], "kind")
        n, size = n + (seen.get["n"] or 0), size + (seen.get["bytes"] or 0)
        out = part if out is None else out.unionByName(part)
        del found
        gc.collect()  # the driver's references keep a broadcast alive
    scratch.drop("blocks")
    return out, names, n, size


AT = pa.list_(pa.struct([("fid", pa.int64()), ("start", pa.int32())]))


def decided(keys: np.ndarray, low: np.ndarray, high: np.ndarray, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the fragments of a shard (hash, least and greatest doc_id, bytes): fragment, first string, number of strings, and the least doc_id that has those strings; only where a fragment's documents include a greater one."""
    order = np.argsort(keys, kind="stable")
    opens = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, np.int64)
    several = np.zeros(len(keys), bool)
    if len(keys):
        runs = np.diff(np.append(opens, len(keys)))
        several[order] = np.repeat(np.minimum.reduceat(low[order], opens) < np.maximum.reduceat(high[order], opens), runs)
    own = np.flatnonzero(several)
    if not len(own):
        return (np.zeros(0, np.int64),) * 4
    coded = parts.filter(pa.array(several)).dictionary_encode()
    code, different = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    by_code = np.argsort(code, kind="stable")
    least = np.minimum.reduceat(low[own][by_code], np.flatnonzero(np.diff(code[by_code], prepend=-1)))
    size = pc.binary_length(different).to_numpy().astype(np.int64)
    data = np.frombuffer(different.buffers()[2], np.uint8)[: size.sum()]
    text = np.zeros(len(data) + len(size) + 1, np.uint8)
    owner = np.repeat(np.arange(len(size)), size)
    text[np.arange(len(data)) + owner + 1] = data + 1
    order, shared = sorted_suffixes(text, LENGTH)
    ends = np.cumsum(size + 1)
    whole = np.repeat(np.arange(len(size)), size + 1)  # of each place but the first, the fragment
    inside = np.zeros(len(text), bool)  # places that LENGTH bytes of a fragment follow
    first = ends - size
    strings = size - LENGTH + 1
    at = np.repeat(first - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
    inside[at] = True
    keep = inside[order]
    joined = shared >= LENGTH  # those with LENGTH bytes in common are neighbours
    order, joined = order[keep], joined[keep]
    opens = np.flatnonzero(~joined)
    smallest = np.zeros(len(text), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(least[whole[order - 1]], opens), np.diff(np.append(opens, len(order))))
    value, of = smallest[at], np.repeat(np.arange(len(size)), strings)
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])]))
    count, value, of = np.diff(np.append(new, len(value))), value[new], of[new]
    begin = at[new] - first[of]
    cuts = np.searchsorted(of, np.arange(len(size) + 1))
    n = (cuts[1:] - cuts[:-1])[code]
    stop = np.cumsum(n)
    span = np.repeat(cuts[code] - (stop - n), n) + np.arange(stop[-1])
    row = np.repeat(own, n)
    goes = value[span] < high[row]
    return row[goes], begin[span][goes], count[span][goes], value[span][goes]


def returned(gone: pa.Table, places: pa.Table) -> pa.Table:
    """f, r, gone of each document of a block from which something goes: the spans of its fragments' strings, in bytes, maximal and in order."""
    fid = gone["fid"].to_numpy()
    order = np.argsort(fid, kind="stable")
    fid, begin, count, least = fid[order], *(gone[c].to_numpy()[order] for c in ("begin", "count", "least"))
    lists = places["at"].combine_chunks()
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    own, start = (pc.struct_field(lists.flatten(), c).to_numpy() for c in ("fid", "start"))
    first = np.searchsorted(fid, own)
    n = np.searchsorted(fid, own, "right") - first
    stop = np.cumsum(n)
    hit = np.repeat(first - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
    doc, start = np.repeat(doc, n), np.repeat(start.astype(np.int64), n) + begin[hit]
    goes = least[hit] < places["doc_id"].to_numpy()[doc]
    doc, start, size = doc[goes], start[goes], count[hit][goes] + LENGTH - 1
    order = np.argsort(doc << 32 | start)  # texts have less than 2^31 bytes
    doc, start = doc[order], (doc << 32 | start)[order]
    stop = np.maximum.accumulate(start + size[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]])) if len(doc) else np.zeros(0, np.int64)
    start, size = start[new] & 0xFFFFFFFF, stop[np.append(new[1:], len(doc))[: len(new)] - 1] - start[new]
    some, opens = np.unique(doc[new], return_index=True)
    pairs = pa.StructArray.from_arrays([pa.array(start), pa.array(size)], ["start", "size"])
    rows = places.select(["f", "r"]).take(pa.array(some))
    return rows.append_column("gone", pa.ListArray.from_arrays(pa.array(np.append(opens, len(new)), pa.int32()), pairs))


SPANS = "f string, r long, gone array<struct<start:long,size:long>>"


def spans(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """f, r and gone of each row of keyed from which something goes: an array of struct(start, size) in bytes, maximal and in order."""
    found, names, n, size = anchored(keyed, scratch)
    if found is None:
        return keyed.sparkSession.createDataFrame([], SPANS)
    parts = found.filter("kind = 'fragments'").select("block", "fid", "anchor", "fragment", "low", "high")
    hot = parts.groupBy("anchor").count().filter(F.col("count") > max(HOT_LEAST, n // HOT_SHARE)).select(F.col("anchor").alias("hot"))  # fewer than HOT_SHARE rows
    hot = scratch.save(hot, "hot")
    strings = F.sequence(F.lit(0), F.length("fragment") - LENGTH)
    parts = parts.join(F.broadcast(hot), F.col("anchor") == F.col("hot"), "left")
    parts = parts.withColumn("base", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(strings)))
    string = F.when(F.col("hot").isNull(), F.col("fragment")).otherwise(F.substring(F.col("fragment"), F.col("base") + 1, F.lit(LENGTH)))
    parts = parts.withColumn("fragment", string).withColumn("key", F.when(F.col("hot").isNull(), F.col("anchor")).otherwise(F.xxhash64("fragment")))
    parts = parts.select("key", "block", "fid", "base", "low", "high", "fragment").repartition(max(1, -(-size // SHARD_BYTES)), "key")

    @gives_back
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        whole = pa.Table.from_batches(held)
        held.clear()
        key, block, fid, base, low, high = (whole[c].to_numpy() for c in ("key", "block", "fid", "base", "low", "high"))
        row, begin, count, least = decided(key, low, high, pa.concat_arrays(whole["fragment"].chunks))
        for at in range(0, len(row), 100_000):
            some = row[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (block[some], fid[some], base[some] + begin[at : at + 100_000], count[at : at + 100_000], least[at : at + 100_000])], ["block", "fid", "begin", "count", "least"])

    gone = scratch.save(parts.mapInArrow(sort, "block long, fid long, begin long, count long, least long"), "gone")
    scratch.drop(*(f"{x}/kind=fragments" for x in names))
    places = found.filter("kind = 'places'").select("block", "f", "r", "doc_id", "at")
    back = gone.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(returned, SPANS)
    return scratch.save(back, "spans")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept binary"


def removals(docs: DataFrame) -> DataFrame:
    """A row of REMOVED for each row of docs: the byte spans that go, maximal and in order, and the bytes that stay.

    Needs doc_id and text; other columns are not read.  A null text is empty.  A byte goes if a string
    of LENGTH bytes that covers it also starts in a document with a smaller doc_id; a null doc_id is
    below all others, and documents with the same doc_id take nothing from each other.  An empty table gives
    none.  Nothing is decided from a text's beginning alone: all strings of all texts are compared.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    keyed = with_key(docs.select("doc_id", "text"), scratch)
    # copies are told apart by what is known of them without their texts, which no join on content moves
    digests = scratch.save(keyed.filter(F.octet_length("text") >= LENGTH).select(KEY, "doc_id", F.unhex(F.sha2("text", 256)).alias("content")), "digests")
    copies = digests.groupBy("content").agg(F.min(F.struct("doc_id", KEY)).alias("first"), F.count("*").alias("n")).filter("n > 1").select("content", "first")
    copies = scratch.save(copies, "copies")
    others = digests.join(small_side(copies, copies.count()), "content").filter(F.col(KEY) != F.col(f"first.{KEY}"))
    order = lambda c: F.coalesce(F.col(c), F.lit(NO_ID))
    others = scratch.save(others.select(KEY, F.col(f"first.{KEY}").alias("place"), (order("doc_id") > order("first.doc_id")).alias("whole")), "others")
    gone = spans(marked(keyed, others, scratch, "copies-marks", keep=False), scratch).select(F.struct("f", "r").alias("place"), "gone")
    same = others.filter("NOT whole").join(gone, "place").select(KEY, "whole", "gone")  # copies with the first one's doc_id
    none = F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")
    fate = gone.select(F.col("place").alias(KEY), F.lit(False).alias("whole"), "gone").unionByName(others.filter("whole").select(KEY, "whole", none)).unionByName(same)
    fate = fate.select(F.xxhash64(f"{KEY}.f").alias("h"), F.col(f"{KEY}.f").alias("f"), F.col(f"{KEY}.r").alias("r"), "whole", "gone")
    own = (F.xxhash64(f"{KEY}.f") == F.col("h")) & (F.col(f"{KEY}.r") == F.col("r")) & (F.col(f"{KEY}.f") == F.col("f"))  # numbers are sorted first
    told = keyed.join(fate, own, "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "gone")

    @gives_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, rows = batch["text"].fill_null("").cast(pa.binary()), []
            lists = batch["gone"]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())]).astype(np.int64)
            starts, sizes = (pc.struct_field(lists.flatten(), c).to_numpy().astype(np.int64) for c in ("start", "size"))
            for i, (text, all_of_it) in enumerate(zip(texts.to_pylist(), batch["whole"].to_pylist(), strict=True)):
                a, b = ends[i], ends[i + 1]
                if all_of_it:
                    rows.append((len(text), len(text), 1, [{"start": 0, "end": len(text)}], b""))
                    continue
                if a == b:
                    rows.append((len(text), 0, 0, [], text))
                    continue
                order = np.argsort(starts[a:b], kind="stable")
                start, stop = starts[a:b][order], np.maximum.accumulate((starts[a:b] + sizes[a:b])[order])
                new = np.concatenate([[True], start[1:] > stop[:-1]])
                start, stop = start[new].tolist(), stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)].tolist()
                kept = b"".join(text[x:y] for x, y in zip([0, *stop], [*start, len(text)], strict=True))
                rows.append((len(text), len(text) - len(kept), len(start), [{"start": x, "end": y} for x, y in zip(start, stop, strict=True)], kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    return told.mapInArrow(cut, REMOVED)
