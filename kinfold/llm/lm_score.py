"""Language-model scores from a log-frequency Bloom filter.

The filter holds the quantised counts of all word pairs of the training texts: a pair with quantised
count q is inserted q times, marked 1 to q, and its count is read back by probing one mark after the
other until one is missing.  The first mark takes several independent blocks of bits, so many that
fewer pairs are taken for seen by mistake than one in the vocabulary's size.  The filter is built in
segments, each by one task from the hashes that belong to it.  A small one is sent to the workers in
shards of bounded size.  Otherwise the texts' pairs go to the segments instead, once, whatever the
filter's size: the task that builds a segment also probes it for every batch of texts that asks, and
the levels that it reads return to the batches.  The probability of a word is its pair's count, smoothed with the word's own frequency
(a Dirichlet prior of weight PRIOR), over the exact count of the word before; a quantised count
stands for the mean of the counts that it was given, so that a context's probabilities sum to about 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import gives_back, release, slices, split_words
from kinfold.scratch import Scratch

#: Counts from BASE^(q-1) below BASE^q have the quantised count q.
BASE = 1.5
#: Bits of the filter for each insertion of marks beyond the first, and bits (of one 64-bit word) that it is probed by.
BITS, PROBES = 10, 5
#: The same for each block of the first mark, and the share of unseen pairs that a block lets pass (0.0042 measured).
FIRST_BITS, FIRST_PROBES, BLOCK_ERROR = 16, 8, 0.0045
#: Of 5 to 2000, 200 and 500 are the best on held-out texts of sf0.1.
PRIOR = 300.0
#: N-grams of a segment, about; n-gram hashes that a task holds before it sends them on.
SEGMENT, HELD = 1_000_000, 3_000_000
#: Bytes of filter and vocabulary that pass through the driver at once, a shard, and shards that are broadcast; pairs go to the segments beyond.
SHARD_BYTES, PASS_SHARDS = 12 << 20, 8
#: Words are dealt into so many groups by hash at least, a power of two; whole groups make up a shard.
GROUPS = 64
END = ""  # the token at a text's end, and the context of its first word

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOW = (1 << 64) - 1


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 by 7.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before + A) ^ word)


def coded(texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The place of each token in the different tokens, numbers of tokens of the texts, the different tokens' hashes, and they.

    Tokens are words, A-Z lower-cased, and the end.
    """
    codes, sizes, words = split_words(pc.ascii_lower(texts))
    words.append(END)
    codes = np.insert(codes, np.cumsum(sizes), len(words) - 1)
    return codes, sizes + 1, np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)), words


def contexts(word: np.ndarray, sizes: np.ndarray, end: object) -> np.ndarray:
    """The value before each token in its text; ``end`` before a text's first."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def quantised(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def by_level(count: np.ndarray) -> list[np.ndarray]:
    """Pairs and the sum of their counts by quantised count."""
    level = quantised(count)
    return [np.bincount(level, w, len(VALUES)).astype(np.int64) for w in (None, count)]


#: The middle of each quantised count's range, where none was seen.
VALUES = np.array([0.0, 1.0] + [(BASE ** (q - 1) + BASE**q) / 2 for q in range(2, 130)])


def blocks_for(words: int) -> int:
    """Blocks of the first mark by which an unseen pair passes with a chance below 1 / words."""
    return max(2, math.ceil(math.log(max(words, 2)) / -math.log(BLOCK_ERROR)))


def probes(key: np.ndarray, mark: int, bits: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word, of so many in a segment, and its bits that stand for each key with a mark."""
    h = mixed(key + np.uint64(int(A) * mark & LOW))
    mask, more = np.zeros(len(h), np.uint64), mixed(h ^ B)
    for i in range(bits):
        mask |= np.uint64(1) << ((more >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.asarray(words, np.uint64)) >> np.uint64(32), mask


def marks(level: int, blocks: int) -> list[tuple[int, int]]:
    """What a level is probed by: marks, and bits of each."""
    return [(-1 - i, FIRST_PROBES) for i in range(blocks)] if level == 1 else [(level, PROBES)]


def build_segment(key: np.ndarray, count: np.ndarray, blocks: int) -> np.ndarray:
    """The 64-bit words of the segment that holds these pairs (each once) with their quantised counts."""
    level = quantised(count)
    bits = len(key) * FIRST_BITS * blocks + int((level - 1).sum()) * BITS
    out = np.zeros(max(1, -(-bits // 64)), np.uint64)
    for q in range(1, int(level.max(initial=0)) + 1):
        for mark, n in marks(q, blocks):
            at, mask = probes(key[level >= q], mark, n, len(out))
            order = np.argsort(at)
            at, mask = at[order], mask[order]
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out[at[new].astype(np.int64)] |= np.bitwise_or.reduceat(mask, new)
    return out


class Filter:
    """Segments side by side, by place; counts() probes them."""

    def __init__(self, places: int, segments: dict[int, np.ndarray], blocks: int):
        self.blocks, self.sizes = blocks, np.ones(places, np.uint64)
        for place, words in segments.items():
            self.sizes[place] = len(words)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        self.words = np.zeros(int(self.sizes.sum()), np.uint64)
        for place, words in segments.items():
            self.words[self.starts[place] : self.starts[place] + len(words)] = words

    def counts(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The quantised counts of pairs (0: unseen)."""
        found, alive, level = np.zeros(len(key), np.int64), np.arange(len(key)), 0
        start, size = self.starts[place], self.sizes[place]
        while len(alive):
            level += 1
            for mark, n in marks(level, self.blocks):
                at, mask = probes(key, mark, n, size)
                hit = (self.words[start + at.astype(np.int64)] & mask) == mask
                alive, key, start, size = alive[hit], key[hit], start[hit], size[hit]
            found[alive] = level
        return found


class Model:
    """What was learnt: number of training tokens and words; tables of segments and words by group; groups by shard; what levels stand for."""

    def __init__(self, n: int, v: int, seed: int, layout: tuple[int, int, int], shards: list[range], filters: DataFrame, words: DataFrame, values: np.ndarray):
        self.n, self.v, self.seed, self.shards, self.filters, self.words, self.values = n, v, seed, shards, filters, words, values
        self.groups, self.per_group, self.blocks = layout

    def shard(self, i: int) -> tuple[range, Filter, np.ndarray, np.ndarray]:
        """Groups, filter, sorted hashes of words and their counts of one shard; all of bounded size."""
        own = self.shards[i]
        inside = F.col("group").between(own.start, own.stop - 1)
        table = self.filters.filter(inside).select("group", "segment", "words").toArrow()
        places = [g * self.per_group + s for g, s in zip(table["group"].to_pylist(), table["segment"].to_pylist(), strict=True)]
        segments = {p: np.frombuffer(x.as_buffer(), np.uint64) for p, x in zip(places, table["words"], strict=True)}
        words = self.words.filter(inside).select("hash", "count").toArrow()
        hashes, counts = words["hash"].to_numpy().view(np.uint64), words["count"].to_numpy()
        order = np.argsort(hashes)
        return own, Filter(self.groups * self.per_group, segments, self.blocks), hashes[order], counts[order].astype(np.uint32 if self.n < 1 << 32 else np.int64)


def _word_counts(train: DataFrame, seed: int) -> DataFrame:
    """hash, word, count of the training tokens."""

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in seen), np.uint64, len(seen)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["hash", "word", "count"])

        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            codes, _, _, words = coded(batch["text"], seed)
            for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                if n:
                    seen[word] += n
            if len(seen) > 400_000:
                yield rows(seen)
                seen = Counter()
        if seen:
            yield rows(seen)

    return train.mapInArrow(count, "hash long, word string, count long").groupBy("hash", "word").agg(F.sum("count").alias("count"))


def places_of(word: np.ndarray, key: np.ndarray, groups: int, per_group: int) -> np.ndarray:
    """The segments of pairs: in the group of the last word, by the pair's own hash."""
    return ((word % np.uint64(groups)) * np.uint64(per_group) + (key >> np.uint64(20)) % np.uint64(per_group)).astype(np.int64)


def _segments(train: DataFrame, seed: int, layout: tuple[int, int, int]) -> DataFrame:
    """group, segment, words: the parts of the filter, each built by one task from the hashes sent to it; levels: pairs and sum of counts by level."""
    groups, per_group, blocks = layout

    @gives_back
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            key = np.concatenate([k for k, _ in held])
            place = np.concatenate([p for _, p in held])
            order = np.lexsort((key, place))
            key, place = key[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]))
            count = np.diff(np.append(new, len(key))).astype(np.uint32)
            key, place = key[new], place[new]
            cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            ends = np.append(cut[1:], len(key))
            rows = [(int(place[a]), key[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cut, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["place", "keys", "counts"])

        held, n = [], 0
        end = np.uint64(xxhash.xxh64_intdigest(END, seed))
        for batch in slices(batches, "text"):
            codes, sizes, hashes, _ = coded(batch["text"], seed)
            word = hashes[codes]
            pair = pair_keys(contexts(word, sizes, end), word)
            held.append((pair, places_of(word, pair, groups, per_group)))
            n += len(word)
            if n >= HELD:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    def build(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in rows:
            keys += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["keys"]]
            counts += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch["counts"]]
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        keys.clear()
        order = np.argsort(all_keys)
        all_keys, all_counts = all_keys[order], all_counts[order]
        new = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
        place = key[0].as_py()
        count = np.add.reduceat(all_counts, new)
        words, levels = build_segment(all_keys[new], count, blocks), by_level(count)
        arrays = [pa.array([place // per_group], pa.int64()), pa.array([place % per_group], pa.int64()), pa.array([words.tobytes()], pa.binary()), *(pa.array([x], pa.list_(pa.int64())) for x in levels)]
        yield pa.RecordBatch.from_arrays(arrays, ["group", "segment", "words", "pairs", "total"])

    sent_on = train.mapInArrow(gather, "place long, keys binary, counts binary")
    return sent_on.groupBy("place").applyInArrow(build, "group long, segment long, words binary, pairs array<long>, total array<long>")


def count_words(train: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int, int, tuple[int, int, int], int]:
    """hash, word, count of all whole texts of train, saved; number of tokens and words; seed; layout of the filter; most bytes that it and the words take.

    Words are counted exactly; should two words have one hash, another seed is taken.
    """
    texts = train.select("text")
    for seed in range(8):
        words = scratch.save(_word_counts(texts, seed), f"words-{seed}")
        n, v, hashes = words.agg(F.sum("count"), F.count("*"), F.count_distinct("hash")).first()
        if hashes == v:
            break
        scratch.drop(f"words-{seed}")
    else:
        raise ValueError("eight seeds each gave two words the same hash")
    n, blocks = n or 0, blocks_for(v)
    most = 12 * v + n * (FIRST_BITS * blocks + 2 * BITS) // 8  # bytes, should no pair repeat
    groups = max(GROUPS, 1 << math.ceil(math.log2(max(1, 2 * most / SHARD_BYTES))))
    group = F.expr(f"pmod(pmod(hash, {groups}) + {groups}, {groups})")  # 2^64 is a multiple of groups
    return words.withColumn("group", group), n, v, seed, (groups, max(1, math.ceil(n / SEGMENT / groups)), blocks), most


def values_of(levels: DataFrame) -> np.ndarray:
    """What each level stands for: the mean of the counts that it was given; levels has pairs and total by level."""
    values = VALUES.copy()
    for level, pairs, counted in levels.select(F.posexplode(F.arrays_zip("pairs", "total")).alias("level", "z")).groupBy("level").agg(F.sum("z.pairs"), F.sum("z.total")).collect():
        if pairs:
            values[level] = counted / pairs
    return values


def fit(train: DataFrame, scratch: Scratch, shard_bytes: int = SHARD_BYTES, counted: tuple | None = None) -> Model:
    """A model of all whole texts of train, which can be broadcast; counted: what count_words returned for it."""
    words, n, v, seed, layout, _ = counted or count_words(train, scratch)
    groups = layout[0]
    filters = scratch.save(_segments(train.select("text"), seed, layout), "filter")
    total = 12 * v + (filters.agg(F.sum(F.length("words"))).first()[0] or 0)
    shards = min(groups, max(1, math.ceil(total / shard_bytes)))
    edges = [groups * i // shards for i in range(shards + 1)]
    return Model(n, v, seed, layout, [range(a, b) for a, b in zip(edges, edges[1:], strict=False)], filters, words, values_of(filters))


#: Columns beside those with ids of documents, whose type is kept.
BATCH = "train array<boolean>, batch long, sizes binary, planes binary, words binary"
SCORES = "n_tokens long, n_known long, base_score double, score double"


def kind_of_id(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def broadcast_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and SCORES of each row of docs by a model whose shards are all broadcast."""
    loaded = []
    for i in range(len(model.shards)):  # one after the other: the driver holds one at a time
        loaded.append(docs.sparkSession.sparkContext.broadcast(model.shard(i)))
        release()
    n, v, seed, all_groups, per_group, values = model.n, model.v, model.seed, model.groups, model.per_group, model.values

    @gives_back
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.uint64(xxhash.xxh64_intdigest(END, seed))
        for batch in slices(batches, "text"):
            codes, sizes, hashes, _ = coded(batch["text"], seed)
            group, word = hashes % np.uint64(all_groups), hashes[codes]
            pair = pair_keys(contexts(word, sizes, end), word)
            count, gained = np.zeros(len(hashes), np.int64), np.zeros(len(codes))
            mine = np.zeros(len(hashes), bool)
            for shard in loaded:
                groups, table, known, counts = shard.value
                own = (group >= groups.start) & (group < groups.stop)
                mine |= own
                at = np.minimum(np.searchsorted(known, hashes[own]), max(len(known) - 1, 0))
                count[own] = np.where(known[at] == hashes[own], counts[at].astype(np.int64), 0) if len(known) else 0
                here = np.flatnonzero(own[codes])
                key = pair[here]
                seen = values[table.counts(key, places_of(word[here], key, all_groups, per_group))]
                gained[here] = np.log10(seen + (PRIOR * (count + 1) / (n + v + 1))[codes[here]])
            base = np.where(mine, np.log10((count + 1) / (n + v + 1)), 0)
            context = np.where(mine, np.log10(count + PRIOR), 0)
            before = contexts(context[codes], sizes, context[hashes == end][0] if (hashes == end).any() else 0.0)
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (base[codes], gained - before)]
            known_words = np.add.reduceat(((count > 0) & mine)[codes].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes), pa.array(known_words), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind_of_id(docs)}, {SCORES}")


def _saved_tokens(docs: DataFrame, seed: int) -> DataFrame:
    """doc_ids and columns of BATCH: about HELD tokens of successive texts each, as places in the batch's ascending hashes, one plane of bytes after the other."""

    @gives_back
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def joined(held: list[tuple]) -> pa.RecordBatch:
            ids, train, sizes, codes, hashes = zip(*held, strict=True)
            words, place = np.unique(np.concatenate(hashes), return_inverse=True)
            starts = np.cumsum([0, *map(len, hashes)])
            flat = np.concatenate([place[a:b][c] for a, b, c in zip(starts, starts[1:], codes, strict=False)]).astype("<u4")
            planes = flat.view(np.uint8).reshape(-1, 4).T.tobytes()  # the higher ones are mostly zeros
            lists = [pa.array([pa.concat_arrays(x)], pa.list_(x[0].type)) for x in (ids, train)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.concatenate(sizes).tobytes(), planes, words.tobytes()))], ["doc_ids", "train", "batch", "sizes", "planes", "words"])

        held, n = [], 0
        for batch in slices(batches, "text"):
            codes, sizes, hashes, _ = coded(batch["text"], seed)
            held.append((batch["doc_id"], batch["train"], sizes.astype(np.int64), codes.astype(np.int32), hashes))
            n += len(codes)
            if n >= HELD:
                yield joined(held)
                held, n, number = [], 0, number + 1
        if held:
            yield joined(held)

    return docs.select("doc_id", (~held_out(F.col("doc_id"))).alias("train"), "text").mapInArrow(tokens, f"doc_ids array<{kind_of_id(docs)}>, {BATCH}")


class Asked:
    """What a batch asks the filter for: its different pairs and words, each by group and then by value; and where its tokens find them."""

    def __init__(self, row: dict[str, pa.Scalar], seed: int, groups: int):
        self.words = np.frombuffer(row["words"].as_buffer(), np.uint64)
        self.sizes = np.frombuffer(row["sizes"].as_buffer(), np.int64)
        planes = np.frombuffer(row["planes"].as_buffer(), np.uint8).reshape(4, -1)
        self.codes = np.ascontiguousarray(planes.T).view("<u4").ravel()
        token, self.end = self.words[self.codes], np.uint64(xxhash.xxh64_intdigest(END, seed))
        pair = pair_keys(contexts(token, self.sizes, self.end), token)
        order = np.argsort(pair)
        pair = pair[order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        pair, owner = pair[new], self.codes[order[new]]  # the place of each different pair's word
        group = (self.words % np.uint64(groups)).astype(np.int64)
        self.by_group = np.argsort(group, kind="stable")
        pairs_by_group = np.argsort(group[owner], kind="stable")
        self.pairs, self.owner = pair[pairs_by_group], owner[pairs_by_group]
        self.groups, word_ends = np.unique(group, return_counts=True)
        self.word_cuts = np.concatenate([[0], np.cumsum(word_ends)])
        self.pair_cuts = np.searchsorted(group[self.owner], np.append(self.groups, groups))
        rank = np.empty(len(pair), np.int32)
        rank[pairs_by_group] = np.arange(len(pair), dtype=np.int32)
        self.at = np.empty(len(order), np.int32)  # of each token, the place of its pair
        self.at[order] = rank[np.cumsum(new) - 1]


def flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in binary values, one after the other, and their bounds."""
    data = b"".join(memoryview(x.as_buffer()) for x in column)
    size = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())]).astype(np.int64)
    return np.frombuffer(data, kind), size // np.dtype(kind).itemsize


def dealt_scores(docs: DataFrame, counted: tuple, scratch: Scratch) -> DataFrame:
    """doc_id and SCORES of each row of docs; pairs and words go to the filter's groups, and what is known of them returns to the batches of texts."""
    words, n, v, seed, (groups, per_group, blocks), _ = counted
    saved = scratch.save(_saved_tokens(docs, seed), "tokens")

    @gives_back
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = {c: rows[c][i] for c in rows.schema.names}
                a, train = Asked(row, seed, groups), row["train"].values.to_numpy(zero_copy_only=False)
                times = np.bincount(a.at[np.repeat(train, a.sizes)], minlength=len(a.pairs)).astype(np.uint32)
                called = a.words[a.by_group]
                cut = lambda x, ends: pa.array([x[p:q].tobytes() for p, q in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.groups), pa.array(np.full(len(a.groups), row["batch"].as_py())), cut(a.pairs, a.pair_cuts), cut(times, a.pair_cuts), cut(called, a.word_cuts)],
                    ["group", "batch", "pairs", "times", "words"],
                )

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        pairs, pair_ends = flat(asked["pairs"], np.uint64)
        times, _ = flat(asked["times"], np.uint32)
        called, word_ends = flat(asked["words"], np.uint64)
        different, owner = np.unique(pairs, return_inverse=True)
        count = np.bincount(owner, times, len(different)).astype(np.int64)
        learnt = count > 0
        place = ((different >> np.uint64(20)) % np.uint64(per_group)).astype(np.int64)
        inside = [learnt & (place == i) for i in range(per_group)]
        table = Filter(per_group, {i: build_segment(different[x], count[x], blocks) for i, x in enumerate(inside) if x.any()}, blocks)
        level = table.counts(different, place).astype(np.uint8)[owner]
        hashes, counts = known["hash"].to_numpy().view(np.uint64), known["count"].to_numpy()
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        found = np.zeros(len(called), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, called), len(hashes) - 1)
            found = np.where(hashes[at] == called, counts[at], 0)
        cut = lambda x, ends: [x[p:q].tobytes() for p, q in zip(ends, ends[1:], strict=False)]
        m = asked.num_rows
        stats = [[x.tolist(), *[None] * (m - 1)] for x in by_level(count[learnt])] if m else [[], []]
        return pa.table({
            "batch": asked["batch"], "group": asked["group"], "levels": pa.array(cut(level, pair_ends), pa.binary()), "counts": pa.array(cut(found, word_ends), pa.binary()),
            "pairs": pa.array(stats[0], pa.list_(pa.int64())), "total": pa.array(stats[1], pa.list_(pa.int64())),
        })

    sent = saved.mapInArrow(ask, "group long, batch long, pairs binary, times binary, words binary")
    told = sent.groupBy("group").cogroup(words.select("group", "hash", "count").groupBy("group"))
    told = scratch.save(told.applyInArrow(answer, "batch long, group long, levels binary, counts binary, pairs array<long>, total array<long>"), "told")
    values = values_of(told.filter("pairs IS NOT NULL"))

    def scored(batch: pa.Table, told: pa.Table) -> pa.Table:
        row = {c: batch[c][0] for c in batch.column_names}
        a, told = Asked(row, seed, groups), told.sort_by("group")
        level, count = flat(told["levels"], np.uint8)[0], np.empty(len(a.words), np.int64)
        count[a.by_group] = flat(told["counts"], np.int64)[0]
        base, context = np.log10((count + 1) / (n + v + 1)), np.log10(count + PRIOR)
        gained = np.log10(values[level] + (PRIOR * (count + 1) / (n + v + 1))[a.owner])
        before = contexts(context[a.codes], a.sizes, context[np.searchsorted(a.words, a.end)])
        starts = np.cumsum(a.sizes) - a.sizes
        columns = [np.add.reduceat(x, starts) for x in ((count > 0)[a.codes].astype(np.int64), base[a.codes], gained[a.at] - before)]
        return pa.table([row["doc_ids"].values, pa.array(a.sizes), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return saved.groupBy("batch").cogroup(told.select("batch", "group", "levels", "counts").groupBy("batch")).applyInArrow(scored, f"doc_id {kind_of_id(docs)}, {SCORES}")


def lm_scores(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Learns from the rows of docs that aren't held out, and scores all.  Null texts count as empty: one
    token, the end.  A null doc_id is not held out; repeated rows are learnt from and scored each;
    other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    train = docs.filter(~held_out(F.col("doc_id")))
    counted = count_words(train, scratch)
    _, n, *_, most = counted
    if most <= PASS_SHARDS * shard_bytes:
        scored = broadcast_scores(docs, fit(train, scratch, shard_bytes, counted))
    else:
        scored = dealt_scores(docs, counted, scratch)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
