"""Quality by random-indexing word vectors and a small network.

A word that makes up at least FREQUENCY of all words of the collection has a vector of its own, so
there are 1 / FREQUENCY of them at most, however large the collection; rarer words share the vector
of their shape.  A word like the one before it, and words of a line that the text had before, count as
words of two further kinds.  Every vector is the sum of the sparse random index vectors of its
neighbours over the whole collection.  A document pools the vectors of its words; a two-layer
network, whose probabilities are calibrated by a temperature, reads the pool and nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import gives_back, slices, split_words, words_of
from kinfold.llm.labelled import SAMPLE, held_out, sample
from kinfold.scratch import Scratch

#: The least share of all words that gives a word its own vector; shapes of other words, by hash.
FREQUENCY, SHAPES = 1e-4, 2048
#: Length of vectors, non-zero numbers of an index vector, rows of a piece of the table.
WIDTH, ONES, PIECE = 64, 4, 64
#: Different words that a task counts before it sends them on; shapes whose kind a worker remembers.
HELD, CACHE_FORMS = 400_000, 50_000
HIDDEN = 32
RUNS = [(re.compile(p), to) for p, to in ((r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (r"\d+", "0"))]


def index_vectors(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the ONES non-zero numbers of each kind's index vector."""
    mixed = np.asarray(kinds, np.uint64)[:, None] + np.arange(1, ONES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return (mixed % np.uint64(WIDTH)).astype(np.int64), np.where(mixed >> np.uint64(63), 1.0, -1.0)


def shape(word: str) -> str:
    """Runs of letters by their case, runs of digits as 0, everything else as it is."""
    tail = "" if word.isalpha() or word[-1:].isalnum() else word[-1:]
    letters = word[: len(word) - len(tail)]
    if letters.isalpha():  # most words: one run, and a full stop or the like
        return ("A" if letters.isupper() else "Aa" if letters[0].isupper() else "a") + tail
    for pattern, to in RUNS:
        word = pattern.sub(to, word)
    return word


def frequent(docs: DataFrame, scratch: Scratch) -> np.ndarray:
    """Sorted 64-bit hashes of the words that make up FREQUENCY of all words or more; all words are counted."""

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(seen.values()), pa.int64())], ["hash", "count"])

        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            codes, _, words = split_words(batch["text"])
            for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                seen[word] += n
            if len(seen) > HELD:
                yield rows(seen)
                seen = Counter()
        if seen:
            yield rows(seen)

    counts = docs.select("text").mapInArrow(count, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))
    counts = scratch.save(counts, "words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = counts.filter(F.col("count") >= F.lit(FREQUENCY * total)).select("hash").toArrow()
    scratch.drop("words")
    return np.sort(found["hash"].to_numpy().view(np.uint64))


class Reader:
    """Kinds of the words of texts: a frequent word's own, or its shape's, then repeated words, then words of repeated lines."""

    def __init__(self, words: np.ndarray):
        self.words, self.again = words, len(words) + SHAPES
        self.kinds = self.again + 2
        self.forms: dict[str, int] = {}

    def form(self, word: str) -> int:
        form = shape(word)
        kind = self.forms.get(form)
        if kind is None:
            kind = len(self.words) + xxhash.xxh32_intdigest(form, 1) % SHAPES
            if len(self.forms) < CACHE_FORMS and len(form) <= 40:
                self.forms[form] = kind
        return kind

    def kinds_of(self, words: list[str]) -> np.ndarray:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        kinds = np.searchsorted(self.words, hashes)
        rare = self.words[np.minimum(kinds, len(self.words) - 1)] != hashes if len(self.words) else np.ones(len(words), bool)
        kinds[rare] = [self.form(words[i]) for i in np.flatnonzero(rare).tolist()]
        return kinds

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The kinds of all words of the texts, one text after the other, and the texts' numbers of words."""
        ids, sizes, words = split_words(texts)
        table = self.kinds_of(words)
        kinds = table[ids] if len(ids) else np.empty(0, np.int64)
        starts = np.cumsum(sizes) - sizes
        same = np.zeros(len(ids), bool)
        same[1:] = ids[1:] == ids[:-1]
        same[starts[sizes > 0]] = False
        kinds[same] = self.again
        several = np.flatnonzero(pc.greater(pc.count_substring(texts.fill_null(""), "\n"), 0).to_numpy(zero_copy_only=False))
        for start, text in zip(starts[several].tolist(), texts.take(pa.array(several)).to_pylist(), strict=True):
            lines = text.split("\n")
            if len(set(lines)) < len(lines):
                seen, at = set(), start
                for line in lines:
                    n = len(words_of(line))
                    if line in seen:
                        kinds[at : at + n] = self.again + 1
                    seen.add(line)
                    at += n
        return kinds, sizes


def context_table(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Vectors of all kinds (unit length, zero if never seen) from all neighbours in all texts; the pieces of tasks are summed by Spark."""
    rows = Reader(words).kinds
    rows += -rows % PIECE

    @gives_back
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(words), np.zeros(rows * WIDTH)
        at, sign = index_vectors(np.arange(rows))
        for batch in slices(batches, "text"):
            kind, sizes = reader.read(batch["text"])
            ends = np.cumsum(sizes)
            joined = np.ones(max(len(kind) - 1, 0), bool)
            joined[ends[(ends > 0) & (ends < len(kind))] - 1] = False
            left, right = kind[:-1][joined], kind[1:][joined]
            for a, b in ((left, right), (right, left)):
                for j in range(ONES):
                    total += np.bincount(a * WIDTH + at[b, j], sign[b, j], rows * WIDTH)
        pieces = total.astype(np.int32).reshape(-1, PIECE * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "sums"])

    def summed(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PIECE * WIDTH, np.int64)
        for batch in rows:
            for x in batch["sums"].to_pylist():
                total += np.frombuffer(x, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "sums"])

    table = np.zeros((rows, WIDTH))
    for row in docs.select("text").mapInArrow(partial, "piece int, sums binary").groupBy("piece").applyInArrow(summed, "piece int, sums binary").collect():
        table[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(bytes(row["sums"]), np.int64).reshape(PIECE, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(reader: Reader, table: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The mean of the vectors of each text's words; zeros for a text without words."""
    kinds, sizes = reader.read(texts)
    out = np.zeros((len(texts), WIDTH), np.float32)
    start = 0
    for i, n in enumerate(sizes.tolist()):
        if n > 2 * len(table):
            out[i] = np.bincount(kinds[start : start + n], minlength=len(table)).astype(np.float32) @ table / n
        elif n:
            out[i] = table[kinds[start : start + n]].sum(0) / n
        start += n
    return out


class Network:
    """Two layers, a temperature; probabilities of label 1."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], temperature: float):
        self.mean, self.scale, self.layers, self.temperature = mean, scale, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.003, decay: float = 1e-3) -> Network:
    """Adam on four fifths of the rows, the temperature on the rest.  Without both labels every score is their share (0.5 without any)."""
    x = x.astype(np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    rng = np.random.default_rng(5)
    layers = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    net = Network(mean, scale, layers, 1.0)
    if len(set(y.tolist())) < 2:
        layers[2][:] = 0
        layers[3][:] = 40.0 * (2 * y[0] - 1) if len(y) else 0.0
        return net
    order = rng.permutation(len(y))
    test, learn = order[: len(y) // 5], order[len(y) // 5 :]
    z = np.clip((x - mean) / scale, -8, 8)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
            h = np.tanh(z[part] @ layers[0] + layers[1])
            g = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -40, 40))) - y[part, None]) / len(part)
            back = (g @ layers[2].T) * (1 - h**2)
            step += 1
            for p, grad, (m, s) in zip(layers, (z[part].T @ back, back.sum(0), h.T @ g, g.sum(0)), state, strict=True):
                grad = grad + decay * p / len(learn)
                m += 0.1 * (grad - m)
                s += 0.001 * (grad**2 - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    if len(test):
        logits = net.logits(x[test])
        loss = lambda t: np.logaddexp(0, np.where(y[test] == 1, -1, 1) * logits / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, words: np.ndarray, table: np.ndarray, rows: int = SAMPLE) -> Network:
    """A network from at most ``rows`` labelled documents; only their pools, of WIDTH numbers each, reach the driver."""
    sent = docs.sparkSession.sparkContext.broadcast((words, table))

    @gives_back
    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, vectors = Reader(sent.value[0]), sent.value[1]
        for batch in slices(batches, "text"):
            x = pooled(reader, vectors, batch["text"])
            yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "pool"])

    found = sample(docs, labels, "quality", rows).select("text", "label").mapInArrow(pools, "label int, pool binary").toArrow()
    order = sorted(zip(found["pool"].to_pylist(), found["label"].to_pylist(), strict=True))
    x = np.frombuffer(b"".join(p for p, _ in order), np.float32).reshape(-1, WIDTH)
    return train(x, np.array([y for _, y in order], float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold``) of each row of docs.

    Needs doc_id and text of docs, doc_id and quality of labels; other columns are not read.  Null
    and empty texts have a pool of zeros and are scored like any other.  Without labels of both
    kinds every score is near their share (0.5 without any).  An empty docs gives no rows; repeated rows are scored each.
    """
    words = frequent(docs, Scratch(docs.sparkSession, "quality"))
    table = context_table(docs, words)
    sent = docs.sparkSession.sparkContext.broadcast((words, table, fit(docs, labels, words, table, rows)))

    @gives_back
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors, net = sent.value
        reader = Reader(words)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(net.score(pooled(reader, vectors, batch["text"])), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scores = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
