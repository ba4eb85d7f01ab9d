"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: its lower-cased words without outer punctuation, and the words'
beginnings, each hashed to one of SLOTS slots.  The machine has a weight and a short vector for each
slot; products of two slots' vectors let a pair weigh more, or less, than its members alone.  No term
is picked beforehand: all of the sample's terms are learnt from, and a penalty (on the weights, and
on each vector as a whole) leaves those at zero that neither alone nor in pairs tell the classes apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import TO_SPACE, gives_back, slices
from kinfold.llm.labelled import SAMPLE, held_out, sample

EDGES = ".,;:!?()[]{}\"'«»“”…-*#&$%|<>/\\"
PREFIX = 4
#: Slots that terms are hashed to, and the vectors' length.
SLOTS, FACTORS = 1 << 18, 8
CACHE_WORDS = 100_000


class Terms:
    """The slots of a text's different terms, ascending; words seen lately are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        plain = word.strip(EDGES)
        if not plain:
            return ()
        one = xxhash.xxh64_intdigest(plain) % SLOTS
        return (one, xxhash.xxh64_intdigest(plain[:PREFIX], 1) % SLOTS) if len(plain) > PREFIX else (one,)

    def of_text(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, found = self.known, set()
        for word in set((text or "").lower().translate(TO_SPACE).split(" ")):
            terms = known.get(word)
            if terms is None:
                terms = self.of_word(word)
                if len(word) <= 40:
                    known[word] = terms
            found.update(terms)
        return np.sort(np.fromiter(found, np.int64, len(found)))


def packed(slots: np.ndarray) -> bytes:
    """Ascending slots as 32-bit numbers, or as one bit for each slot where that is shorter: SLOTS / 8 bytes at most."""
    if 4 * len(slots) < SLOTS // 8:
        return slots.astype(np.uint32).tobytes()
    marks = np.zeros(SLOTS, bool)
    marks[slots] = True
    return np.packbits(marks).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if len(blob) == SLOTS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8)))
    return np.frombuffer(blob, np.uint32).astype(np.int64)


class Machine:
    """A bias, and weights and vectors by slot; score() is the probability of label 1."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def logit(self, slots: np.ndarray) -> float:
        v = self.vectors[slots].astype(np.float64)
        return float(self.bias + self.weights[slots].sum(dtype=np.float64) + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum())

    def score(self, slots: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.logit(slots), -40, 40))))


class Averages:
    """Regularised dual averaging: parameters follow from the sums of their gradients.

    A weight is zero while the mean of its gradients over all rows read so far stays below
    ``sparse``, a vector, apart from its small random start, while that of its gradients' length
    stays below ``sparse_pairs``.  So terms of few rows, and those of many that go with both
    labels, drop out of themselves.
    """

    def __init__(self, n: int, rng: np.random.Generator, sparse: float, sparse_pairs: float, rate: float):
        self.start = rng.normal(0, 0.015, (n, FACTORS)).astype(np.float32)
        self.total, self.squares = np.zeros((n, FACTORS + 1), np.float32), np.full((n, 2), 10.0, np.float32)
        self.sparse, self.sparse_pairs, self.rate, self.rows = sparse, sparse_pairs, rate, 0

    def moved(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and how far vectors are from their start."""
        one, pair = self.total[at, 0], self.total[at, 1:]
        weight = -self.rate * np.sign(one) * np.maximum(np.abs(one) - self.sparse * self.rows, 0) / np.sqrt(self.squares[at, 0])
        length = np.sqrt((pair**2).sum(1))
        share = np.maximum(length - self.sparse_pairs * self.rows, 0) / np.maximum(length, 1e-12) / np.sqrt(self.squares[at, 1])
        return weight, -0.5 * pair * share[:, None]

    def learn(self, at: np.ndarray, gradient: np.ndarray, rows: int) -> None:
        self.total[at] += gradient
        self.squares[at, 0] += gradient[:, 0] ** 2
        self.squares[at, 1] += (gradient[:, 1:] ** 2).mean(1)
        self.rows += rows


def train(rows: list[bytes], y: np.ndarray, reads: int = 60_000, batch: int = 64, positive: float = 2.0, sparse: float = 0.003, sparse_pairs: float = 0.005, rate: float = 3.0) -> Machine:
    """A machine from packed rows of slots: logistic loss, label 1 counting ``positive`` times, in 6 to 100 rounds of about ``reads`` rows.

    With fewer than 3000 rows, whose means are noisier, the penalties grow as the noise does.  With labels of one kind the score is that label, without any 0.
    """
    weights, vectors = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32)
    if len(set(y.tolist())) < 2:
        return Machine(40.0 if len(y) and y[0] else -40.0, weights, vectors)
    rng, bias = np.random.default_rng(7), float(np.log(y.mean() / (1 - y.mean())))
    few = max(1.0, math.sqrt(3000 / len(y)))
    learnt = Averages(SLOTS, rng, sparse * few, sparse_pairs * few, rate)
    for _ in range(max(6, min(100, reads // len(y)))):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            lists = [unpacked(rows[i]) for i in part]
            flat, row = np.concatenate(lists), np.repeat(np.arange(len(part)), [len(x) for x in lists])
            at, place = np.unique(flat, return_inverse=True)
            w, v = learnt.moved(at)
            v = (v + learnt.start[at])[place]
            total = np.stack([np.bincount(row, v[:, k], len(part)) for k in range(FACTORS)], 1)
            logit = bias + np.bincount(row, w[place], len(part)) + 0.5 * ((total**2).sum(1) - np.bincount(row, (v**2).sum(1), len(part)))
            g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[part]) * np.where(y[part] == 1, positive, 1.0)
            pair = g[row, None] * (total[row] - v)
            columns = [np.bincount(place, x, len(at)) for x in (g[row], *pair.T)]
            learnt.learn(at, np.stack(columns, 1).astype(np.float32), len(part))
            bias -= 0.05 * float(g.mean())
    weights, moved = learnt.moved(np.arange(SLOTS))
    return Machine(bias, weights.astype(np.float32), np.where(moved.any(1)[:, None], moved + learnt.start, 0).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Machine:
    """A machine from at most ``rows`` labelled documents of any length: each takes SLOTS / 8 bytes of the driver at most.

    Equal sets of slots with equal labels count once.
    """

    @gives_back
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Terms()
        for batch in slices(batches, "text"):
            sets = [packed(reader.of_text(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.int32()), pa.array(sets, pa.binary())], ["label", "terms"])

    table = sample(docs, labels, "toxic", rows).select("text", "label").mapInArrow(terms, "label int, terms binary").toArrow()
    found = {(blob, int(y)) for blob, y in zip(table["terms"].to_pylist(), table["label"].to_pylist(), strict=True)}
    order = sorted(found)
    return train([blob for blob, _ in order], np.array([label for _, label in order], float))


def score(docs: DataFrame, machine: Machine, name: str = "toxicity") -> DataFrame:
    """docs with one more column: the probability (0 to 1) that a text is toxic; null counts as empty.

    Whole texts are read; rows with equal texts get equal scores; a column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @gives_back
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, fm = Terms(), sent.value
        for batch in slices(batches, "text"):
            values = pa.array([fm.score(reader.of_text(t)) for t in batch["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), values], [*rest, name])

    rest = [c for c in docs.columns if c != name]
    schema = T.StructType([f for f in docs.schema if f.name != name] + [T.StructField(name, T.DoubleType())])
    return docs.select(*rest).mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold``) of each row of docs.

    Needs doc_id and text of docs, doc_id and toxic of labels; other columns are not read.  Null and
    empty texts have no terms and get the machine's bias alone.  With labels of one kind only every
    score is that label, without any 0.  An empty docs gives no rows; repeated rows are scored each.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
