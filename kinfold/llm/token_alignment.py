"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Tokens of both sides are byte ranges.  Each points to the farthest-right token that it overlaps, and
doubling the pointers leads every token to the last one of its group, which labels the group: the
tokens between two offsets at which tokens of both sides end.  All tokens of a batch of documents
are one set of arrays.

Which pairs of ids are linked in how many documents is counted over the whole corpus.  The pairs of
most documents, at most HEAVY of them because their counts sum up to all, are broadcast; the others
are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import gives_back, slices
from kinfold.scratch import Scratch

#: Characters with the Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text is cut before blanks and line ends that follow a character of another kind; where more blanks than those stand, by CUT.
CUT = re.compile(f"(?<=[^{WHITE}])(?=[ \\n])")
#: The same in the syntax of Arrow's expressions: a blank after white space, or a line end after white space that is none.
WIDE = re.sub(r"\\u(....)", r"\\x{\1}", WHITE)
ODD = f"[{WIDE}] |[{WIDE.replace(r'\t-\r', r'\t\x0b-\r')}]\\n"
#: Fixed value: the expression by which byte-level vocabularies of this kind split texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts that a worker remembers (twice so many at most), the longest such part, and parts that are encoded as one text.
CACHE_PARTS, CACHE_CHARS, TOGETHER = 150_000, 48, 4_000
#: The most pairs that are broadcast (17 bytes each).
HEAVY = 1 << 20
#: Links of a group that are listed one by one; beyond, different ids are multiplied.
LISTED = 4096

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, light array<long>, light_times array<int>"


class ByteTokens:
    """Tokens of a byte-level vocabulary (a tokenizers file).

    Where each merge of the file makes the token of the next id, as training leaves it, ids are ranks, and
    the faster library for ranks encodes; tests compare the two.
    """

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(file)
        self.coder.encode_special_tokens = True
        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        names, chars = told["model"]["vocab"], _byte_chars()
        special = {x["content"] for x in told["added_tokens"]}
        self.size = max(names.values()) + 1
        self.bytes = [b""] * self.size
        for name, i in names.items():
            if name not in special:
                self.bytes[i] = bytes(chars[c] for c in name)
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        split = told["pre_tokenizer"]
        ranked = split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and told["normalizer"] is None and [names[a + b] for a, b in merges] == list(range(256, 256 + len(merges)))
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        self.ranks = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def ids(self, part: str) -> list[int]:
        return self.ranks.encode_ordinary(part) if self.ranks else self.coder.encode(part, add_special_tokens=False).ids


class PieceTokens:
    """Tokens of a sentencepiece model that adds a space; a part that begins with a space is encoded without it."""

    def __init__(self, file: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=file)
        self.size = self.coder.get_piece_size()
        piece = self.coder.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.coder.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.size)]
        self.space = self.coder.piece_to_id("▁")

    def ids(self, part: str) -> list[int]:
        if part == " ":
            return [self.space]
        if part.startswith(" "):
            return self.coder.encode(part[1:])
        found = self.coder.encode(part)  # after a line end no space is added: the first piece is the added one
        return found[1:] if found and found[0] == self.space else []


def _byte_chars() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones as they are, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def parts_of(text: str) -> list[str]:
    """A space and the text, cut where no token of either side can run on; joined, they are that again."""
    return CUT.split(f" {text}")


class Coder:
    """Ids of parts of texts by both sides; remembers parts in two generations."""

    def __init__(self, file_a: str, file_b: str):
        self.sides = ByteTokens(file_a), PieceTokens(file_b)
        self.lengths = tuple(np.array([len(b) for b in side.bytes], np.int64) for side in self.sides)
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        texts = [[str(i).encode() + end for i in range(side.size) for end in ends] for side, ends in zip(self.sides, ((b",", b"|"), (b",", b";")), strict=True)]
        self.names = pa.array(texts[0] + texts[1], pa.binary())

    def known(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each of these different parts as bytes; None where the bytes of a side's tokens are not the part's."""
        if len(self.young) > CACHE_PARTS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        fresh = [p for p in parts if p not in young]
        new = []
        for p in fresh:
            if p in old:
                young[p] = old[p]
            else:
                new.append(p)
        # parts that any other may follow are encoded together
        plain = [p for p in new if p[0] in " \n" and "▁" not in p and not p[-1].isspace() and len(p) > 1]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            young.update(zip(some, self._together(some), strict=True))
        for p in new:
            if p not in young:
                young[p] = self._alone(p)
        found = [young[p] for p in parts]
        for p in new:
            if len(p) > CACHE_CHARS:
                del young[p]
        return found

    def _alone(self, part: str) -> tuple[bytes, bytes] | None:
        ids = [side.ids(part) for side in self.sides]
        same = all(b"".join(map(side.bytes.__getitem__, x)) == part.encode() for side, x in zip(self.sides, ids, strict=True))
        return tuple(np.array(x, np.int32).tobytes() for x in ids) if same else None

    def _together(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        text = "".join(parts)
        whole, ends = text.encode(), np.cumsum([len(p.encode()) for p in parts])
        cut = []
        for side, lengths in zip(self.sides, self.lengths, strict=True):
            ids = np.array(side.ids(text), np.int32)
            stops = np.cumsum(lengths[ids])
            at = np.searchsorted(stops, ends)
            if b"".join(map(side.bytes.__getitem__, ids.tolist())) != whole or not np.array_equal(stops[at], ends):
                return [self._alone(p) for p in parts]
            blob, places = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
            cut.append([blob[a:b] for a, b in zip(places[:-1], places[1:], strict=True)])
        return list(zip(*cut, strict=True))


@cache
def coder_of(file_a: str, file_b: str) -> Coder:
    """One for each worker process."""
    return Coder(file_a, file_b)


def split_texts(texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """The places of texts in an order of our own, and their parts in that order; texts must not be null."""
    odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.match_substring_regex(texts, "^[ \n]"))
    plain, rest = pc.indices_nonzero(pc.invert(odd)).to_numpy(), pc.indices_nonzero(odd).to_numpy()
    marked = pc.replace_substring_regex(texts.take(pa.array(plain)), "(\n+)", r" \1")
    lists = pc.split_pattern(marked, " ")
    words = lists.flatten()
    words = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise("", words, " "))
    counts = pc.list_value_length(lists).to_numpy()
    own = [parts_of(t) for t in texts.take(pa.array(rest)).to_pylist()]
    counts = np.concatenate([counts, [len(p) for p in own]]).astype(np.int64)
    flat = pa.concat_arrays([words, pa.array([p for parts in own for p in parts], words.type)])
    return np.concatenate([plain, rest]).astype(np.int64), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)


def strung(blobs: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the coded parts one after the other, and how many each part has."""
    pool, length = np.frombuffer(b"".join(blobs), np.int32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    first, own = (np.cumsum(length) - length)[codes], length[codes]
    stop = np.cumsum(own)
    return pool[np.repeat(first - (stop - own), own) + np.arange(stop[-1] if len(stop) else 0)], own


def group_of(stops_a: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each token of both sides, given where tokens end; both sides end at the same place.

    A token points to the other side's token over its last byte if that one ends later (of two that
    end together, the second side's is the last); doubling leads to the groups' last tokens.
    """
    n = len(stops_a)
    over_b, over_a = np.searchsorted(stops_b, stops_a), np.searchsorted(stops_a, stops_b)  # the first that ends there or later has the last byte
    to = np.concatenate([n + over_b, np.where(stops_a[over_a] > stops_b, over_a, n + np.arange(len(stops_b)))])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    last = to[n:] == n + np.arange(len(stops_b))
    number = np.cumsum(last) - 1
    return number[to[:n] - n], number[to[n:] - n]


def links(ids_a: np.ndarray, ids_b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray, docs: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair (a * wide + b) and number of links of each different pair of each document; docs are the groups' documents."""
    n_a, n_b = np.bincount(groups_a, minlength=len(docs)), np.bincount(groups_b, minlength=len(docs))
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    small = n_a * n_b <= LISTED
    own = np.where(small, n_b, 0)[groups_a]
    stop = np.cumsum(own)
    b = ids_b[np.repeat(first_b[groups_a] - (stop - own), own) + np.arange(stop[-1] if len(stop) else 0)]
    doc, pair = [np.repeat(docs[groups_a], own)], [np.repeat(ids_a.astype(np.int64), own) * wide + b]
    times = [np.ones(len(b), np.int64)]
    for g in np.flatnonzero(~small):
        (x, nx), (y, ny) = (np.unique(ids[at : at + n], return_counts=True) for ids, at, n in ((ids_a, first_a[g], n_a[g]), (ids_b, first_b[g], n_b[g])))
        pair.append((x.astype(np.int64)[:, None] * wide + y).ravel())
        times.append(np.outer(nx, ny).ravel())
        doc.append(np.full(len(pair[-1]), docs[g]))
    doc, pair, times = map(np.concatenate, (doc, pair, times))
    bits = max(1, int(pair.max(initial=0)).bit_length())
    key = doc << bits | pair
    if any(~small):
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
    else:
        key = np.sort(key)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new] >> bits, key[new] & ((1 << bits) - 1), np.add.reduceat(times, new) if len(new) else times


def aligned(batch: pa.RecordBatch, coder: Coder, first_row: int) -> pa.RecordBatch:
    """Rows of ALIGNED for a batch of doc_id and text; the rows' order may differ."""
    place, lists = split_texts(batch["text"].fill_null(""))
    coded = lists.flatten().dictionary_encode()
    blobs = coder.known(coded.dictionary.to_pylist())
    codes = coded.indices.to_numpy().astype(np.int64)
    n_parts = pc.list_value_length(lists).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(place)), n_parts)
    bad = np.array([b is None for b in blobs], bool)
    out = pc.binary_length(batch["text"].fill_null("")).to_numpy()[place] == 0
    if bad.any():
        out |= np.bincount(doc[bad[codes]], minlength=len(place)) > 0
    keep = ~out[doc]
    codes, doc = codes[keep], doc[keep]
    ids, n_docs, stops = [], [], []
    for side in (0, 1):
        x, own = strung([b[side] if b else b"" for b in blobs], codes)
        ids.append(x)
        n_docs.append(np.repeat(doc, own))
        stops.append(np.cumsum(coder.lengths[side][x]))
    n = [np.bincount(d, minlength=len(place)) for d in n_docs]
    n_groups, n_links, digests = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), [""] * len(place)
    pairs, times = [b""] * len(place), [b""] * len(place)
    if len(ids[0]):
        g_a, g_b = group_of(*stops)
        ends_a, ends_b = np.flatnonzero(np.diff(g_a, append=-1)), np.flatnonzero(np.diff(g_b, append=-1))
        docs = n_docs[0][ends_a]
        n_groups = np.bincount(docs, minlength=len(place))
        names = np.empty(len(g_a) + len(g_b), np.int64)
        closes_a, closes_b = np.zeros(len(g_a), np.int64), np.zeros(len(g_b), np.int64)
        closes_a[ends_a] = closes_b[ends_b] = 1
        names[np.arange(len(g_a)) + np.concatenate([[0], ends_b + 1])[g_a]] = 2 * ids[0] + closes_a
        names[np.arange(len(g_b)) + (ends_a + 1)[g_b]] = 2 * (coder.sides[0].size + ids[1]) + closes_b
        written = coder.names.take(pa.array(names))
        offsets, text = np.frombuffer(written.buffers()[1], np.int32)[: len(names) + 1], memoryview(written.buffers()[2])
        cuts = offsets[np.concatenate([[0], np.cumsum(n[0] + n[1])])].tolist()
        digests = [hashlib.sha256(text[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        of, pair, time = links(ids[0], ids[1], g_a, g_b, docs, coder.sides[1].size)
        cuts = np.searchsorted(of, np.arange(len(place) + 1)).tolist()
        n_links = np.diff(np.concatenate([[0], np.cumsum(time)])[cuts])
        pairs = [pair[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        times = [time[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = [pa.array(first_row + np.arange(len(place))), batch["doc_id"].cast(pa.int64()).take(pa.array(place))]
    columns += [pa.array(x.astype(np.int64)) for x in (*n, n_groups, n_links)] + [pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])


def alignments(docs: DataFrame, file_a: str, file_b: str, scratch: Scratch) -> DataFrame:
    """Rows of ALIGNED, saved: groups, links and different linked pairs of each document."""

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, at = coder_of(file_a, file_b), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 2_000_000):
            yield aligned(batch, coder, at)
            at += batch.num_rows

    return scratch.save(docs.select("doc_id", "text").mapInArrow(read, ALIGNED), "aligned")


def pair_counts(found: DataFrame, wide: int, scratch: Scratch) -> DataFrame:
    """pair, the number of documents that hold it linked, and whether no pair of its first id has more; saved."""

    @gives_back
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            pair, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(docs.astype(np.int64))], ["pair", "docs"])

        for batch in batches:
            for blob in batch["pairs"].to_pylist():
                held.append(np.frombuffer(blob, np.int64))
                size += len(held[-1])
                if size > 4_000_000:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    counts = found.select("pairs").mapInArrow(counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = scratch.save(counts, "counts")
    first = F.floor(F.col("pair") / wide)
    most = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("most"))  # as many rows as the first vocabulary has at most
    best = counts.join(F.broadcast(most), first == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    return scratch.save(best, "best")


def align(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs.

    Needs doc_id and text; other columns are not read.  Rows that repeat are documents of their own.
    A null or empty text, or one that a side's tokens do not give back byte by byte, has no tokens: zeros and ''.
    An empty table gives none.  Texts are read once; lists of pairs are saved beside them.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "align")
    found = alignments(docs, file_a, file_b, scratch)
    counts = pair_counts(found, PieceTokens(file_b).size, scratch)
    total = counts.agg(F.sum("docs")).first()[0] or 0
    least = -(-total // HEAVY) or 1  # counts of at least this much: HEAVY of them at most, as all sum up to total
    top = counts.filter(F.col("docs") >= least).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    heavy = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "docs", "best")))

    @gives_back
    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs_of, best = heavy.value
        for batch in batches:
            rows = []
            for own, times in zip(batch["pairs"].to_pylist(), batch["times"].to_pylist(), strict=True):
                own, times = np.frombuffer(own, np.int64), np.frombuffer(times, np.int32)
                at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
                hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                at, n = at[hit], times[hit].astype(np.int64)
                rows.append((int(n[best[at]].sum()), int((n * docs_of[at]).sum()), own[~hit], times[~hit]))
            n_best, sums, light, light_times = zip(*rows, strict=True) if rows else ((),) * 4
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in light])]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind))) for x, kind in ((light, np.int64), (light_times, np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names[:7]), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), *lists], [c.split()[0] for c in SUMS.split(", ")])

    told = scratch.save(found.mapInArrow(looked_up, SUMS), "told")
    light = told.filter(F.size("light") > 0).select("row", F.explode(F.arrays_zip("light", "light_times")).alias("x")).select("row", F.col("x.light").alias("pair"), F.col("x.light_times").alias("n"))
    light = light.join(counts.filter(F.col("docs") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("docs")).alias("more_sum"))
    out = told.drop("light", "light_times").join(light, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
