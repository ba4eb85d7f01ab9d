"""Packing of tokenised documents into fixed windows by minimum bin slack.

Whole windows are cut from each document; what remains of it is shorter than a window.  Tasks gather
pools of remainders; for each window a subset-sum dynamic program over the pool's lengths, kept as
bitsets in integers, finds the multiset that comes closest to the capacity, and the counts of each
length are read back from it.  A pattern is used as long as the pool lasts.  The few windows that
stay open at the end of a task are cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kinfold.llm.common import gives_back, slices

CAPACITY = 4096
#: A pool is packed when it holds so many tokens; more make fuller windows and larger workers.
POOL_TOKENS = 2_000_000
#: Words whose ids a worker remembers (twice so many at most), and the longest such word.
CACHE_WORDS, CACHE_CHARS = 600_000, 48

#: Bytes of texts that are encoded at once.
SLICE = 4_000_000

#: Letters below this one, U+0250, stand alone in NFC, and lower-case without regard to their neighbours.
LATIN = "\u0250"
#: What byte-level vocabularies write for bytes that do not print: the characters from U+0100 on, in turn.
BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}
#: Of words of letters below LATIN, lower-cased: the bytes that can end one, and what stands for each of them at a word's end where symbols are single bytes.
LAST = {b: bytes([b - 0x20]) for b in range(0x61, 0x7B)} | {b: bytes([b - 0x80]) for b in range(0x80, 0xC0)}
#: A tokenizer is tried out on these words.
PROBE = "The Mañana, straße. ÉTÉ naïveté, x don't e-mail 3.5 A, ÿ. Łódź ęàÀÞþ ?! antidisestablishmentarianism. b b"

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def letter_ranks(file: str) -> Callable[[bytes], list[int]] | None:
    """An encoder by ranks for words of letters, their last byte as in LAST, if the file's ids allow it; else None.

    A byte at a word's end is a symbol of its own in such files.  The letters' bytes, and these once more as last
    ones, are fewer than 256 symbols, so that a library for bytes can merge them.
    """
    import tiktoken

    with open(file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, names = model.get("end_of_word_suffix"), model.get("vocab")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or ()]
    if model.get("type") != "BPE" or not end or not merges or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        return None
    made = [names.get(a + b) for a, b in merges]
    if made[0] is None or made != list(range(made[0], made[0] + len(made))):
        return None
    chars = {chr(b): b for b in range(256) if b not in BYTES} | {chr(c): b for b, c in BYTES.items()}
    inner = {b: bytes([b]) for b in (*range(0x61, 0x7B), *range(0x80, 0x100))}
    ranks = {}
    for name, i in names.items():
        stem, last = (name.removesuffix(end), LAST) if name.endswith(end) else (name, inner)
        symbols = [chars.get(c) for c in stem]
        if symbols and symbols[-1] in last and all(b in inner for b in symbols[:-1]):
            ranks[b"".join(inner[b] for b in symbols[:-1]) + last[symbols[-1]]] = i
    return tiktoken.Encoding("letters", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordTokenizer:
    """Ids of whole texts by a tokenizers file.

    Where the file's pre-tokenizer never joins across a space, texts are split at spaces, each
    different part is encoded once, and the ids are strung together.  Where it also lower-cases, and
    turns words of letters into the model's characters for bytes, such words skip its regular
    expressions, apart from a full stop or comma at their end; where each merge of the file also makes the
    next id, ids are ranks, and the faster library for ranks encodes them.  All is tried out on PROBE first.
    Ids of parts are kept as bytes in two generations: when the young one is full it becomes the old
    one, and parts that are met again move back, so that frequent words stay.
    """

    def __init__(self, file: str, end: int, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.full, self.end, self.cache_words = Tokenizer.from_file(file), np.array([end], np.int32).tobytes(), cache_words
        self.plain, self.ranks = Tokenizer(self.full.model), letter_ranks(file)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        exact = lambda text: self.full.encode(text, add_special_tokens=False).ids
        self.apart = exact(PROBE) == [i for w in PROBE.split(" ") for i in exact(w)]
        self.tails = {c: np.array(exact(c), np.int32).tobytes() for c in ".,"}
        words = PROBE.split(" ")
        ready = self.apart and [np.frombuffer(x, np.int32).tolist() for x in self.encoded(words)] == [exact(w) for w in words]
        if not ready:
            self.tails = {}
            self.young = {}
            self.ranks = None

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ") if self.apart else pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts)
        coded = lists.flatten().dictionary_encode()
        blobs = [*self.encoded(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), self.end]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
        codes = np.insert(coded.indices.to_numpy(), ends, len(blobs) - 1)
        pool, length = np.frombuffer(b"".join(blobs), np.int32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        first, own = np.cumsum(length) - length, length[codes]
        stop = np.cumsum(own)
        out = pool[np.repeat(first[codes] - (stop - own), own) + np.arange(stop[-1] if len(stop) else 0)]
        cuts = stop[ends + np.arange(len(ends))]
        return [out[a:b] for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True)] if len(cuts) else []

    def encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each of these different parts, as bytes."""
        if len(self.young) > self.cache_words:
            self.old, self.young = self.young, {}
        known, old, tails = self.young, self.old, self.tails
        blobs = list(map(known.get, words))
        missing = [i for i, blob in enumerate(blobs) if blob is None]
        letters: dict[str, int] = {}  # words of letters
        places: list[tuple[int, int, bytes | None]] = []  # those that take the ids of such a word, and a tail
        others = []
        fresh = [words[i] for i in missing]
        for i, word, blob in zip(missing, fresh, map(old.get, fresh), strict=True):
            if blob is None:
                tail = tails.get(word[-1:])
                core = word.lower() if tail is None else word[:-1].lower()
                if not (tails and core.isalpha() and (core.isascii() or max(core) < LATIN)):
                    others.append(i)
                    continue
                done = known.get(core)
                if done is None:
                    places.append((i, letters.setdefault(core, len(letters)), tail))
                    continue
                blob = done if tail is None else done + tail
            blobs[i] = blob
        for i, ids in zip(others, self._batch(self.full, [words[i] for i in others]), strict=True):
            blobs[i] = ids
        coded = self._letters(letters)
        for i, at, tail in places:
            blobs[i] = coded[at] if tail is None else coded[at] + tail
        known.update(zip(fresh, [blobs[i] for i in missing], strict=True))
        for word in [w for w in fresh if len(w) > CACHE_CHARS]:
            del known[word]
        return blobs

    def _letters(self, words: Iterable[str]) -> list[bytes]:
        """The ids of words of letters below LATIN, lower-cased."""
        if self.ranks:
            encoded = (w.encode() for w in words)
            return [array("i", self.ranks(w[:-1] + LAST[w[-1]])).tobytes() for w in encoded]
        return list(self._batch(self.plain, [w if w.isascii() else w.encode().decode("latin-1").translate(BYTES) for w in words]))

    def _batch(self, tokenizer: object, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            code = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, start = np.array(code.ids, np.int32).tobytes(), 0
            for end in (4 * np.cumsum(np.bincount(np.array(code.word_ids, np.int64), minlength=len(some)))).tolist():
                yield ids[start:end]
                start = end


@cache
def tokenizer_of(file: str, end: int, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    """One for each worker process, so that its memory lasts from task to task."""
    return WordTokenizer(file, end, cache_words)


def best_pattern(lengths: dict[int, int], capacity: int, order: list[int]) -> dict[int, int]:
    """The multiset of the available lengths (length: count) that holds the longest one and fills the capacity most.

    ``order`` has the lengths in descending order.  Bit s of ``reach`` says that a sum of s can be
    made; after each step its bitset is kept, and the counts are read back from the last step to the
    first.  The search stops at an exact fill.
    """
    first = order[0]
    room, mask = capacity - first, (1 << (capacity - first + 1)) - 1
    reach, steps = 1, []
    for n in order:
        left, lot = min(lengths[n] - (n == first), room // n), 1
        while left > 0 and not reach >> room & 1:
            lot = min(lot, left)
            steps.append((n, lot, reach))
            reach |= (reach << n * lot) & mask
            left, lot = left - lot, lot * 2
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, defaultdict(int, {first: 1})
    for n, lot, before in reversed(steps):
        if not before >> total & 1:
            found[n] += lot
            total -= n * lot
    return dict(found)


class Packer:
    """Turns documents' ids into rows of PIECES; sequence ids are unique with a task's own base."""

    def __init__(self, base: int, capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS):
        self.next, self.capacity, self.pool_tokens = base, capacity, pool_tokens
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.held = 0

    def place(self, items: list[tuple]) -> Iterator[tuple]:
        """One sequence with these (doc_id, start, doc_tokens, ids), one after the other."""
        at, number = 0, self.next
        self.next += 1
        for doc_id, start, doc_tokens, ids in items:
            yield doc_id, start, len(ids), doc_tokens, number, at, ids
            at += len(ids)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield from self.place([(doc_id, start, len(ids), ids[start : start + self.capacity])])
        if rest := len(ids) - whole:
            self.pool[rest].append((doc_id, whole, len(ids), ids[whole:].copy()))
            self.held += rest
            if self.held >= self.pool_tokens:
                yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Fill windows from the pool; without ``last``, inexact fills wait for more documents."""
        counts = {n: len(x) for n, x in self.pool.items() if x}
        order = sorted(counts, reverse=True)
        while order:
            pattern = best_pattern(counts, self.capacity, order)
            exact = sum(n * c for n, c in pattern.items()) == self.capacity
            if not exact and not last:
                break
            for _ in range(min(counts[n] // c for n, c in pattern.items())):
                items = [self.pool[n].pop() for n, c in sorted(pattern.items(), reverse=True) for _ in range(c)]
                self.held -= sum(len(x[3]) for x in items)
                for n, c in pattern.items():
                    counts[n] -= c
                yield from self.place(items) if exact else self.cut(items)
            for n in pattern:
                if not counts[n]:
                    order.remove(n)

    def cut(self, items: list[tuple]) -> Iterator[tuple]:
        """Sequences of descending powers of two that together hold the items: no padding."""
        left = sum(len(x[3]) for x in items)
        while left:
            room, taken = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, doc_tokens, ids = items.pop(0)
                if len(ids) > room:
                    items.insert(0, (doc_id, start + room, doc_tokens, ids[room:]))
                    ids = ids[:room]
                taken.append((doc_id, start, doc_tokens, ids))
                room -= len(ids)
            yield from self.place(taken)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, length, doc_tokens, number, at, ids = zip(*rows, strict=True)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc_id, start, length, doc_tokens, number, at)), lists], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def with_crc(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pieces with ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit numbers, instead of ids."""
    lists = batch["ids"]
    flat, at = lists.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(int)
    sums = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
    names = [c for c in batch.schema.names if c != "ids"]
    return pa.RecordBatch.from_arrays([*(batch[c] for c in names), sums], [*names, "ids_crc32"])


#: The columns that with_crc returns.
CRC_PIECES = PIECES.replace("ids array<int>", "ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = PIECES, cache_words: int = CACHE_WORDS, slice_bytes: int = SLICE) -> DataFrame:
    """Rows of PIECES: every id of every document, with its end id, lies in exactly one piece.

    Needs doc_id and text.  A null or empty text is the end id alone; a null doc_id stays null; rows
    that repeat are packed each; long texts are cut every ``capacity`` ids; other columns are not
    read; an empty table gives no pieces.  Sequences hold ``capacity`` ids or a power of two.  Nothing
    is shuffled, and a task that is run again gives the same rows.  ``finish`` turns batches of pieces
    into others, of ``schema``, before they leave the worker.  ``cache_words`` and ``slice_bytes`` are what a
    worker remembers and encodes at once: memory against time, with the same rows.
    """

    @gives_back
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packer = tokenizer_of(tokenizer, end, cache_words), Packer(TaskContext.get().partitionId() << 40, capacity, pool_tokens)

        def pieces() -> Iterator[tuple]:
            for batch in slices(batches, "text", slice_bytes):
                texts = batch["text"].fill_null("")
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), coder.ids(texts), strict=True):
                    yield from packer.add(doc_id, ids)
            yield from packer.pack(True)

        rows, held = [], 0
        for piece in pieces():
            rows.append(piece)
            held += piece[2]
            if held > 1_000_000:
                yield finish(_batch(rows)) if finish else _batch(rows)
                rows, held = [], 0
        if rows:
            yield finish(_batch(rows)) if finish else _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(packed, schema)
