from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import common, exact_dedup, mixing, packing, queries


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "Beta,", "γάμμα.", "d-e", "éclair", "x"]) for _ in range(n))


def targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - most * sum(sizes[s] for s in capped)) / (sum(w for s, w in weight.items() if s not in capped) or 1)
        over = {s for s in sizes if s not in capped and most * sizes[s] < level * weight[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= over


def test_mixing_meets_targets(make):
    rows = [(i, words(i % 50 + 1, i), ["big", "tiny", None, "mid"][0 if i % 3 else 1 + i // 3 % 3 if i < 60 else 3]) for i in range(900)] + [(None, "a b"), (5000, None, "big"), (5001, "", "empty"), (5001, "", "empty"), (5002, "w " * 30_000, "big")]
    docs = make(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.mix_copies <= 3
        sizes[r.source] += r.mix_size
        taken[r.source] += r.mix_size * r.mix_copies
    wanted = targets(sizes)
    for r in got:
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(wanted[r.source])
    assert abs(taken["mid"] - wanted["mid"]) < 0.02 * wanted["mid"]
    again = {(r.doc_id, r.mix_copies) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.mix_copies) for r in got}
    assert mixing.emit(docs).count() == sum(r.mix_copies for r in got) and mixing.emit(docs).columns == docs.columns


def test_mixing_empty(make):
    assert mixing.mix(make([]).filter("doc_id < 0")).count() == 0
    assert [r.mix_copies for r in mixing.mix(make([(1, None), (2, "  \n")])).collect()] == [0, 0]


def texts():
    rng = random.Random(4)
    base = ["", None, "a", "a ", words(2000, 1), words(2000, 1)[:-1] + "y", "q" * 9000, "q" * 9001, "naïve\n\tέ 😀 " * 900]
    return [(i, rng.choice(base)) for i in range(300)] + [(7, "a"), (7, "a"), (None, "a"), (None, "only null id"), (None, "only null id")]


def test_exact_dedup_equals_brute_force(make, tables, spark):
    rows = texts()
    where = tables(documents=make(rows))
    got = queries.op3_exact_dedup(spark, where).collect()
    same = defaultdict(list)
    for i, t in rows:
        same[t or ""].append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in same.items()}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_sha256) for r in got) == sorted((i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert all((r.keep_id, r.group_size) == digest[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(same) and all(r.doc_id == r.keep_id for r in got if r.kept)
    plan = queries.op3_exact_dedup(spark, where)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    kept = exact_dedup.dedup(spark.read.parquet(f"{where}/documents.parquet"))
    assert kept.columns == make(rows).columns and kept.count() == len(same)
    assert exact_dedup.groups(make([]).filter("doc_id < 0")).count() == 0


def test_chunks_rebuild_texts_and_survive_insertions(make, spark):
    long = words(6000, 9)
    docs = make([(i, t) for i, (_, t) in enumerate(texts()) if t] + [(1000, long), (1001, "new start " + long)])
    parts = docs.select("doc_id", "text", exact_dedup.chunks(F.col("text")).alias("c"))
    assert parts.filter(F.concat_ws("", "c") != F.col("text")).count() == 0
    a, b = (set(r.c) for r in parts.filter("doc_id >= 1000").collect())
    assert len(a & b) > 0.8 * len(a) and max(map(len, a)) <= exact_dedup.MOST


def test_chunks_survive_insertions_in_other_scripts(make, spark):
    rng = random.Random(3)
    letters = {"два слова ": "абвгдежзийклмнопрст", "δύο λέξεις ": "αβγδεζηθικλμνξοπρστυ", "文字": "".join(map(chr, range(0x4E00, 0x9000))), "คำ": "".join(map(chr, range(0x0E01, 0x0E2F)))}
    rows = []
    for i, (start, chars) in enumerate(letters.items()):
        blanks = " " * 4 if chars[0] in "аα" else ""
        text = "".join(rng.choice(chars + blanks) for _ in range(30_000))
        rows += [(2 * i, text), (2 * i + 1, start + text)]
    got = {r.doc_id: set(r.c) for r in make(rows).select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()}
    for i in range(len(letters)):
        assert len(got[2 * i] & got[2 * i + 1]) > 0.8 * len(got[2 * i])


def test_dedup_by_bitmaps_in_slices_and_with_clashing_names(make, monkeypatch):
    rows = texts()
    docs = make(rows, size=common.KEY, digest="__file")
    wanted = sorted((r.doc_id or -1, r.text or "") for r in exact_dedup.dedup(docs).collect())
    assert len(wanted) == len({t or "" for _, t in rows})
    monkeypatch.setattr(common, "BITMAP_BYTES", 4096)  # a broadcast for each file or so
    kept = exact_dedup.dedup(docs)
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == wanted
    assert kept.columns == docs.columns and {r[common.KEY] for r in kept.collect()} == {7}
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().toString()


def test_mixing_keeps_columns_whose_names_clash(make):
    docs = make([(i, words(9, i), "a") for i in range(40)], size="mix_size", digest="__copy", kept="__mix_plan", lang="__s")
    out = mixing.emit(docs)
    assert out.columns == docs.columns and {(r.mix_size, r["__copy"], r["__mix_plan"], r["__s"]) for r in out.collect()} == {(7, "x", True, "en")}


def test_colliding_chunks_are_told_apart(make, spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    got = exact_dedup.groups(make([(1, "ab"), (2, "cd"), (3, "ab"), (4, "ef"), (5, "ef")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 5, 2), (5, 5, 2)]


def test_packing_round_trip(make, tables, spark):
    from tokenizers import Tokenizer

    file = queries.tokenizer_file()
    exact = Tokenizer.from_file(file)
    rng = random.Random(8)
    special = ["", None, "  \n\t ", "<|endoftext|> x", "DON'T İstanbul ΣΑΣ ß ǅ", "é combining", "Ω" * 3000, "3.14,5. a,b. ..", "no break", "\x1ca\x85b"]
    rows = [(i, t) for i, t in enumerate(special)] + [(100 + i, words(rng.randint(1, 4000), i)) for i in range(60)] + [(None, "null id"), (3, "twin"), (3, "twin"), (900, words(40_000, 3))]
    where = tables(documents=make(rows))
    got = queries.op4_packing(spark, where).collect()
    wanted = sorted((i if i is not None else -1, len(ids), zlib.crc32(ids.tobytes())) for i, ids in ((i, np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows))
    pieces = packing.pack(spark.read.parquet(f"{where}/documents.parquet"), file).orderBy("doc_id", "doc_tokens", "start").collect()
    assert sorted((r.doc_id or 0, r.start, r.length, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in pieces) == sorted((r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in got)
    rebuilt, current = [], {}
    for r in pieces:  # twins have one sequence of pieces each; they fit in one piece here
        if r.start == 0:
            current[r.doc_id, r.doc_tokens] = []
        ids = current[r.doc_id, r.doc_tokens]
        assert r.start == len(ids)
        ids += r.ids
        if len(ids) == r.doc_tokens:
            rebuilt.append((r.doc_id if r.doc_id is not None else -1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(rebuilt) == wanted
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack(make([]).filter("doc_id < 0"), file).count() == 0


def test_best_pattern_is_closest_to_capacity():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randint(5, 60)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {n: items.count(n) for n in items}
        order = sorted(counts, reverse=True)
        found = packing.best_pattern(counts, capacity, order)
        first = order[0]
        rest = sorted(items, reverse=True)[1:]
        best = max(s for mask in range(1 << len(rest)) if (s := first + sum(x for i, x in enumerate(rest) if mask >> i & 1)) <= capacity)
        assert all(0 < c <= counts[n] for n, c in found.items()) and found[first] >= 1
        assert sum(n * c for n, c in found.items()) == best


def test_words_of_letters_are_encoded_by_ranks_as_by_the_tokenizer():
    coder = packing.WordTokenizer(queries.tokenizer_file(), 2)
    assert coder.ranks is not None
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyzaeioutnsréßäöüñøłŵǆɏªº"
    words = ["a" * n for n in range(1, 40)] + ["é" * n for n in range(1, 20)]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    got = [np.frombuffer(x, np.int32).tolist() for x in coder._letters(words)]
    assert got == [coder.full.encode(w, add_special_tokens=False).ids for w in words]
    file = queries.tokenizer_file("byte_bpe_50k.json")
    assert packing.letter_ranks(file) is None and packing.WordTokenizer(file, 2).ranks is None  # it has no symbols for a word's end
