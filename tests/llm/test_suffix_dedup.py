from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from kinfold.llm import induced_sort, queries, suffix_dedup


def check_order(parts, most):
    data = b"\0" + b"".join(p + b"\0" for p in parts)
    order, shared = induced_sort.sorted_suffixes(np.frombuffer(data, np.uint8), most)
    assert sorted(order.tolist()) == list(range(1, len(data) - 1))
    suffixes = [data[i : data.index(0, i)] for i in order.tolist()]
    for a, b, n in zip(suffixes[:-1], suffixes[1:], shared[1:].tolist(), strict=True):
        same = next((i for i in range(min(len(a), len(b), most)) if a[i] != b[i]), min(len(a), len(b), most))
        assert n == same
        assert same == min(len(a), len(b)) or a[: same + 1] <= b[: same + 1]


@pytest.mark.parametrize("small", [False, True])
def test_induced_order_and_common_prefixes(monkeypatch, small):
    if small:  # all arrays in files, blocks of a few tuples, queues that merge their runs
        for name, value in (("BLOCK", 8), ("BATCH", 4), ("RUNS", 3), ("MEMORY", 100)):
            monkeypatch.setattr(induced_sort, name, value)
    rng = random.Random(small)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 5, 200])
        parts = [bytes(rng.randrange(1, 1 + letters) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 12))]
        parts += parts[: rng.randrange(4)]
        check_order(parts, rng.choice([1, 5, 50]))
    check_order([b"a" * 300, b"a" * 299, b"ab" * 120, b"b" * 70], 50)
    check_order([b"\x01"], 5)


def brute(rows, length=50):
    """Removal of every byte under a string that starts in a document with a smaller doc_id."""
    least = {}
    value = lambda d: -(1 << 63) if d is None else d
    for doc_id, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(least.get(s, value(doc_id)), value(doc_id))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < value(doc_id):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def documents():
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "γάμμα", "d-e", "éclair", "x", "zu", "\n"]) + str(rng.randrange(60))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(8, 40)) for _ in range(6)]
    rows = []
    for i in range(150):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            t = t[: len(t) // 2] + p[cut:] + t[len(t) // 2 :]
        rows.append((i, t))
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(3, rows[50][1]), (3, passages[0]), (None, passages[1]), (None, passages[1])]
    fifty = "0123456789" * 5
    rows += [(300, fifty), (301, fifty), (302, "a" + fifty[:49]), (303, fifty[1:] + "!"), (304, "é" * 25), (305, "xé" + "é" * 25), (306, "é" * 24)]
    rows += [(400, "=" * 3000), (401, "=" * 700 + "ab" * 400), (402, "ab" * 90 + "="), (403, None), (404, ""), (405, " " * 49), (406, "\n".join(["same line"] * 300)), (407, "\n".join(["same line"] * 30))]
    # one line in very many documents, with different surroundings
    rows += [(1000 + i, f"{i * 7919}{text(2)} this line stands in every one of these documents, word for word {i * 104729} {text(2)}") for i in range(200)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 20])
def test_removals_equal_brute_force(make, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    rows = documents()
    found = suffix_dedup.removals(make(rows)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found), key=repr)
    assert got == brute(rows)
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and len(r.removed) == r.n_spans


def test_long_text_and_its_copy(make):
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(120_000))
    got = {r.doc_id: r for r in suffix_dedup.removals(make([(1, long), (2, "before " + long + " after"), (3, "x")])).collect()}
    assert (got[1].n_removed, got[3].n_removed) == (0, 0)
    assert (got[2].n_removed, got[2].n_spans, got[2].kept) == (len(long), 1, b"before  after")


def test_empty_tables(make):
    docs = make([(1, None), (2, "short")])
    assert suffix_dedup.removals(docs.filter("doc_id > 2")).count() == 0
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept) for r in suffix_dedup.removals(docs).collect()) == [(1, 0, 0, b""), (2, 5, 0, b"short")]


def test_query(spark, tables):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.op11_suffix_dedup(spark, tables(documents=docs)).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_spans_come_back_maximal_and_in_order(make, spark):
    rng = random.Random(3)
    passages = [" ".join(str(rng.randrange(10**6)) for _ in range(n)) for n in (60, 9, 200)]
    scratch = suffix_dedup.Scratch(spark, "t")
    docs = make([(1, "; ".join(passages)), (2, f"é{passages[2]} - {passages[0]}, and {passages[1]}"), (3, "none of it")])
    keyed = suffix_dedup.with_key(docs.select("doc_id", "text"), scratch)
    got = [[(s.start, s.size) for s in r.gone] for r in suffix_dedup.spans(keyed, scratch).collect()]
    a, b, c = (len(p) for p in passages)
    assert got == [[(2, c), (2 + c + 3, a), (2 + c + 3 + a + 5, b + 1)]]


def test_bits_in_ranges_and_copies_by_a_join(make, monkeypatch):
    from kinfold.llm import common

    monkeypatch.setattr(suffix_dedup, "BIT_BYTES", 1)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 100)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = documents()
    found = suffix_dedup.removals(make(rows).repartition(5)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found), key=repr)
    assert got == brute(rows)


def test_fragments_that_share_a_gram_only_are_not_moved(make, monkeypatch):
    moved, save = [], suffix_dedup.Scratch.save

    def spied(self, df, *names, **more):
        out = save(self, df, *names, **more)
        if "fragment" in out.columns:
            moved.append(out.filter("fragment IS NOT NULL").count())
        return out

    monkeypatch.setattr(suffix_dedup.Scratch, "save", spied)
    rng = random.Random(5)
    apart = lambda: "".join(rng.choice("bcdfghjklm") for _ in range(30))
    phrases = ["nopqrstuvwxyz nopqrs", "z y x w v u t s r q ", "0123456789 987654321"]
    rows = [(i, "".join(apart() + p for p in phrases) + apart()) for i in range(300)]  # 20 bytes are shared, never 33
    found = suffix_dedup.removals(make(rows)).collect()
    assert sum(r.n_removed for r in found) == 0
    assert sum(moved) == 0
    moved.clear()
    rows += [(1000 + i, f"{apart()}{'AB'[i]}{rows[0][1][:60]}") for i in range(2)]
    assert sum(r.n_removed for r in suffix_dedup.removals(make(rows)).collect()) == 120
    assert 0 < sum(moved) < 60


def test_hashes_of_sides_are_shared_by_equal_strings():
    rng = random.Random(9)
    same = bytes(rng.randrange(97, 123) for _ in range(suffix_dedup.LENGTH))
    for _ in range(200):
        texts = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(60))) + same + bytes(rng.randrange(97, 123) for _ in range(rng.randrange(60))) for _ in range(2)]
        text, _, _, _, sides, run = suffix_dedup.fragments(np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]))
        one, two = (set(sides[text[run] == i].tolist()) for i in range(2))
        assert one & two
