from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinfold.llm import queries, token_alignment
from kinfold.llm.queries import tokenizer_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(B))
    chars = {c: x for c, x in token_alignment._byte_chars().items()}
    vocab = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}

    def tokens(text):
        """(ids, bytes) of both sides, by encoding the whole text."""
        x = a.encode(f" {text}", add_special_tokens=False).ids
        y = b.encode(text)
        pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        return (x, [vocab[i] for i in x]), (y, pieces)

    return tokens


def groups_by_overlap(text, tokens):
    """Groups as connected components of overlapping tokens, by following every overlap."""
    (ids_a, bytes_a), (ids_b, bytes_b) = tokens(text)
    if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
        return []
    owner = defaultdict(list)
    for side, parts in enumerate((bytes_a, bytes_b)):
        at = 0
        for i, part in enumerate(parts):
            for x in range(at, at + len(part)):
                owner[x].append((side, i))
            at += len(part)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in owner.values():
        root[find(a)] = find(b)
    found = defaultdict(lambda: ([], []))
    for side, i in sorted({x for v in owner.values() for x in v}):
        found[find((side, i))][side].append(i)
    return [([ids_a[i] for i in x], [ids_b[i] for i in y]) for x, y in sorted(found.values())]


def texts():
    rng = random.Random(2)
    odd = ["", None, " ", "  ", "\n", "\n\n", " \n x", "x \ny", "x\n y", "a  b", "a\t b\n\nc \n", "end ", "end\n", "▁", "a▁b", "tab\tx", "\xa0 b", " " * 50, "\n" * 9 + "z"]
    odd += ["<s> </s> <|endoftext|> <0x41>", "日本語テキスト。　全角 ", "😀😀 x", "é̀", "\x00a", "\x1c b", "a\x85\nb", "\r\nwin\r\n\r\ntext", "ß" * 300, "don't I'll we've"]
    alphabet = "ab  \n\n.,éß日😀\t'1▁\xa0"
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    return odd + ["Étion dans, çouelle un éonierç le ch. " * 2000, "x" * 5000]


@pytest.mark.parametrize("heavy", [1 << 20, 40])
def test_alignment_equals_overlap_components(make, sides, monkeypatch, heavy):
    monkeypatch.setattr(token_alignment, "HEAVY", heavy)
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "twice"), (3, "twice"), (None, "no id")]
    found = [groups_by_overlap(t or "", sides) for _, t in rows]
    linked = [Counter((a, b) for x, y in g for a in x for b in y) for g in found]
    docs = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    wanted = []
    for (doc_id, _), g, c in zip(rows, found, linked, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        best = sum(n for p, n in c.items() if docs[p] == most[p[0]])
        wanted.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(n * docs[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    got = token_alignment.align(make(rows), tokenizer_file(A), tokenizer_file(B)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_wide_groups_are_multiplied(monkeypatch):
    rng = np.random.default_rng(0)
    g_a, g_b = np.sort(rng.integers(0, 20, 300)), np.sort(rng.integers(0, 20, 300))
    for g in (g_a, g_b):
        g[:20] = np.arange(20)
        g.sort()
    a, b, docs = rng.integers(0, 9, 300), rng.integers(0, 9, 300), np.arange(20) // 5
    plain = token_alignment.links(a, b, g_a, g_b, docs, 10)
    monkeypatch.setattr(token_alignment, "LISTED", 100)
    for x, y in zip(plain, token_alignment.links(a, b, g_a, g_b, docs, 10), strict=True):
        assert np.array_equal(x, y)


def test_no_documents(make):
    docs = make([(1, None)])
    assert token_alignment.align(docs.filter("doc_id > 1"), tokenizer_file(A), tokenizer_file(B)).count() == 0
    assert token_alignment.align(docs, tokenizer_file(A), tokenizer_file(B)).first().n_a == 0


def test_query_over_small_tables(spark, sides, tables):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, tables(documents=docs)).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        g = groups_by_overlap(text or "", sides)
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        assert got[doc_id].groups_sha256 == (hashlib.sha256(told.encode()).hexdigest() if g else "")
