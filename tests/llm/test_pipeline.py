"""The pipeline against a plain-Python statement of what each stage keeps."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import packing


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def place(spark, tables):
    rng = random.Random(12)
    word = lambda: rng.choice(["sea", "wind", "old", "ship", "far", "we", "sang"]) + str(rng.randrange(60))
    rows, labels = [], []
    for i in range(400):
        text = " ".join(word() for _ in range(rng.randint(30, 90)))
        toxic = i % 8 == 0
        rows.append((i, text.replace(" ", " moron scum ", 1) if toxic else text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(400, 480):  # copies, and near copies, of clean rows
        text = rows[1 + 8 * (i % 40)][1]
        rows.append((i, text if i % 2 else text + " tail", "en", "s1", 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (None, "null id of five words here", None, "s2", None), (902, "very " * 30_000, "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return tables(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def staged(spark, place, tmp_path):
    docs, out = spark.read.parquet(f"{place}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, place).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        out.append((docs, after))
        docs = after
    return out


def test_stages(spark, place, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    steps = staged(spark, place, tmp_path)
    assert all(before.columns == after.columns for before, after in steps[:-1])
    rows = [[(r.doc_id, r.text, r.source) for r in after.collect()] for _, after in steps[:-1]]
    first = {(r.doc_id, r.text, r.source) for r in steps[0][0].collect()}

    clean, text_kept, near_kept, mixed = rows
    assert set(clean) == {r for r in first if "moron" not in (r[1] or "")}

    best = defaultdict(list)
    for r in clean:
        best[r[1] or ""].append(r)
    wanted = {max(rs, key=lambda r: -1 if r[0] is None else r[0]) for rs in best.values()}
    assert Counter(text_kept) == Counter(wanted)

    sets = {r: shingles(r[1]) for r in text_kept}
    group = {r: r for r in text_kept}

    def find(r):
        while group[r] != r:
            r = group[r]
        return r

    for a in text_kept:
        for b in text_kept:
            both = len(sets[a] & sets[b])
            if a != b and both and both / len(sets[a] | sets[b]) >= 0.8:
                group[find(a)] = find(b)
    classes = defaultdict(list)
    for r in text_kept:
        classes[find(r)].append(r)
    assert Counter(near_kept) == Counter(min(rs, key=lambda r: (r[0] is None, r[0] or 0)) for rs in classes.values())

    assert set(mixed) <= set(near_kept) and max(Counter(mixed).values()) <= 3

    pieces = steps[-1][1].collect()
    from tokenizers import Tokenizer

    from kinfold.llm.queries import tokenizer_file

    exact = Tokenizer.from_file(tokenizer_file())
    total = sum(len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in mixed)
    assert sum(r.length for r in pieces) == total
    held = defaultdict(int)
    for r in pieces:
        held[r.sequence_id] += r.length
    assert all(n == packing.CAPACITY or n & (n - 1) == 0 for n in held.values())


def test_run_is_the_stages_one_after_the_other(spark, place, tmp_path):
    wanted = staged(spark, place, tmp_path)[-1][1]
    got = corpus_pipeline.run(spark, place)
    total = lambda df: df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).orderBy("doc_id", "doc_tokens").collect()
    assert total(got) == total(wanted) and got.columns == wanted.columns


def test_empty_and_null_tables(spark, tables):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, tables(documents=spark.createDataFrame([], kind), labels=labels)).count() == 0
    nulls = [(None,) * 5, (1, None, None, None, None)]
    place = tables(documents=spark.createDataFrame(nulls, kind), labels=labels)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, spark.read.parquet(f"{place}/documents.parquet"), place).count()
        assert found == {"exact dedup": 1, "mixing": 0}.get(name, 2), name
