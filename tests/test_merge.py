from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinfold.operators.components import connected_components
from kinfold.operators.matching import clusters
from kinfold.operators.survivorship import merge
from kinfold.plans.pipeline import canonical
from kinfold.schema import ORDERED_PROFILE
from kinfold.scratch import Scratch


def person(i, source="csv", **given):
    """A row as tests need it: a provenance entry only where there is a name."""
    row = {"candidate_id": f"c{i}", "full_name": None, "emails": [], "phones": [], "location": None, "links": None, "headline": None, "years_experience": None, "skills": [], "experience": [], "education": [], "overall_confidence": 0.5}
    row |= given
    row["provenance"] = [("full_name", source, "direct")] if row["full_name"] else []
    return tuple(row[f] if f != "ord" else i for f in ORDERED_PROFILE.names)


def merged(spark, *rows):
    return canonical(spark.createDataFrame(rows, ORDERED_PROFILE)).orderBy("ord").collect()


def groups(spark, *rows):
    df = clusters(spark.createDataFrame(rows, ORDERED_PROFILE), Scratch(spark, "t"))
    out = {}
    for r in df.collect():
        out.setdefault(r.label, []).append(r.ord)
    return sorted(sorted(v) for v in out.values())


def test_matching(spark):
    rows = [person(0, emails=["a@x"]), person(1, phones=["+1"]), person(2, emails=["a@x"], phones=["+2"]), person(3, phones=["+2", "+3"]), person(4, full_name="Same Name"), person(5, full_name="Same Name"), person(6, phones=["+3"], emails=[""]), person(7, emails=[""])]
    assert groups(spark, *rows) == [[0, 2, 3, 6], [1], [4], [5], [7]]


def test_components_like_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges + [(None, 3)], "u long, v long"), Scratch(spark, "cc"))
    wanted = {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert {r.node: r.label for r in got.collect()} == wanted
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "cc")).count() == 0


def test_scalar_winner(spark):
    (one,) = merged(spark, person(0, "csv", full_name="Low", emails=["e"], overall_confidence=0.4), person(1, "github", full_name="High", emails=["e"], overall_confidence=0.9, years_experience=0.0))
    assert one.full_name == "High" and one.candidate_id == "c0" and one.years_experience is None
    (tie,) = merged(spark, person(0, "github", full_name="G", emails=["e"]), person(1, "ats_json", full_name="A", emails=["e"]), person(2, "csv", full_name="C", emails=["e"]))
    assert tie.full_name == "A" and tie.candidate_id == "c1" and [(p.field, p.source) for p in tie.provenance][:2] == [("full_name", "ats_json"), ("emails", "github")]


def test_lists(spark):
    s = lambda n, c, src: (n, c, [src])
    e = lambda c, t, start=None, end=None, m=None: (c, t, start, end, m)
    (one,) = merged(
        spark,
        person(0, "csv", full_name="A", emails=["e", "f"], skills=[s("Go", 0.9, "csv"), s("Rust", 0.9, "csv")], experience=[e("Acme", "Dev"), e("", "")], links=("l1", None, None, ["o1"])),
        person(1, "ats_json", full_name="A", emails=["f", "g"], skills=[s("Go", 0.85, "ats_json"), s("AWS", 0.95, "ats_json")], experience=[e("acme ", "dev", "2020", None, "m"), e("Beta", "X")], links=("l2", "g2", None, ["o1", "o2"])),
    )
    assert one.emails == ["e", "f", "g"]
    assert [(x.name, x.confidence, x.sources) for x in one.skills] == [("AWS", 0.95, ["ats_json"]), ("Go", 0.9, ["csv", "ats_json"]), ("Rust", 0.9, ["csv"])]
    assert [(x.company, x.start) for x in one.experience] == [("acme ", "2020"), ("Beta", None)]
    assert one.links.asDict() == {"linkedin": "l1", "github": "g2", "portfolio": None, "other": ["o1", "o2"]}
    assert [p.source for p in one.provenance if p.field == "skills"] == ["ats_json", "csv"]
    assert [p.source for p in one.provenance if p.field == "links"] == ["csv", "ats_json"]


def test_location_backfill(spark):
    (one,) = merged(spark, person(0, emails=["e"], location=("X", None, None), overall_confidence=0.2), person(1, emails=["e"], location=("Y", "", "NO"), overall_confidence=0.8), person(2, emails=["e"], location=(None, "R", "SE")))
    assert one.location.asDict() == {"city": "Y", "region": "R", "country": "NO"}


def fold(entries):
    """The rules stated for one school in plain Python."""
    kept = []
    rich = lambda x: sum(map(bool, x[1:]))
    level = lambda x: (x[1] or "").lower().split()[0] if x[1] else ""
    for x in entries:
        if not level(x):
            at = max(range(len(kept)), key=lambda i: rich(kept[i]), default=None)
        else:
            at = next((i for i, k in enumerate(kept) if level(k) in (level(x), "")), None)
        if at is None:
            kept.append(x)
        elif rich(x) > rich(kept[at]):
            kept[at] = x
    return kept


def test_education_fold(spark):
    rng = random.Random(5)
    cases = [[("S", rng.choice([None, "BSc", "MSc Hons", "bsc x"]), rng.choice([None, "F"]), rng.choice([None, 2001])) for _ in range(rng.randint(2, 6))] for _ in range(80)]
    repeats = [("S", "btech", None, None), ("S", "mtech", None, None), ("S", None, "F", 2001), ("S", "mtech", "F", 2002), ("S", "btech", None, None)]
    cases += [repeats, repeats + repeats, [x for x in repeats for _ in range(3)]] + [[rng.choice(repeats) for _ in range(12)] for _ in range(60)]
    many = lambda: ("S", rng.choice([None, None, "a", "b", "c x", "d"]), rng.choice([None, "F", "G"]), rng.choice([None, 2001, 2002]))
    cases += [[many() for _ in range(rng.randint(2, 14))] for _ in range(60)]
    rows = [person(100 * i + j, emails=[f"e{i}"], education=[x]) for i, case in enumerate(cases) for j, x in enumerate(case)]
    got = merged(spark, *rows)
    assert [[tuple(x) for x in r.education] for r in got] == [fold(c) for c in cases]


def test_single_passes_through(spark):
    (one,) = merged(spark, person(0, full_name="A", skills=[("Go", 0.9, ["csv"]), ("Go", 0.9, ["csv"])], years_experience=0.0, overall_confidence=1.0))
    assert len(one.skills) == 2 and one.years_experience == 0.0 and one.overall_confidence == round(0.6 + 0.4 * 2 / 9, 3)
    (none,) = merged(spark, person(0, overall_confidence=1.0))
    assert none.overall_confidence == 0.0


def test_shuffled_keys_do_not_matter(spark):
    rows = [person(i, emails=[f"e{i}", f"e{i + 1}"]) for i in range(6)]
    turned = [person(i, emails=[f"e{i + 1}", f"e{i}"]) for i in range(6)]
    assert groups(spark, *rows) == groups(spark, *turned) == [list(range(6))]


def test_merge_keeps_one_row_per_label(spark):
    df = spark.createDataFrame([person(i, emails=["hot"]) for i in range(200)] + [person(500)], ORDERED_PROFILE)
    out = merge(clusters(df, Scratch(spark, "t")))
    assert out.count() == 2 and out.agg(F.countDistinct("ord")).first()[0] == 2
