from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinfold.functions import normalize, text

CASES = {
    normalize.phone: [
        ("98765 43210", "+919876543210"), ("+1 (415) 555-0100", "+14155550100"), ("14155550100", "+14155550100"), ("12345", None), ("+12", None),
        ("call me", None), ("+919876543210", "+919876543210"), ("00447911123456", "+00447911123456"), ("", None), (None, None), ("1234567890123456", None),
    ],
    normalize.date: [
        ("2020-3", "2020-03"), ("03/2020", "2020-03"), ("Mar 2020", "2020-03"), ("march, 2020", "2020-03"), ("2020 Sep", "2020-09"), ("2020", "2020"), ("Present", None),
        ("—", None), ("Sept 2020", None), ("2020-13", "2020-13"), ("2024-07-01", None), (" 2019.11 ", "2019-11"), ("", None), (None, None),
    ],
    normalize.skill: [("JS", "JavaScript"), (" k8s ", "Kubernetes"), ("rust", "Rust"), ("sklearn", "scikit-learn"), ("o'brien tool", "O'Brien Tool"), (None, ""), ("3d modelling", "3D Modelling")],
    normalize.country: [("India", "IN"), ("uk", "GB"), ("de", "DE"), ("Remote", None), ("Atlantis", None), (" USA ", "US"), ("", None), (None, None)],
    normalize.email: [(" A@B.Com ", "a@b.com"), ("a@b", None), ("plain", None), ("x@y@z.org", "x@y@z.org"), (None, None)],
    normalize.name: [("  ada   LOVELACE ", "Ada Lovelace"), ("x", None), ("", None), ("mary-jane o'neil", "Mary-Jane O'Neil"), (None, None)],
    normalize.years: [("5 years", 5.0), ("about 3.5", 3.5), ("none", None), (None, None)],
    text.strip: [("\t a b  \x1c", "a b"), (None, None)],
}


@pytest.mark.parametrize("fn", list(CASES), ids=lambda f: f.__name__)
def test_scalar(spark, fn):
    rows = [(i, given, wanted) for i, (given, wanted) in enumerate(CASES[fn])]
    kind = "double" if fn is normalize.years else "string"
    got = spark.createDataFrame(rows, f"i int, given string, wanted {kind}").select("given", "wanted", fn(F.col("given")).alias("got")).collect()
    assert [(r.given, r.got) for r in got] == [(r.given, r.wanted) for r in got]


def test_lists(spark):
    df = spark.createDataFrame([("a; b,c ;d",), ("x|y",), ("one",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.split_list(F.col("s"))).collect()] == [["a; b", "c ;d"], ["x", "y"], ["one"], [], []]
    got = spark.createDataFrame([(["js", "JavaScript", "go lang", " "],)], "s array<string>").select(normalize.skills(F.col("s"))).first()[0]
    assert got == ["JavaScript", "Go"]


def test_phone_is_idempotent(spark):
    df = spark.createDataFrame([("9876543210",), ("+44 7911 123456",)], "s string").select(normalize.phone(F.col("s")).alias("p"))
    assert all(r[0] == r[1] for r in df.select("p", normalize.phone(F.col("p"))).collect())


def test_sql_functions_equal_the_column_functions(spark):
    import random

    from kinfold.functions import sql, text

    rng = random.Random(4)
    odd = ["", " ", None, "-", "Present", "2020-13", "Mar 2020", "2020, march", "Maybe 2020", "+91 98", "++123456789", "1 415 555 0000", "ß straße", "o'brien-smith 3d", "\u2003x\u2003", "\x1c a \x1f", "a@b@c.d", "A@B", "remote", "IN", "xy", "js; go|c", "a,b;c", "12.5.3 years", "K8S", "vue.js"]
    texts = odd + ["".join(rng.choice("aZß é1 2+-./,;|@'\t") for _ in range(rng.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    sql.register(spark)
    columns = {
        "py_strip": text.strip, "py_title": text.title, "normalize_phone": normalize.phone, "normalize_date": normalize.date, "normalize_skill": normalize.skill, "normalize_country": normalize.country,
        "normalize_email": normalize.email, "normalize_name": normalize.name, "parse_years": normalize.years, "split_skills": text.split_list,
    }
    assert set(columns) == set(sql.definitions())
    df.createOrReplaceTempView("texts")
    for name, fn in columns.items():
        wanted = df.select("raw", fn(df["raw"]).alias("v")).collect()
        assert spark.sql(f"SELECT raw, {name}(raw) AS v FROM texts").collect() == wanted, name
    assert spark.sql("SELECT normalize_phone('9811023456', '44')").first()[0] == "+449811023456"
