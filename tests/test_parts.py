"""Readers of large files in parts: the same rows at any number of parts as a reader of whole files finds."""

from __future__ import annotations

import csv
import io
import json
import os
import random

import pytest

from kinfold.scratch import Scratch
from kinfold.sources import ats_json, csv_parts, json_parts
from kinfold.sources.inputs import Input, read_all


@pytest.fixture
def split_at(spark):
    """Sets the bytes of a split, and what opening a file counts as."""
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None}
    before = {n: spark.conf.get(n) for n in names}

    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    for n, v in before.items():
        spark.conf.set(n, v)


def whole(text):
    """What a reader of whole exports finds: a list, the first wrapped list, or one object; else why not."""
    try:
        found = json.loads(text.removeprefix("﻿"))
    except ValueError:
        return json_parts.INVALID
    if isinstance(found, dict):
        return next((found[k] for k in ats_json.WRAPPERS if isinstance(found.get(k), list)), [found])
    return found if isinstance(found, list) else "neither a list nor an object"


RECORDS = [{"a": i, "t": 'x } ] , { "q" \\\\ "' * (i % 5), "l": [1, {"z": [i]}]} for i in range(30)]
EXPORTS = {
    "indented": json.dumps(RECORDS, indent=2),
    "wrapped": "﻿" + json.dumps({"meta": {"x": "]", "y": [2, 3]}, "candidates": RECORDS, "k": 5}) + "\n",
    "lines": "[\n" + ",\n".join(map(json.dumps, RECORDS)) + "\n]\n",
    "single": json.dumps(RECORDS[3], indent=1),
    "empty list": " [ ] ",
    "empty object": "{}",
    "no bytes": "",
    "blank": "\n",
    "number": "3",
    "broken": "{bad",
    "open": "[1,2",
    "open text": '[{"a": "b}]',
    "two commas": "[1,,2]",
    "comma at the end": '{"a":1,"candidates":[1,2],}',
    "closed twice": "[]]",
    "other bracket": '[{"a":1}}',
    "other bracket in a member": '{"candidates":[{}}',
    "text after": "[1] x",
    "text before": "x [1]",
    "bad member": '{"a":{1},"candidates":[1,2]}',
    "no colon": '{"data" [1]}',
    "no comma": '[{"a":1}{"b":2}]',
    "JSON lines": '{"a":1}\n{"a":2}\n',
    "empty wrapped": '{"a":"]","results":\n[\n]\n}\n',
    "first wrapper": '{"data":[{}],"applicants":[{"id":1},{"id":2},4]}',
    "repeated names": '{"candidates":[{}],"candidates":3}',
    "repeated lists": '{"candidates":[{}],"b":[[1],2],"candidates":[5]}',
    "escaped name": '{"d\\u0061ta":[1]}',
}


@pytest.mark.parametrize("size", [2000, 1 << 20])
def test_exports_in_parts(spark, split_at, tmp_path, size):
    for name, text in EXPORTS.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    split_at(size)
    records, bad = json_parts.records(spark, str(tmp_path), Scratch(spark, "test"), ats_json.WRAPPERS)
    name_of = lambda file: os.path.basename(file).replace("%20", " ").removesuffix(".json")
    found = {}
    for file, pos, v in records.selectExpr("__file", "pos", "to_json(v)").collect():
        found.setdefault(name_of(file), []).append((pos, json.loads(v) if v else None))
    reasons = {name_of(r[0]): r[1] for r in bad.collect()}
    for name, text in EXPORTS.items():
        wanted = whole(text)
        assert reasons.get(name) == (wanted if isinstance(wanted, str) else None), name
        assert sorted(found.get(name, []), key=lambda x: x[0]) == ([] if isinstance(wanted, str) else list(enumerate(wanted))), name


def test_effects_compose():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice('{}[]",:a1\\\\ ') for _ in range(rng.randrange(60)))
        cut = rng.randrange(len(text) + 1)
        while cut and text[cut - 1] == "\\":
            cut -= 1
        one, two, both = (json_parts.Effect.of(np.frombuffer(t.encode(), np.uint8)) for t in (text[:cut], text[cut:], text))
        assert one.then(two) == both


def table(rng):
    cells = ["a", "b c", "", "é", 'x"y', '"open\nline', 'multi\n\nline "q", x', "\n", '5" disk, y', ",", '""']
    rows = []
    for _ in range(40):
        row = [rng.choice(cells) for _ in range(rng.randrange(0, 5))]
        rows.append(",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in ",\n") or v.startswith('"') or rng.random() < 0.2 else v for v in row))
    return rng.choice(["", "﻿"]) + rng.choice(["\n", "\r\n"]).join(rows) + rng.choice(["", "\n", '\n"never closed, x\ny'])


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_delimited_files_in_parts(spark, split_at, tmp_path, size):
    rng = random.Random(3)
    tables = {f"{i}.csv": table(rng) for i in range(3)}
    for name, text in tables.items():
        (tmp_path / name).write_bytes(text.encode())
    split_at(size)
    found = {}
    for file, n, cells in csv_parts.rows(spark, str(tmp_path), Scratch(spark, "test")).select("__file", "n", "cells").collect():
        found.setdefault(os.path.basename(file), {})[n] = cells
    for name, text in tables.items():
        wanted = [row for row in csv.reader(io.StringIO(text.removeprefix("﻿").replace("\r\n", "\n"))) if row]
        got = [found[name][i] for i in range(len(wanted))]
        assert [[c.rstrip("\n") for c in r] for r in got] == [[c.rstrip("\n") for c in r] for r in wanted] and len(found[name]) == len(wanted)


def test_what_is_left_out_is_told(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,email\nAnn Lee,a@x.org\n,\nBo Li,b@x.org,surplus\n")
    (tmp_path / "one.json").write_text(json.dumps({"applicants": [{"name": "Cy Lo"}, 5, "x"]}, indent=2))
    (tmp_path / "lines.json").write_text('{"name":"no"}\n{"name":"no"}\n')
    (tmp_path / "p.jsonl").write_text('{"username": "gone"}\n')
    (tmp_path / "cv.docx").write_bytes(b"junk")
    items = [Input(str(tmp_path / n), k) for n, k in (("t.csv", "csv"), ("one.json", "ats_json"), ("lines.json", "ats_json"), ("p.jsonl", "github"), ("cv.docx", "resume"))]
    found = read_all(spark, items, 2024)
    assert [r.full_name for r in found.profiles.orderBy("ord").collect()] == ["Ann Lee", "Cy Lo"]
    told = sorted((r.input, r.pos, r.reason) for r in found.rejects.filter("pos IS NOT NULL").collect())
    assert [(i, p, r) for i, p, r in told if i != 3] == [(0, 1, "no known value"), (0, 2, "more cells than the header"), (1, 1, "item is no object"), (1, 2, "item is no object")]
    assert [r for i, _, r in told if i == 3] == ["no user"]
    assert [(os.path.basename(p), r.split(":")[0]) for p, r in found.skipped] == [("lines.json", "no valid JSON"), ("cv.docx", "no readable text")]
