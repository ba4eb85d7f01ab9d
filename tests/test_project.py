from __future__ import annotations

import json

import pytest

from kinfold.operators.project import compile_config, project
from kinfold.plans import config as configs
from kinfold.plans import pipeline
from kinfold.schema import ORDERED_PROFILE
from kinfold.sources.inputs import Input

FULL = ("c1", "Ann Lee", ["a@b.co", "x@y.zz"], ["98765 43210"], ("Oslo", None, "Norway"), ("l", None, None, []), "dev", 2.0, [("Vue.js", 0.9, ["csv"])], [("E", "T", "2020", None, None)], [], [("full_name", "csv", "direct")], 0.9, 0)
BARE = ("c2", None, [], [], None, None, None, None, [], [], [], [], 0.0, 1)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([FULL, BARE], ORDERED_PROFILE)


def shaped(people, fields, **more):
    config = {"fields": fields} | more
    return pipeline.to_dicts(project(people, config).orderBy("ord").collect(), config)


def test_presets(people):
    default, custom = (json.loads(pipeline.to_json(project(people, configs.PRESETS[n]), configs.PRESETS[n])) for n in ("default", "custom"))
    assert len(default) == 2 and len(custom) == 1 and custom[0] == {"full_name": "Ann Lee", "primary_email": "a@b.co", "phone": "+919876543210", "skills": ["Vue.Js"], "overall_confidence": 0.9}
    assert default[0]["years_experience"] == 2 and default[0]["location"] == {"city": "Oslo", "region": None, "country": "NO"} and default[1]["emails"] is None


def test_paths(people):
    got = shaped(people, [{"path": "second", "from": "emails[1]"}, {"path": "third", "from": "emails[2]"}, {"path": "n", "from": "skills[].nothing"}, {"path": "s", "from": "skills[0].name"}, {"path": "bad", "from": "no.where"}, {"path": "flat", "from": "full_name.x"}])
    assert got[0] == {"second": "x@y.zz", "third": None, "n": None, "s": "Vue.js", "bad": None, "flat": None}


def test_types(people):
    got = shaped(people, [{"path": "a", "from": "full_name", "type": "string[]"}, {"path": "b", "from": "emails", "type": "string"}, {"path": "c", "from": "years_experience", "type": "boolean"}, {"path": "d", "from": "headline", "type": "number"}, {"path": "e", "from": "years_experience", "type": "string"}])
    assert got[0] == {"a": ["Ann Lee"], "b": "a@b.co", "c": True, "d": None, "e": "2.0"}


def test_missing(people):
    fields = [{"path": "who.name", "from": "full_name"}, {"path": "id", "from": "candidate_id"}]
    assert shaped(people, fields, on_missing="omit")[1] == {"id": "c2"}
    assert len(shaped(people, fields, on_missing="error")) == 1
    assert len(shaped(people, [fields[0] | {"required": True}])) == 1


def test_validation():
    assert configs.problems([]) == ["config must be a JSON object"]
    assert len(configs.problems({"fields": [3, {"path": ""}, {"path": "a", "type": "list"}, {"path": "a", "normalize": "x"}], "on_missing": "drop"})) == 6
    assert configs.problems(configs.PRESETS["default"]) == []
    with pytest.raises(configs.ConfigError):
        configs.load("nowhere.json")


def test_conflicting_paths_are_refused():
    for fields in ([{"path": "location"}, {"path": "location.city"}], [{"path": "location.city"}, {"path": "location"}]):
        with pytest.raises(configs.ConfigError):
            compile_config({"fields": fields})


def test_end_to_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,email,phone,skills\nann lee,ann@x.org,9876543210,js\nbo,,,\n")
    (tmp_path / "b.json").write_text(json.dumps({"candidates": [{"name": "Ann M Lee", "email": "ANN@x.org", "headline": "dev", "skills": ["aws"]}, {"name": "Cy", "phone": "+1 415 555 0100"}]}))
    records, extracted = pipeline.run(spark, [Input(str(tmp_path / "a.csv")), Input(str(tmp_path / "b.json")), Input("x.txt")], configs.PRESETS["default"])
    got = pipeline.to_dicts(records.orderBy("ord").collect(), configs.PRESETS["default"])
    assert [r["full_name"] for r in got] == ["Ann Lee", "Bo", "Cy"] and got[0]["skills"] == ["JavaScript", "AWS"] and got[0]["headline"] == "dev"
    assert [p for p, _ in extracted.skipped] == ["x.txt"]
    reply = pipeline.envelope(records, extracted, configs.PRESETS["default"], "default")
    assert (reply["count"], reply["config_used"], reply["skipped_files"][0]["file"]) == (3, "default", "x.txt")
