from __future__ import annotations

import json

import pytest

from kinfold import cli
from kinfold.plans import config as configs
from kinfold.plans import pipeline
from kinfold.sources.inputs import Input

TEAM = "name,email,years\nAnn Lee,a@x.org,3\n,,\nBo Li,,\nCy Lo,c@x.org,x,surplus\n"


def test_configurations_are_loaded(tmp_path):
    assert configs.load("default") == configs.PRESETS["default"]
    own = {"fields": [{"path": "name", "from": "full_name"}]}
    (tmp_path / "own.json").write_text(json.dumps(own))
    assert configs.load(str(tmp_path / "own.json")) == own
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "wrong.json").write_text('{"fields": []}')
    for name in ("bad.json", "wrong.json", "missing.json"):
        with pytest.raises(configs.ConfigError):
            configs.load(str(tmp_path / name))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "team.csv").write_text(TEAM)
    assert cli.main([str(tmp_path / "team.csv"), "--config", str(tmp_path / "none.json")]) == 2
    assert cli.main([str(tmp_path / "team.csv"), "notes.txt", "--config", "custom", "--output", str(tmp_path / "out.json")]) == 0
    said = capsys.readouterr().err
    assert "skipped notes.txt: unknown kind" in said and "left out of the inputs: 1 (no known value)" in said and "left out of the inputs: 1 (more cells than the header)" in said
    assert "records left out: 1 (required field 'primary_email' is missing)" in said
    (record,) = json.loads((tmp_path / "out.json").read_text())
    assert record["full_name"] == "Ann Lee" and record["primary_email"] == "a@x.org"


def test_a_configuration_of_ones_own(spark, tmp_path):
    (tmp_path / "team.csv").write_text(TEAM)
    config = {"fields": [{"path": "who.name", "from": "full_name", "required": True}, {"path": "since", "from": "years_experience", "type": "boolean"}, {"path": "place", "from": "location", "type": "object"}, {"path": "all", "from": "links", "type": "string"}], "on_missing": "omit"}
    records, found = pipeline.run(spark, [Input(str(tmp_path / "team.csv"))], config)
    assert [pipeline.to_dicts([r], config)[0] for r in records.orderBy("ord").collect()] == [{"who": {"name": "Ann Lee"}, "since": True}, {"who": {"name": "Bo Li"}}]
    with pytest.raises(configs.ConfigError):
        pipeline.run(spark, [], {"fields": [{"path": ""}]})
