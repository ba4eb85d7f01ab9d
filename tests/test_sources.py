from __future__ import annotations

import base64
import io
import json
import zipfile

from pyspark.sql import functions as F

from kinfold.operators.project import project
from kinfold.operators.project import records as project_records
from kinfold.plans import config as configs
from kinfold.plans import pipeline
from kinfold.plans.pipeline import canonical
from kinfold.sources import ats_json, csv, github, github_live, resume
from kinfold.sources.inputs import Input, detect, read_all


def by_id(df):
    return {r.candidate_id: r for r in df.collect()}


def test_detect_and_parse():
    assert [detect(p) for p in ("a.CSV", "b.json", "https://github.com/x", "c.pdf", "d.docx", "e.txt", "f")] == ["csv", "ats_json", "github", "resume", "resume", None, None]
    assert Input.parse("x.txt:csv") == Input("x.txt", "csv")
    assert Input.parse("https://github.com/abc").path == "https://github.com/abc"


def test_csv(spark, tmp_path):
    path = tmp_path / "team.csv"
    path.write_bytes(
        "﻿Name,E-mail,email address,Phone,Company,Location,skills,years,notes,id\n"
        'ada lovelace,no@use.org,ADA@x.org,98765 43210,Engines,"London, England",maths;js,5 years,,\n'
        "\n"
        'short,,s@x.org\n'
        "surplus,,t@x.org,,,,,,,,extra\n"
        ",,,,,,,,,k7\n"
        '"two\nlines",,,,,"Pune, MH, India","a, b",,"said ""hi""",\n'
        ",,,,,,,,,\n".encode()
    )
    got = by_id(csv.read(spark, str(path)))
    assert set(got) == {"team_row0", "team_row1", "k7", "team_row4"}
    ada = got["team_row0"]
    assert (ada.full_name, ada.emails, ada.phones, ada.years_experience) == ("Ada Lovelace", ["ada@x.org"], ["+919876543210"], 5.0)
    assert ada.location.asDict() == {"city": "London", "region": None, "country": "GB"}
    assert [s.name for s in ada.skills] == ["Maths", "JavaScript"] and ada.skills[0].confidence == 0.9
    assert ada.experience[0].company == "Engines" and ada.experience[0].title == "" and ada.overall_confidence == 1.0
    assert got["k7"].provenance == [] and got["k7"].overall_confidence == 0.0
    two = got["team_row4"]
    assert two.full_name == "Two Lines" and two.headline == 'said "hi"' and [(p.field, p.method) for p in two.provenance][-2:] == [("headline", "inferred"), ("skills", "normalized")]
    assert two.location.asDict() == {"city": "Pune", "region": "MH", "country": "IN"}


def records_of(spark, data, stem="x"):
    texts = spark.createDataFrame([(data if isinstance(data, str) else json.dumps(data), f"/in/{stem}.json")], "value string, __file string")
    return ats_json.profiles(ats_json.records(texts)).collect()


def test_ats_shapes(spark):
    one = {"firstName": "Ann", "lastName": "Lee", "email": ["A@b.co", "a@B.co", "bad"], "phone": 9811023456, "skills": "js, go lang"}
    assert len(records_of(spark, [one, "skip", one])) == 2
    assert [r.candidate_id for r in records_of(spark, [one, 3, one])] == ["x_ats_0", "x_ats_2"]
    assert [len(records_of(spark, {key: [one]})) for key in ats_json.WRAPPERS] == [1] * 5
    assert records_of(spark, "3") == [] and records_of(spark, "{bad") == []
    got = records_of(spark, "﻿" + json.dumps(one))[0]
    assert (got.full_name, got.emails, got.phones, [s.name for s in got.skills]) == ("Ann Lee", ["a@b.co"], ["+919811023456"], ["JavaScript", "Go"])


def test_ats_record(spark):
    got = records_of(
        spark,
        {
            "applicant": {"fullName": "bo li", "yearsOfExperience": "7", "location": {"city": "Oslo", "country": "Norway"}, "skills": [{"label": "aws"}, "", {"name": ""}, 5, "py"]},
            "applicantId": 12,
            "workHistory": [{"employer": "E", "role": "R", "from": "Jan 2020", "to": "present"}, {"description": "none"}, "x"],
            "education": [{"school": "S", "degree": "BSc", "major": "M", "graduationYear": "2019-05"}, {"degree": "no school"}],
            "linkedinUrl": " in/bo ",
        },
    )[0]
    assert got.candidate_id == "12" and got.years_experience == 7.0 and [s.name for s in got.skills] == ["AWS", "Python"]
    assert [e.asDict() for e in got.experience] == [{"company": "E", "title": "R", "start": "2020-01", "end": None, "summary": None}]
    assert [e.asDict() for e in got.education] == [{"institution": "S", "degree": "BSc", "field": "M", "end_year": 2019}]
    assert got.location.country == "NO" and got.links.linkedin == "in/bo"
    assert records_of(spark, {"yearsOfExperience": "5d", "name": "Al Bo"})[0].years_experience is None


def test_github(spark, tmp_path):
    readme = "`Python` `a/b` `123` ![Docker](https://img.shields.io/badge/Docker-blue) shields.io/badge/Vue-3776AB `4fc08d`"
    payload = {
        "username": "ann",
        "user": {"name": "ann lee", "email": " A@b.co", "bio": "dev", "blog": "ann.dev", "location": "Oslo", "company": "@corp", "html_url": ""},
        "repos": [{"fork": True, "language": "C"}, {"language": "js"}, {"language": "JavaScript"}, {"language": "Go"}, {"language": "Go"}],
        "social_accounts": [{"provider": "x", "url": "https://x.com/a"}, {"provider": "linkedin", "url": " https://linkedin.com/in/ann "}],
        "readme": {"encoding": "base64", "content": base64.b64encode(readme.encode()).decode()},
    }
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps(payload) + "\n" + json.dumps({"username": "gone"}) + "\n")
    (got,) = github.read(spark, str(path)).collect()
    assert (got.candidate_id, got.full_name, got.emails, got.headline) == ("github_ann", "Ann Lee", ["a@b.co"], "dev")
    assert got.links.asDict() == {"linkedin": "https://linkedin.com/in/ann", "github": "https://github.com/ann", "portfolio": "https://ann.dev", "other": []}
    assert [(s.name, s.confidence) for s in got.skills] == [("Go", 0.72), ("JavaScript", 0.61), ("Python", 0.8), ("Docker", 0.8), ("Docker Blue", 0.8), ("Vue 3776Ab", 0.8)]
    assert got.experience[0].company == "corp" and got.overall_confidence == 1.0
    names = spark.createDataFrame([("https://github.com/ann/",), ("bob",), ("not a name",)], "username string")
    assert sorted(r[0] for r in names.select(github.username(F.col("username"))).collect() if r[0]) == ["ann", "bob"]


class FakeServer:
    """Answers as an API of profiles does: failures first, limits, unknown users."""

    def __init__(self):
        import http.server
        import threading

        calls = self.calls = []
        seen = {}
        user = {"name": "ann lee", "email": "A@b.co"}

        class Handler(http.server.BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                calls.append(self.path)
                n = seen[self.path] = seen.get(self.path, 0) + 1
                name = self.path.split("/")[2].split("?")[0]
                status, body, headers = 200, None, {}
                if name == "gone":
                    status = 404
                elif name == "limited":
                    status, headers = 403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "99999999999"}
                elif name == "busy" and n == 1:
                    status = 503
                elif name == "soon" and n == 1:
                    status, headers = 429, {"Retry-After": "0"}
                elif name == "down":
                    status = 500
                elif "repos?" in self.path:
                    body = [{"language": "Go"}] if name != "odd" else "oops"
                elif "social" in self.path:
                    status = 403
                elif "readme" in self.path:
                    status = 404
                else:
                    body = user
                data = (body if isinstance(body, str) else json.dumps(body)).encode()
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"


def test_live_profiles(spark):
    server = FakeServer()
    try:
        rows = {r.username: r for r in github.live(spark, ["ann", "busy", "soon", "odd", "gone", "down"], base=server.base, pause=0.01, partitions=3).collect()}
        assert {n: r.problem for n, r in rows.items()} == {"ann": None, "busy": None, "soon": None, "odd": None, "gone": github_live.UNKNOWN, "down": github_live.FAILED}
        assert rows["odd"].repos is None and json.loads(rows["busy"].repos) == [{"language": "Go"}] and rows["ann"].social_accounts is None
        assert "/users/ann/repos?per_page=100&sort=updated" in server.calls and not any("page=2" in c for c in server.calls)  # one page of 100
        assert server.calls.count("/users/down") == 3 and server.calls.count("/users/gone") == 1 and not any("gone/repos" in c for c in server.calls)
        # one partition: after a refusal the others are not called
        rows = {r.username: r.problem for r in github.live(spark, ["limited", "zoe"], base=server.base, partitions=1).collect()}
        assert rows == {"limited": github_live.REFUSED, "zoe": github_live.REFUSED} and "/users/zoe" not in server.calls
        names = spark.createDataFrame([("https://github.com/ann/",), ("gone",), ("no name",)], "username string")
        fetched = {r.username: r for r in github.fetch(names, client=github_live.Client(server.base, pause=0.01)).collect()}
        assert fetched["ann"].user.name == "ann lee" and fetched["gone"].problem == github_live.UNKNOWN and len(fetched) == 2
    finally:
        server.server.shutdown()


RESUME = """Rohan Mehta
Senior Backend Engineer
rohan@example.org | +91 98110 23456 | linkedin.com/in/rohan-m | github.com/rohanm

Summary
Builds things. Likes tea.

Work Experience:
Engineer at Acme
Jan 2018 - Present
Did work
More work

Intern - Beta Corp, 2016 - 2017

Education
IIT Delhi
B.Tech in CS, 2016

Skills
• Python, K8s, Go lang
"""


def test_resume(spark):
    docs = spark.createDataFrame([(n, t, (n, 0, 0)) for n, t in (("r", RESUME), ("blank", " \n"), ("none", "123 456"))], "stem string, text string, at struct<file:string,start:long,pos:long>")
    (got,) = resume.profiles(docs, 2024).collect()
    assert (got.candidate_id, got.full_name, got.headline, got.emails, got.phones) == ("resume_r", "Rohan Mehta", "Senior Backend Engineer", ["rohan@example.org"], ["+919811023456"])
    assert got.links.github == "https://github.com/rohanm" and got.years_experience == 8.0
    assert [e.asDict() for e in got.experience] == [
        {"company": "Acme", "title": "Engineer", "start": "2018-01", "end": None, "summary": "Did work More work"},
        {"company": "Beta Corp", "title": "Intern", "start": "2016", "end": "2017", "summary": None},
    ]
    assert [e.asDict() for e in got.education] == [{"institution": "IIT Delhi", "degree": "B.Tech", "field": "CS", "end_year": 2016}]
    assert [s.name for s in got.skills] == ["Python", "Kubernetes", "Go"] and got.overall_confidence == 1.0


def docx(lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_docx_and_inputs(spark, tmp_path):
    assert resume.docx_text(docx(["a", "b"])) == "a\nb\ncell" and resume.text_of("x.docx", b"junk") is None
    (tmp_path / "cv one.docx").write_bytes(docx(RESUME.splitlines()))
    (tmp_path / "t.csv").write_text("name,email\nZed Zed,z@z.org\n")
    found = read_all(spark, [Input(str(tmp_path / "cv one.docx")), Input("notes.txt"), Input(str(tmp_path / "missing.csv")), Input(str(tmp_path / "t.csv"))], 2024)
    rows = found.profiles.orderBy("ord").collect()
    assert [r.candidate_id for r in rows] == ["resume_cv one", "t_row0"] and [p for p, _ in found.skipped] == ["notes.txt", str(tmp_path / "missing.csv")]


def test_folders_keep_people_apart(spark, tmp_path):
    for kind in ("csv", "json"):
        (tmp_path / kind).mkdir()
    for i in range(4):
        (tmp_path / "csv" / f"t{i}.csv").write_text(f"name,email\nAnn {'abcd'[i]},a{i}@x.org\n,\nBo {'abcd'[i]},b{i}@x.org\n")
        (tmp_path / "json" / f"e{i}.json").write_text(json.dumps([{"name": f"Cy {'abcd'[i]}", "email": f"c{i}@x.org"}, "x", {"name": f"Di {'abcd'[i]}", "email": f"a{i}@x.org"}]))
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"username": f"u{i}", "user": {"name": f"Ed {'abcd'[i]}"}}) + "\n" for i in range(4)))
    found = read_all(spark, [Input(str(tmp_path / "json"), "ats_json"), Input(str(tmp_path / "csv"), "csv"), Input(str(tmp_path / "p.jsonl"), "github")])
    rows = found.profiles.orderBy("ord").collect()
    assert len({r.ord for r in rows}) == len(rows) == 20 and not found.skipped
    assert [r.candidate_id for r in rows] == [f"e{i}_ats_{j}" for i in range(4) for j in (0, 2)] + [f"t{i}_row{j}" for i in range(4) for j in (0, 2)] + [f"github_u{i}" for i in range(4)]
    merged = canonical(found.profiles).orderBy("ord").collect()
    assert [r.emails for r in merged] == [[e] for i in range(4) for e in (f"c{i}@x.org", f"a{i}@x.org")] + [[f"b{i}@x.org"] for i in range(4)] + [[]] * 4


def test_headers_that_differ_in_a_folder_are_named(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("name,email\nAnn Lee,a@x.org\n")
    (tmp_path / "csv" / "b.csv").write_text("email,name\nb@x.org,Bo Li\n")
    (tmp_path / "ok.csv").write_text("name\nCy Lo\n")
    found = read_all(spark, [Input(str(tmp_path / "csv"), "csv"), Input(str(tmp_path / "ok.csv"))])
    assert [r.full_name for r in found.profiles.collect()] == ["Cy Lo"] and [p for p, _ in found.skipped] == [str(tmp_path / "csv")]


def test_bad_documents_add_nothing(spark, tmp_path):
    good = docx(RESUME.splitlines())
    bodiless = io.BytesIO()
    with zipfile.ZipFile(bodiless, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'/>")
    locked = bytearray(good)
    locked[locked.index(b"PK\x01\x02") + 8] |= 1  # says it is encrypted
    for name, content in {"good.docx": good, "cut.docx": good[:200], "bodiless.docx": bodiless.getvalue(), "locked.docx": bytes(locked), "junk.pdf": b"%PDF-1.4 junk", "empty.docx": b""}.items():
        (tmp_path / name).write_bytes(content)
    found = read_all(spark, [Input(str(tmp_path), "resume")], 2024)
    assert [r.candidate_id for r in found.profiles.collect()] == ["resume_good"]


def test_lines_end_as_in_python(spark):
    text = "a\x1cb\x1dc\x1ed\x85e\u2028f\u2029g\r\nh\ri\x0bj\x0ck\nl m"
    (got,) = spark.createDataFrame([(text,)], "t string").select(resume.lines(F.col("t"))).first()
    assert got == text.splitlines()


def test_json_of_the_sink(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,email,years,location\n"Ann ""A"" Lee",a@x.org,3,"Oslo, Norway"\nbo li,,2.5,\n')
    found = read_all(spark, [Input(str(tmp_path / "a.csv"))])
    people = canonical(found.profiles)
    for policy in ("null", "omit"):
        config = configs.PRESETS["default"] | {"on_missing": policy}
        wanted = pipeline.to_dicts(project(people, config).orderBy("ord").collect(), config)
        assert json.loads("".join(pipeline.json_array(people, config))) == wanted
        pipeline.write_json(people, config, f"file://{tmp_path}/{policy}")
        assert [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/{policy}").collect()] == wanted
        for n in (0, 1, 2):  # one file, byte by byte as json.dumps writes it
            pipeline.write_array(people.orderBy("ord").limit(n), config, f"file://{tmp_path}/{policy}-{n}.json")
            assert (tmp_path / f"{policy}-{n}.json").read_text() == json.dumps(wanted[:n], indent=2, ensure_ascii=False) + "\n"
        records = [json.loads(r[0]) for r in project_records(people, config).orderBy("ord").selectExpr("to_json(record)").collect()]
        assert records == wanted
    assert "".join(pipeline.json_array(people.filter("false"), config)) == "[]"
