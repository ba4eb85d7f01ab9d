"""Files of three kinds about the same people, from reading to the written array."""

from __future__ import annotations

import io
import json
import zipfile

from kinfold.plans import config as configs
from kinfold.plans import pipeline
from kinfold.sources.inputs import Input, read_all

TEAM = """name,email,phone,current_company,title,location,skills,years_experience,school,degree,notes
ann lee,ANN@x.org,98110 23456,Acme,Engineer,"Pune, Maharashtra, India","Python, js",4,,,met at a fair
Bo Li,bo@x.org,,Beta,,,Go,,,,
no mail,,,,,,,,,,only a note
,,,,,,,,,,
Cy Lo,cy@x.org,+1 (415) 555-0100,,,Oslo,,2.5,Uni,BSc,
"""
EXPORT = {
    "exported": {"at": "2024-01-01", "by": ["}", "]"]},
    "applicants": [
        {"applicantId": "A-1", "applicant": {"fullName": "Ann B. Lee", "email": "ann@x.org", "githubUrl": "https://github.com/annlee", "yearsOfExperience": 5, "skills": ["Python", {"name": "k8s"}]},
         "workHistory": [{"company": "Acme", "title": "engineer", "startDate": "2020-01", "endDate": "Present", "description": "Built it."}], "education": [{"institution": "Uni", "degree": "MSc", "graduationYear": 2019}]},
        "no record",
        {"applicantId": "A-3", "applicant": {"name": "Di Ro", "phone": "+14155550100"}},
    ],
}
RESUME = ["Bo Li", "Backend Engineer", "bo@x.org | linkedin.com/in/boli", "", "Experience", "Engineer at Gamma", "2018 - 2020", "", "Skills", "Rust, Go lang"]



def docx(lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


CUSTOM = """[
  {
    "full_name": "Ann Lee",
    "primary_email": "ann@x.org",
    "phone": "+919811023456",
    "skills": [
      "JavaScript",
      "Python",
      "Kubernetes"
    ],
    "overall_confidence": 0.92
  }
]
"""


def files(folder):
    (folder / "team.csv").write_text(TEAM)
    (folder / "export.json").write_text(json.dumps(EXPORT, indent=2))
    (folder / "cv.docx").write_bytes(docx(RESUME))
    return [Input(str(folder / n)) for n in ("team.csv", "export.json", "cv.docx")]


def test_three_kinds_of_files_become_people(spark, tmp_path):
    found = read_all(spark, files(tmp_path), 2024)
    assert found.skipped == [] and sorted((r.input, r.pos, r.reason) for r in found.rejects.collect()) == [(0, 3, "no known value"), (1, 1, "item is no object")]
    people = pipeline.canonical(found.profiles)
    rows = {r.candidate_id: r for r in people.collect()}
    assert list(rows) and set(rows) == {"team_row0", "team_row1", "team_row2", "team_row4"}
    ann, bo, cy = rows["team_row0"], rows["team_row1"], rows["team_row4"]
    assert {p.source for p in ann.provenance} == {"csv", "ats_json"} and {p.source for p in bo.provenance} == {"csv", "resume"}
    assert [(e.company, e.title, e.start, e.summary) for e in ann.experience] == [("Acme", "engineer", "2020-01", "Built it.")]
    assert [(e.company, e.title, e.start) for e in bo.experience] == [("Beta", "", None), ("Gamma", "Engineer", "2018")]
    assert bo.links.linkedin == "https://linkedin.com/in/boli" and bo.headline == "Backend Engineer" and bo.years_experience == 6.0
    assert [s.name for s in bo.skills] == ["Go", "Rust"] and [s.sources for s in bo.skills] == [["csv", "resume"], ["resume"]]
    assert (cy.full_name, cy.emails, cy.phones, cy.location.city) == ("Cy Lo", ["cy@x.org"], ["+14155550100"], "Oslo")  # the same phone number: one person


def test_the_written_array(spark, tmp_path):
    config = {"fields": [{"path": "full_name"}, {"path": "primary_email", "from": "emails[0]", "required": True}, {"path": "phone", "from": "phones[0]"}, {"path": "skills", "from": "skills[].name"}], "include_confidence": True}
    people = pipeline.canonical(read_all(spark, files(tmp_path), 2024).profiles)
    pipeline.write_array(people, config, f"file://{tmp_path}/all.json")
    written = (tmp_path / "all.json").read_text()
    records = json.loads(written)
    assert written == json.dumps(records, indent=2, ensure_ascii=False) + "\n"
    assert [r["full_name"] for r in records] == ["Ann Lee", "Bo Li", "Cy Lo"]  # the fuller record names her
    pipeline.write_array(people.filter("candidate_id = 'team_row0'"), config, f"file://{tmp_path}/one.json")
    assert (tmp_path / "one.json").read_text() == CUSTOM
    pipeline.write_array(people, configs.PRESETS["default"], f"file://{tmp_path}/default.json")
    assert len(json.loads((tmp_path / "default.json").read_text())) == 4
