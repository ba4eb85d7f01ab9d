"""Resumes: text of PDF and DOCX files, and profiles from that text in Column expressions."""

from __future__ import annotations

import io
import os
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normalize, text
from kinfold.operators.positions import AT
from kinfold.operators.rejects import rejects
from kinfold.schema import EDUCATION, EXPERIENCE, FIELDS, LINKS, LOCATION, as_list, empty, filled, provenance, share
from kinfold.scratch import Scratch
from kinfold.sources import files

# Patterns of contact data, section headers, dates and separators.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(\+?\d[\d\s\-().]{7,}\d)"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9\-_%]+/?"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9\-]+/?"
PORTFOLIO = r"(?i)(?:https?://)?(?:www\.)?[A-Za-z0-9\-]+\.(?:dev|me|io|com)(?:/[^\s,]*)?"
HEADERS = {
    "experience": r"work\s+experience|professional\s+experience|experience|employment\s+history",
    "education": r"education|academic\s+background",
    "skills": r"skills|technical\s+skills|technologies|core\s+competencies",
    "summary": r"summary|profile|about|objective|professional\s+summary",
}
DATES = r"([A-Za-z]+\s+\d{4}|\d{4})\s*[-–—to]+\s*(Present|present|Current|current|[A-Za-z]+\s+\d{4}|\d{4})"
AT_COMPANY = r"(?i)^(.*?)\s+(?:at|@)\s+(.+)$"
DASH_COMPANY = r"^(.*?)\s*[-–—|]\s*(.+)$"
BULLET = r"^[•\-*▪◦]\s*"
SOURCE = "resume"
SKILL_CONFIDENCE = 0.8
TOP_LINES, HEADLINE_CHARS = 15, 300


def lines(s: Column) -> Column:
    return F.split(s, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def full_lines(s: Column) -> Column:
    """Stripped lines, without empty ones."""
    return F.filter(F.transform(lines(s), text.strip), lambda x: x != "")


def sections(body: Column) -> Column:
    """An array of struct(section, line): lines under the last header before them ("header" above the first), headers left out."""

    names = list(HEADERS)
    header = r"(?i)^\s*(?:" + "|".join(f"({p})" for p in HEADERS.values()) + r")\s*:?\s*$"

    def section_of(line: Column) -> Column:
        # one pattern tells whether a line is a header; which one is asked only of those
        bare = text.strip(line)
        known = F.array_position(F.array(*(F.regexp_extract(bare, header, i + 1) != "" for i in range(len(names)))), True)
        return F.when(bare.rlike(header), F.element_at(F.array(*map(F.lit, names)), known.cast("int")))

    each = lines(body)
    found = F.filter(F.transform(each, lambda line, i: F.struct((i + 1).alias("at"), section_of(line).alias("name"))), lambda x: x["name"].isNotNull())
    heads = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("header").alias("name"))), found)
    ends = F.concat(F.transform(found, lambda h: h["at"]), F.array(F.size(each) + 1))
    return F.flatten(F.zip_with(heads, ends, lambda h, end: F.transform(F.slice(each, h["at"] + 1, end - h["at"] - 1), lambda line: F.struct(h["name"].alias("section"), line.alias("line")))))


def section(split: Column, name: str) -> Column:
    own = F.filter(split, lambda x: x["section"] == name)
    return text.strip(F.array_join(F.transform(own, lambda x: x["line"]), "\n"))


def with_https(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url))


def contacts(body: Column) -> dict[str, Column]:
    """First e-mail, phone (of the top lines, else of the whole text), links and portfolio of a text, as written."""
    top = F.array_join(F.slice(lines(body), 1, TOP_LINES), "\n")
    urls = F.filter(F.regexp_extract_all(body, F.lit(PORTFOLIO), F.lit(0)), lambda u: ~F.lower(u).rlike(r"linkedin\.com|github\.com"))
    return {
        "email": text.first_match(body, EMAIL),
        "phone": F.coalesce(text.first_match(top, PHONE), text.first_match(body, PHONE)),
        "linkedin": with_https(text.first_match(body, LINKEDIN)),
        "github": with_https(text.first_match(body, GITHUB)),
        "portfolio": with_https(F.get(urls, F.lit(0))),
    }


def name_line(header: Column) -> Column:
    """The first line of one to five words of letters, without contact data or digits."""
    words = lambda s: F.split(text.collapse(s), " ")
    fits = lambda s: ~s.rlike(rf"{EMAIL}|{LINKEDIN}|{GITHUB}") & ~s.rlike(r"(?U)\d") & (F.size(words(s)) <= 5) & F.forall(words(s), lambda w: F.translate(w, ".,", "").rlike(r"^\p{L}+$"))
    return F.get(F.filter(full_lines(header), fits), F.lit(0))


def headline(header: Column, summary: Column, name: Column) -> Column:
    """The line after the name unless it holds contact data, else the summary's first sentence."""
    listed = full_lines(header)
    after = F.get(listed, F.when(F.array_position(listed, name) > 0, F.array_position(listed, name)).cast("int"))
    after = F.when(~after.rlike(EMAIL) & ~after.rlike(PHONE), after)
    sentence = F.nullif(F.substring(F.get(F.split(text.strip(summary), r"(?<=[.!?])\s+"), F.lit(0)), 1, HEADLINE_CHARS), F.lit(""))
    return F.coalesce(after, sentence)


def chunks(block: Column) -> Column:
    """Full lines of each paragraph; empty paragraphs are left out."""
    return F.filter(F.transform(F.split(text.strip(block), r"\n\s*\n"), full_lines), lambda x: F.size(x) > 0)


def experience(block: Column) -> Column:
    """One job a paragraph: title and company, the first readable date range, the other lines as summary."""

    def job(ls: Column) -> Column:
        first, rest = F.get(ls, F.lit(0)), F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0)))
        pattern = lambda i: F.when(first.rlike(AT_COMPANY), F.regexp_extract(first, AT_COMPANY, i)).when(first.rlike(DASH_COMPANY), F.regexp_extract(first, DASH_COMPANY, i))
        title, company = text.strip(F.coalesce(pattern(1), first)), text.strip(F.coalesce(pattern(2), F.lit("")))
        ranges = F.transform(rest, lambda s, i: F.struct(i.alias("i"), s.rlike(DATES).alias("dated"), normalize.date(F.regexp_extract(s, DATES, 1)).alias("start"), normalize.date(F.regexp_extract(s, DATES, 2)).alias("end"), s.alias("line")))
        readable = F.get(F.filter(ranges, lambda r: r["dated"] & r["start"].isNotNull()), F.lit(0))
        used = F.filter(ranges, lambda r: r["dated"] & (r["i"] <= F.coalesce(readable["i"], F.size(rest))))
        left = F.filter(ranges, lambda r: ~r["dated"] | (r["i"] > F.coalesce(readable["i"], F.size(rest))))
        on_title = F.when(company.rlike(DATES), company).when(title.rlike(DATES), title)
        late = on_title.isNotNull() & readable.isNull()
        cleared = lambda s: F.when(late, F.regexp_replace(F.regexp_replace(s, DATES, ""), r"^[ ,\-]+|[ ,\-]+$", "")).otherwise(s)
        last_end = F.get(used, F.size(used) - 1)["end"]
        return F.struct(
            cleared(company).alias("company"),
            cleared(title).alias("title"),
            F.when(late, normalize.date(F.regexp_extract(on_title, DATES, 1))).otherwise(readable["start"]).alias("start"),
            F.when(late, normalize.date(F.regexp_extract(on_title, DATES, 2))).when(F.size(used) > 0, last_end).alias("end"),
            F.nullif(F.array_join(F.transform(left, lambda r: r["line"]), " "), F.lit("")).alias("summary"),
        )

    return F.filter(F.transform(chunks(block), job), lambda e: (e["title"] != "") | (e["company"] != "")).cast(f"array<{EXPERIENCE}>")


def education(block: Column) -> Column:
    """One school a paragraph: its name, then lines with degree, field and year in any of the usual forms."""

    def school(ls: Column) -> Column:
        rest = F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0)))
        years = F.filter(F.transform(rest, lambda s: F.regexp_extract(s, r"(\d{4})", 1).try_cast("int")), lambda y: y.isNotNull())
        plain = lambda s: F.when(s.rlike(r"\d{4}"), F.regexp_replace(F.regexp_replace(s, r"\d{4}", ""), r"^[ ,()\-]+|[ ,()\-]+$", "")).otherwise(s)
        parts = F.transform(rest, lambda s: F.filter(F.transform(F.split(F.regexp_replace(plain(s), r"(?i)\bin\b", ","), ","), text.strip), lambda p: p != ""))
        pick = lambda n: F.get(F.get(F.filter(parts, lambda p: F.size(p) > n), F.lit(0)), F.lit(n))
        return F.struct(F.get(ls, F.lit(0)).alias("institution"), pick(0).alias("degree"), pick(1).alias("field"), F.get(years, F.size(years) - 1).alias("end_year"))

    return F.transform(chunks(block), school).cast(f"array<{EDUCATION}>")


def skills(block: Column) -> Column:
    """Bullets off; split at the first of , ; | • that occurs, else one a line."""
    plain = F.transform(full_lines(block), lambda s: F.regexp_replace(s, BULLET, ""))
    joined = F.array_join(plain, " ")
    return F.when(joined.rlike("[,;|•]"), text.split_list(joined, ",;|•")).otherwise(plain)


def profiles(docs: DataFrame, as_of_year: int) -> DataFrame:
    """One profile per row of docs (stem, text, at); texts with nothing usable give none."""
    return usable(read_texts(docs, as_of_year))


def usable(found: DataFrame) -> DataFrame:
    return found.filter(F.col("overall_confidence") > 0).select(*FIELDS, "at")


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt to all tasks: a table's file may be one piece that one task reads, and texts take much longer to look through than to move."""
    return docs.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)


def parted(docs: DataFrame) -> DataFrame:
    """stem, text, at and the sections of each text that has any, saved: later steps read the sections, and don't find them again.

    One pattern tells headers from other lines, and the texts are dealt to all tasks first.
    """
    scratch = Scratch(docs.sparkSession, "resume")
    split = scratch.save(spread(docs.filter(text.strip(F.col("text")) != "")).withColumn("__s", sections(F.col("text"))), "sections")
    return scratch.save(split.select("stem", "text", "at", *(section(F.col("__s"), n).alias(f"__{n}") for n in ("header", *HEADERS))), "parts")


def read_texts(docs: DataFrame, as_of_year: int) -> DataFrame:
    """What profiles() finds, saved, with rows for texts with nothing usable too (overall_confidence 0).

    Years of experience are counted from the earliest start to ``as_of_year``.
    """
    parts = parted(docs)
    found = contacts(F.col("text"))
    scratch = Scratch(docs.sparkSession, "resume")
    read = parts.select("stem", "at", name_line(F.col("__header")).alias("__name"), "__header", "__summary", *(c.alias(f"c_{n}") for n, c in found.items()), experience(F.col("__experience")).alias("experience"), education(F.col("__education")).alias("education"), skills(F.col("__skills")).alias("__raw"))
    read = scratch.save(read, "read")
    names = F.filter(F.transform("__raw", normalize.skill), lambda s: s != "")
    starts = F.filter(F.transform("experience", lambda e: F.substring(e["start"], 1, 4).try_cast("int")), lambda y: y.isNotNull())
    linked = F.coalesce("c_linkedin", "c_github", "c_portfolio").isNotNull()
    out = read.select(
        F.concat(F.lit("resume_"), "stem").alias("candidate_id"),
        normalize.name(F.col("__name")).alias("full_name"),
        as_list(normalize.email(F.col("c_email")), "string").alias("emails"),
        as_list(normalize.phone(F.col("c_phone")), "string").alias("phones"),
        F.lit(None).cast(LOCATION).alias("location"),
        F.when(linked, F.struct(F.col("c_linkedin").alias("linkedin"), F.col("c_github").alias("github"), F.col("c_portfolio").alias("portfolio"), empty("string").alias("other")).cast(LINKS)).alias("links"),
        headline(F.col("__header"), F.col("__summary"), F.col("__name")).alias("headline"),
        (F.lit(as_of_year) - F.array_min(starts)).cast("double").alias("years_experience"),
        F.transform(names, lambda s: F.struct(s.alias("name"), F.lit(SKILL_CONFIDENCE).alias("confidence"), F.array(F.lit(SOURCE)).alias("sources"))).alias("skills"),
        "experience",
        "education",
        F.col("at").cast(AT).alias("at"),
    )
    has = {c: F.col(c).isNotNull() for c in ("full_name", "links", "headline", "years_experience")} | {c: filled(F.col(c)) for c in ("emails", "phones", "skills", "experience", "education")}
    shares = [has[c] for c in ("full_name", "emails", "phones", "headline", "experience", "education", "skills")]
    entries = [("full_name", "direct"), ("emails", "direct"), ("phones", "normalized"), ("links", "direct"), ("headline", "direct"), ("experience", "normalized"), ("education", "normalized"), ("skills", "normalized"), ("years_experience", "inferred")]
    out = out.withColumn("provenance", provenance(SOURCE, *((f, has[f], how) for f, how in entries))).withColumn("overall_confidence", share(shares))
    return scratch.save(out.select(*FIELDS, "at"), "profiles")


def docx_text(content: bytes) -> str | None:
    """Paragraphs of the body, then the non-blank cells of its tables, a line each."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    if body is None:
        return None
    marks = {f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}
    run = lambda p: "".join((t.text or "") if t.tag == f"{w}t" else marks.get(t.tag, "") for t in p.iter())
    found = [run(p) for p in body.findall(f"{w}p")]
    for cell in (c for table in body.findall(f"{w}tbl") for c in table.iter(f"{w}tc")):
        if (inner := "\n".join(run(p) for p in cell.findall(f"{w}p"))).strip():
            found.append(inner)
    return "\n".join(found)


def pdf_text(content: bytes) -> str | None:
    """Text of the pages where the optional pdfplumber is installed, else null."""
    try:
        import pdfplumber
    except ImportError:
        return None
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\n".join(t for t in (page.extract_text() for page in pdf.pages) if t) or None


READERS = {".docx": docx_text, ".pdf": pdf_text}


def text_of(path: str, content: bytes) -> str | None:
    """The text of a document; null if it is of another kind, or damaged, encrypted or empty in whatever way."""
    reader = READERS.get(os.path.splitext(path)[1].lower())
    try:
        return reader(content) if reader and content else None
    except Exception:  # noqa: BLE001  one bad document does not stop the others
        return None


def texts(documents: DataFrame) -> DataFrame:
    """path and text (null where there is none) of each row of documents (path, content)."""
    to_text = F.pandas_udf(lambda paths, contents: pd.Series([text_of(p, c) for p, c in zip(paths, contents, strict=True)], dtype=object), "string")
    return documents.select("path", to_text("path", "content").alias("text"))


def read(spark: SparkSession, path: str, as_of_year: int) -> DataFrame:
    """Profiles of a document, or of all in a folder; those without text give none."""
    return read_noted(spark, path, as_of_year)[0]


def read_noted(spark: SparkSession, path: str, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """Profiles, and the rejects: documents without a readable text, and those with nothing usable in it."""
    scratch = Scratch(spark, "resume")
    found = scratch.save(texts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)), "texts")
    place = F.struct(F.col("path").alias("file"), F.lit(0).alias("start"), F.lit(0).alias("pos"))
    made = read_texts(found.filter("text IS NOT NULL").select(files.stem(F.col("path")).alias("stem"), "text", place.alias("at")), as_of_year)
    none = F.col("text").isNull()
    blank = ~none & (text.strip(F.col("text")) == "")
    unread = rejects(found.filter(none | blank), F.col("path"), F.lit(None), F.when(none, "no readable text").otherwise("nothing usable"))
    return usable(made), unread.unionByName(rejects(made.filter("overall_confidence = 0"), F.col("at.file"), F.lit(None), F.lit("nothing usable")))
