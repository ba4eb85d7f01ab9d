"""Normalizers as Column functions: total, deterministic, null where a value can't be normalised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.text import collapse, strip, title

# Skills, with the spellings that mean each.
SKILLS = {
    "AWS": ["aws", "amazon web services"],
    "Anaconda": ["anaconda"],
    "Android Studio": ["android studio"],
    "Angular": ["angularjs"],
    "Azure": ["azure", "microsoft azure"],
    "Bitbucket": ["bitbucket"],
    "Bootstrap": ["bootstrap"],
    "C#": ["c#", "csharp"],
    "C++": ["c++", "cplusplus"],
    "CI/CD": ["ci/cd", "cicd"],
    "CSS": ["css"],
    "CSS3": ["css3"],
    "Computer Vision": ["computer vision", "cv"],
    "Deep Learning": ["deep learning", "dl"],
    "Django": ["django"],
    "Docker": ["docker"],
    "Firebase": ["firebase"],
    "Flutter": ["flutter"],
    "GCP": ["gcp", "google cloud", "google cloud platform"],
    "Git": ["git"],
    "GitHub": ["github"],
    "GitLab": ["gitlab"],
    "Go": ["golang", "go lang"],
    "HTML": ["html"],
    "HTML5": ["html5"],
    "JavaScript": ["javascript", "js", "es6", "ecmascript"],
    "Keras": ["keras"],
    "Kotlin": ["kotlin"],
    "Kubernetes": ["kubernetes", "k8s"],
    "Machine Learning": ["machine learning", "ml"],
    "MongoDB": ["mongo", "mongodb"],
    "MySQL": ["mysql"],
    "NLP": ["nlp", "natural language processing"],
    "Node.js": ["node", "nodejs", "node.js"],
    "NumPy": ["numpy"],
    "Pandas": ["pandas"],
    "PostgreSQL": ["postgres", "postgresql"],
    "PyTorch": ["pytorch", "torch"],
    "Python": ["python3", "py", "python 3"],
    "React": ["reactjs", "react.js"],
    "React Native": ["react native"],
    "Ruby on Rails": ["ruby on rails", "ror"],
    "SQL Server": ["mssql", "ms sql"],
    "Swift": ["swift"],
    "TensorFlow": ["tensorflow", "tf"],
    "TypeScript": ["typescript", "ts"],
    "Vue.js": ["vuejs", "vue"],
    "scikit-learn": ["scikit-learn", "sklearn"],
}
# ISO 3166 codes, with the names that mean each.
COUNTRIES = {
    "AE": ["uae", "united arab emirates"],
    "AT": ["austria"],
    "AU": ["australia"],
    "BR": ["brazil"],
    "CA": ["canada"],
    "CH": ["switzerland"],
    "CN": ["china"],
    "DE": ["germany", "deutschland"],
    "DK": ["denmark"],
    "ES": ["spain"],
    "FI": ["finland"],
    "FR": ["france"],
    "GB": ["united kingdom", "uk", "great britain", "england"],
    "IE": ["ireland"],
    "IL": ["israel"],
    "IN": ["india"],
    "IT": ["italy"],
    "JP": ["japan"],
    "KR": ["south korea", "korea"],
    "MX": ["mexico"],
    "NL": ["netherlands", "holland"],
    "NO": ["norway"],
    "NZ": ["new zealand"],
    "PT": ["portugal"],
    "SE": ["sweden"],
    "SG": ["singapore"],
    "US": ["united states", "usa", "us", "u.s.", "u.s.a.", "america"],
}
# Months, and words for a date that is open.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
OPEN_DATES = ("present", "current", "now", "ongoing", "—", "-", "")


def meanings(spellings: dict[str, list[str]]) -> dict[str, str]:
    """What each spelling means."""
    return {spelling: name for name, all_of_it in spellings.items() for spelling in all_of_it}


def month_numbers() -> dict[str, str]:
    return {key: f"{i:02d}" for i, name in enumerate(MONTHS, 1) for key in (name, name[:3])}


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def phone(raw: Column, country_code: str = "91") -> Column:
    """E.164: digits and plus signs are kept; a number without a leading plus gets one by its length."""
    kept = F.regexp_replace(raw, r"(?U)[^\d+]", "")
    n = F.length(kept)
    full = (
        F.when(F.startswith(strip(raw), F.lit("+")), kept)
        .when(n == 10, F.concat(F.lit(f"+{country_code}"), kept))
        .when(((n == 11) & F.startswith(kept, F.lit("1"))) | (n > 7), F.concat(F.lit("+"), kept))
    )
    return F.when(F.length(F.regexp_replace(full, r"^\++", "")).between(7, 15), full)


def date(raw: Column) -> Column:
    """YYYY-MM from year and month in the usual orders, YYYY from a year; null else, also for open dates."""
    s = strip(raw)
    number = literal_map(month_numbers())

    def named(pattern: str, year: int, month: int) -> tuple[Column, Column]:
        found = F.try_element_at(number, F.lower(F.regexp_extract(s, pattern, month)))
        return F.when(s.rlike(pattern), F.concat_ws("-", F.regexp_extract(s, pattern, year), found)), s.rlike(pattern) & found.isNotNull()

    def numeric(pattern: str, year: int, month: int) -> Column:
        return F.concat_ws("-", F.regexp_extract(s, pattern, year), F.lpad(F.regexp_extract(s, pattern, month), 2, "0"))

    year_first, month_first = r"^(\d{4})[/\-.](\d{1,2})$", r"^(\d{1,2})[/\-.](\d{4})$"
    (word_first, is_word_first), (word_last, is_word_last) = named(r"^([A-Za-z]+)[,\s]+(\d{4})$", 2, 1), named(r"^(\d{4})[,\s]+([A-Za-z]+)$", 1, 2)
    return (
        F.when(F.lower(s).isin(*OPEN_DATES), None)
        .when(s.rlike(year_first), numeric(year_first, 1, 2))
        .when(s.rlike(month_first), numeric(month_first, 2, 1))
        .when(is_word_first, word_first)
        .when(is_word_last, word_last)
        .when(s.rlike(r"^\d{4}$"), s)
    )


def skill(raw: Column) -> Column:
    """The canonical name, or the text in title case; null gives an empty string."""
    s = strip(raw)
    return F.coalesce(F.try_element_at(literal_map(meanings(SKILLS)), F.lower(s)), title(s), F.lit(""))


def skills(raw: Column) -> Column:
    """Canonical names, each at its first place."""
    return F.array_distinct(F.filter(F.transform(raw, skill), lambda s: s != ""))


def country(raw: Column) -> Column:
    """ISO 3166 alpha-2 of a known name, or any two letters in capitals; "remote" is no country."""
    s = strip(raw)
    return F.coalesce(F.try_element_at(literal_map(meanings(COUNTRIES)), F.lower(s)), F.when(s.rlike(r"^[A-Za-z]{2}$"), F.upper(s)))


def email(raw: Column) -> Column:
    """Stripped and lower-cased, if there is a dot after the last at sign."""
    e = F.lower(strip(raw))
    return F.when(F.contains(e, F.lit("@")) & F.contains(F.substring_index(e, "@", -1), F.lit(".")), e)


def name(raw: Column) -> Column:
    """Single spaces and title case; null below two characters."""
    n = collapse(raw)
    return F.when(F.length(n) >= 2, title(n))


def years(raw: Column) -> Column:
    """The first number in a text."""
    return F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


#: What a projection may name as ``normalize``.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {"E164": phone, "canonical": skill, "YYYY-MM": date, "ISO2": country}
