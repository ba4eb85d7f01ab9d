"""The normalisers as SQL functions of a session: SELECT normalize_phone(phone) FROM people.

They are defined in SQL, so Catalyst inlines their bodies like those of views: nothing leaves the
JVM, and filters and columns are pushed through them.  Tests hold them against the Column functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from kinfold.functions.normalize import COUNTRIES, OPEN_DATES, SKILLS, meanings, month_numbers


def _map(entries: dict[str, str]) -> str:
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "map(" + ", ".join(quoted(x) for pair in entries.items() for x in pair) + ")"


def _numeric(pattern: str, year: int, month: int) -> str:
    return f"WHEN rlike(s, r'{pattern}') THEN concat(regexp_extract(s, r'{pattern}', {year}), '-', lpad(regexp_extract(s, r'{pattern}', {month}), 2, '0'))"


def _named(pattern: str, year: int, month: int) -> str:
    number = f"try_element_at({_map(month_numbers())}, lower(regexp_extract(s, r'{pattern}', {month})))"
    return f"WHEN rlike(s, r'{pattern}') AND {number} IS NOT NULL THEN concat(regexp_extract(s, r'{pattern}', {year}), '-', {number})"


def _let(value: str, name: str, body: str) -> str:
    """body, in which name stands for value: a lambda variable, so that value is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _strip(s: str) -> str:
    return rf"regexp_replace({s}, r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '')"


def _title(s: str) -> str:
    runs = rf"regexp_extract_all(lower({s}), r'([\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+)', 1)"
    return f"array_join(transform({runs}, r -> concat(CASE WHEN startswith(r, 'ß') THEN 'Ss' ELSE upper(substring(r, 1, 1)) END, substring(r, 2))), '')"


def definitions() -> dict[str, tuple[str, str, str]]:
    """Parameters, result type and body of each function."""
    first_of = "".join(f" WHEN contains(s, '{c}') THEN split(s, '\\\\{c}')" for c in ",;|")
    dates = [
        _numeric(r"^(\d{4})[/\-.](\d{1,2})$", 1, 2),
        _numeric(r"^(\d{1,2})[/\-.](\d{4})$", 2, 1),
        _named(r"^([A-Za-z]+)[,\s]+(\d{4})$", 2, 1),
        _named(r"^(\d{4})[,\s]+([A-Za-z]+)$", 1, 2),
        r"WHEN rlike(s, r'^\d{4}$') THEN s",
    ]
    prefixed = f"CASE WHEN startswith({_strip('raw')}, '+') THEN kept WHEN length(kept) = 10 THEN concat('+', country_code, kept) WHEN length(kept) > 7 THEN concat('+', kept) END"
    full = r"CASE WHEN length(regexp_replace(full, r'^\++', '')) BETWEEN 7 AND 15 THEN full END"
    country = f"coalesce(try_element_at({_map(meanings(COUNTRIES))}, lower(s)), CASE WHEN rlike(s, '^[A-Za-z]{{2}}$') THEN upper(s) END)"
    collapsed = rf"regexp_replace({_strip('raw')}, r'(?U)[\s\x1c-\x1f]+', ' ')"
    return {
        "py_strip": ("s STRING", "STRING", _strip("s")),
        "py_title": ("s STRING", "STRING", _title("s")),
        "normalize_phone": ("raw STRING, country_code STRING DEFAULT '91'", "STRING", _let(r"regexp_replace(raw, r'(?U)[^\d+]', '')", "kept", _let(prefixed, "full", full))),
        "normalize_date": ("raw STRING", "STRING", _let(_strip("raw"), "s", f"CASE WHEN lower(s) IN ({', '.join(repr(d) for d in OPEN_DATES)}) THEN NULL {' '.join(dates)} END")),
        "normalize_skill": ("raw STRING", "STRING", _let(_strip("raw"), "s", f"coalesce(try_element_at({_map(meanings(SKILLS))}, lower(s)), {_title('s')}, '')")),
        "normalize_country": ("raw STRING", "STRING", _let(_strip("raw"), "s", country)),
        "normalize_email": ("raw STRING", "STRING", _let(f"lower({_strip('raw')})", "e", "CASE WHEN contains(e, '@') AND contains(substring_index(e, '@', -1), '.') THEN e END")),
        "normalize_name": ("raw STRING", "STRING", _let(collapsed, "n", f"CASE WHEN length(n) >= 2 THEN {_title('n')} END")),
        "parse_years": ("raw STRING", "DOUBLE", r"try_cast(regexp_extract(raw, r'(\d+(?:\.\d+)?)', 1) AS DOUBLE)"),
        "split_skills": ("s STRING", "ARRAY<STRING>", f"coalesce(filter(transform(CASE{first_of} ELSE array(s) END, p -> {_strip('p')}), p -> p <> ''), array())"),
    }


def register(spark: SparkSession) -> list[str]:
    """Defines the functions in the session (again, if they are); their names."""
    found = definitions()
    for name, (parameters, kind, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(found)
