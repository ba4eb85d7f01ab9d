"""String functions whose results follow Python's str methods where Spark's own differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, Unicode's and the four separators that str.strip() takes too.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_CASED = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, _ENDS, "")


def text_or_null(s: Column) -> Column:
    """The stripped text; null if nothing is left."""
    return F.nullif(strip(s), F.lit(""))


def title(s: Column) -> Column:
    """Runs of cased letters start with a capital: O'Brien, 3D Printing, Ss for ß."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(_CASED), F.lit(1))
    first = lambda r: F.when(F.startswith(r, F.lit("ß")), "Ss").otherwise(F.upper(F.substring(r, 1, 1)))
    return F.array_join(F.transform(runs, lambda r: F.concat(first(r), r.substr(F.lit(2), F.length(r)))), "")


def collapse(s: Column) -> Column:
    """Stripped, with each run of white space as one space."""
    return F.regexp_replace(strip(s), r"(?U)[\s\x1c-\x1f]+", " ")


def split_list(s: Column, separators: str = ",;|") -> Column:
    """Stripped non-empty parts, split at the first of the separators that occurs anywhere; null gives []."""
    parts = F.array(s)
    for sep in reversed(separators):
        parts = F.when(F.contains(s, F.lit(sep)), F.split(s, "\\" + sep)).otherwise(parts)
    return F.coalesce(F.filter(F.transform(parts, strip), lambda p: p != ""), F.array().cast("array<string>"))


def first_match(s: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null if there is none."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def ordered_distinct(array: Column, fn: Callable[[Column], Column]) -> Column:
    """Non-null results of fn over the array, each at its first place."""
    return F.array_distinct(F.filter(F.transform(array, fn), lambda x: x.isNotNull()))
