"""Allow and block rules for URLs, looked up in a sorted digest array.

The rules' strings (host, then path) are hashed with 64-bit xxHash and sorted; workers memory-map
the digests, probe them with a vectorised binary search and confirm each hit on the stored string.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule set beyond this many bytes is refused rather than broadcast.
MAX_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # fits this host and all its subdomains
    path: str  # fits paths that start with it


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Digests:
    """Sorted 64-bit keys in a memory-mapped file of the worker, beside the rules' strings."""

    def __init__(self, packed: tuple[bytes, list[tuple[str, str, str]]]):
        keys, self.rules = packed
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  unlinked at once; lives as long as the mapping
        self.file.write(keys or b"\0" * 8)
        self.file.flush()
        self.keys = np.memmap(self.file, np.uint64, "r", shape=(len(self.rules),)) if self.rules else np.empty(0, np.uint64)
        self.hosts, self.paths = (sorted({len(x[i]) for x in self.rules}) for i in (1, 2))

    @staticmethod
    def pack(rules: Sequence[Rule]) -> tuple[bytes, list[tuple[str, str, str]]]:
        """One rule for each host and path; block wins over allow for the same ones."""
        one: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            at = (host.translate(str.maketrans(UPPER, LOWER)), path)
            one[at] = "block" if "block" in (verdict, one.get(at)) else verdict
        # digest, then verdict, host, path
        full = sorted((xxhash.xxh64_intdigest(f"{h}\n{p}"), v, h, p) for (h, p), v in one.items())
        size = sum(8 + len(v) + len(h.encode()) + len(p.encode()) for _, v, h, p in full)
        if size > MAX_BYTES:
            raise ValueError(f"{size} bytes of URL rules; at most {MAX_BYTES} are broadcast")
        return np.array([x[0] for x in full], np.uint64).tobytes(), [x[1:] for x in full]

    def judge(self, hosts: pd.Series, paths: pd.Series) -> tuple[list[str | None], list[str | None]]:
        """The longest fitting rule (host and path together; then the longer host) and its verdict."""
        texts: list[tuple[int, str, str]] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            # only parts as long as a rule's are looked up, however long the URL is
            tails = [host[len(host) - n :] for n in self.hosts if n == len(host) or (n < len(host) and host[len(host) - n - 1] == ".")]
            texts += [(i, t, path[:n]) for t in tails for n in self.paths if n <= len(path)]
        best: list[tuple[int, int, str, str] | None] = [None] * len(hosts)
        if texts and len(self.keys):
            wanted = np.fromiter((xxhash.xxh64_intdigest(f"{h}\n{p}") for _, h, p in texts), np.uint64, len(texts))
            low, high = np.searchsorted(self.keys, wanted), np.searchsorted(self.keys, wanted, "right")
            for j in np.flatnonzero(low < high):
                i, host, path = texts[j]
                for verdict, h, p in self.rules[low[j] : high[j]]:
                    if (h, p) == (host, path) and (best[i] is None or (len(h) + len(p), len(h)) > best[i][:2]):
                        best[i] = (len(h) + len(p), len(h), h + p, verdict)
        return [b and b[2] for b in best], [b and b[3] for b in best]


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with columns host, path, rule (null if none fits) and verdict (else ``default``).

    A null url, or one without ://, has empty host and path, so no rule with a host fits it.  Repeated
    rows are judged alike; columns of df by the four names are replaced; an empty df stays empty.
    """
    sent = df.sparkSession.sparkContext.broadcast(Digests.pack(rules))
    own: list[Digests] = []

    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if not own:
            own.append(Digests(sent.value))
        for hosts, paths in batches:
            rule, verdict = own[0].judge(hosts, paths)
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series([v or default for v in verdict], dtype=object)})

    lookup = F.pandas_udf(judged, "rule string, verdict string")
    out = df.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    out = out.withColumn("__judged", lookup("host", "path"))
    return out.withColumn("rule", F.col("__judged.rule")).withColumn("verdict", F.col("__judged.verdict")).drop("__judged")
