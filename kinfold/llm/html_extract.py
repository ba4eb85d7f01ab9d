"""Main text of web pages by differencing each page with the pages of the nearest URLs.

Pages are range sorted by host and path, so that the nearest URLs of a host are neighbours.  Each
page is read into text lines (its blocks), aligned with the lines of its nearest neighbours of other
content by longest common subsequences, and lines that most of them share are deleted as the site's
furniture.  What the pages' markup
says is checked afterwards: lines of an article element stay although a copied page shares them, and
lines of menus, adverts and the like go although no neighbour happens to share them.
"""

from __future__ import annotations

import html
import math
import re
from collections import OrderedDict, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import gives_back, slices
from kinfold.llm.url_filter import url_host, url_path
from kinfold.scratch import Scratch

#: Other contents before and after a page that it is aligned with, and characters of pages in a range.
NEAR, RANGE_CHARS = 8, 64_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|iframe|xmp)\b(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
# A name and its value: quoted values are read whole, so that names inside them do not count.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")

# Elements that begin and end a block, those that have no content, and those that hold the article.
BLOCKS = frozenset("address article aside blockquote body br center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
# Elements, and whole names of class, id and role ("_" as "-"), that mark what is not the article.
NOT_TEXT = frozenset("nav footer aside form head menu dialog select button svg canvas object audio video template noscript".split())
NOT_TEXT_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle banner-ad google-ad sponsored-content breadcrumb-nav breadcrumb-list comment-form comment-list comment-respond comment-section comments-area comments-list comments-section disqus-thread "
    "consent-banner cookie-banner cookie-bar cookie-consent cookie-law cookie-message cookie-notice cookie-popup gdpr-banner gdpr-notice main-menu main-nav main-navigation mobile-menu mobile-nav nav-bar nav-links nav-menu nav-menus navbar-nav post-navigation posts-navigation primary-menu primary-nav primary-navigation secondary-nav side-bar side-nav site-nav site-navigation sub-menu top-menu top-nav "
    "global-footer global-header main-footer main-header page-footer site-footer site-header login-form newsletter-form newsletter-signup search-box search-form searchform signup-form subscribe-form related-articles related-links related-posts recommended-posts "
    "share-bar share-buttons share-links sharing-buttons social-buttons social-icons social-links social-share sidebar-widget widget-area".split()
)
# Parts of an article that get their id from their heading: inside an article it tells nothing; headings are never marked there.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED_BY_HEADING = HEADINGS | frozenset("section p figure table blockquote li dt dd".split())
# Of these, what an article has as its own: its head, a warning in its text.
IN_ARTICLE = frozenset("header main-header alert notice discussion".split())
# An element that holds all of a page's article and main elements is never marked; one that holds some is, by these alone.
NEVER_MAIN = frozenset("nav footer aside menu dialog template".split())
LISTS = frozenset("comment comments comment-list comment-section comments-area comments-list comments-section disqus-thread replies related related-articles related-posts recommended recommended-posts promoted sponsored-content".split())
# A paragraph or list item that is left open ends where its like begins.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Line(NamedTuple):
    text: str
    kind: str  # "main": in an article element; "not": in a menu, advert ...; "open": neither


def _marks_not_text(tag: str, attrs: str, in_main: bool, holds_some: bool) -> bool:
    """Whether an element is none of the article, and so all inside it."""
    if tag in NEVER_MAIN or (not holds_some and (tag in NOT_TEXT or (tag == "header" and not in_main))):
        return True
    if not attrs or tag in MAIN or tag in ("html", "body") or (in_main and tag in HEADINGS):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if not holds_some and (name == "hidden" or (name == "style" and "display:none" in value.replace(" ", ""))):
            return True
        if name in ("class", "id", "role") and not (name == "id" and in_main and tag in NAMED_BY_HEADING):
            names = (LISTS if holds_some else NOT_TEXT_NAMES).intersection(value.replace("_", "-").split())
            if names - IN_ARTICLE if in_main else names:
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order, with white space collapsed and character references decoded."""
    elements: list[tuple[str, str, int]] = [("", "", 0)]  # name, attributes and parent of each; the first is the page
    holds: dict[int, int] = {0: 0}  # elements that hold article or main elements, and how many
    pieces: list[tuple[str, int]] = []  # texts and their elements; an empty text ends a line
    stack, at = [0], 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append((page[at : m.start()], stack[-1]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            pieces.append(("", 0))
        elif tag in ("td", "th"):
            pieces.append((" ", stack[-1]))
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            continue
        if tag in SELF_CLOSING and elements[stack[-1]][0] in SELF_CLOSING[tag]:
            stack.pop()
        if tag not in VOID and not m["attrs"].endswith("/"):
            if tag in MAIN:
                holds.update((i, holds.get(i, 0) + 1) for i in stack)
            elements.append((tag, m["attrs"], stack[-1]))
            stack.append(len(elements) - 1)
    if at < len(page):
        pieces.append((page[at:], stack[-1]))

    kinds = ["open"]
    for i, (tag, attrs, parent) in enumerate(elements[1:], 1):
        now = kinds[parent]
        if now != "not":
            held = holds.get(i, 0)
            if (not held or held < holds[0]) and _marks_not_text(tag, attrs, now == "main", held > 0):
                now = "not"
            elif tag in MAIN:
                now = "main"
        kinds.append(now)

    found: list[Line] = []
    parts: list[str] = []
    kind = "open"
    for text, element in [*pieces, ("", 0)]:
        if parts and (not text or kinds[element] != kind):
            line = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if line:
                found.append(Line(line, kind))
        if text:
            parts.append(text)
            kind = kinds[element]
    return found


def shared(own: list[str], other: list[str]) -> list[bool]:
    """Which of the own lines lie on a longest common subsequence with the other lines (bit-parallel)."""
    marks = [False] * len(own)
    low, high = 0, 0
    while low < min(len(own), len(other)) and own[low] == other[low]:
        marks[low] = True
        low += 1
    while high < min(len(own), len(other)) - low and own[-1 - high] == other[-1 - high]:
        marks[len(own) - 1 - high] = True
        high += 1
    a, b = own[low : len(own) - high], other[low : len(other) - high]
    places: dict[str, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for line in b:
        rows.append(row)
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    rows.append(row)
    i, j = len(a), len(b)  # bit i of a row is 0 where the common subsequence of a[:i+1] and b[:j] is longer than that of a[:i]
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            marks[low + i] = True
    return marks


def extract(own: list[Line], others: list[list[Line]]) -> str:
    """Main text of a page, given its lines and those of neighbouring pages.

    Copies of the page say nothing.  A line goes if more than half of the others share it, so that
    an article that one or few of them repeat stays; where there are fewer than three others, one that
    shares all lines is taken for a copy too.  An article element keeps its lines, and marked lines go
    in any case; lines that no element tells about are left to the alignment.
    """
    read = [x for x in own if x.kind != "not"]
    gone = [False] * len(read)
    if any(x.kind == "open" for x in read):
        mine = [x.text for x in read]
        lists = [[x.text for x in other if x.kind != "not"] for other in others]
        marks = [shared(mine, x) for x in lists if x != mine]
        if len(marks) < 3:
            marks = [m for m in marks if not all(m)]
        if marks:
            gone = [2 * sum(column) > len(marks) for column in zip(*marks, strict=True)]
    return "\n".join(x.text for x, out in zip(read, gone, strict=True) if x.kind == "main" or not out)


def digest(lines: list[Line]) -> bytes:
    """Equal for pages of equal lines outside menus and the like."""
    return xxhash.xxh3_128_digest("\n".join(x.kind + x.text for x in lines if x.kind != "not"))


class Group(NamedTuple):
    """Successive pages of a host with equal lines, and the nearest other contents before and after."""

    place: int
    digest: bytes
    lines: list[Line]
    before: list[list[Line]]
    after: list[list[Line]]
    rows: list[tuple]


class Neighbours:
    """Takes the pages of a host in order; gives them back in groups as soon as NEAR other contents follow."""

    def __init__(self) -> None:
        self.latest: OrderedDict[bytes, list[Line]] = OrderedDict()  # the last NEAR + 1 contents
        self.waiting: deque[Group] = deque()
        self.last: dict[bytes, int] = {}  # the last waiting group of each content
        self.place = 0

    def add(self, lines: list[Line], row: tuple | None) -> None:
        key = digest(lines)
        if not self.waiting or self.waiting[-1].digest != key:
            lines = self.latest.setdefault(key, lines)
            before = [x for k, x in reversed(self.latest.items()) if k != key][:NEAR]
            seen = self.last.get(key, -1)
            for group in reversed(self.waiting):
                if group.place <= seen:
                    break
                if len(group.after) < NEAR:
                    group.after.append(lines)
            self.place += 1
            self.waiting.append(Group(self.place, key, lines, before, [], []))
            self.last[key] = self.place
            self.latest.move_to_end(key)
            if len(self.latest) > NEAR + 1:
                self.latest.popitem(last=False)
        if row is not None:
            self.waiting[-1].rows.append(row)

    def ready(self, end: bool = False) -> Iterator[tuple[tuple, str]]:
        while self.waiting and (end or len(self.waiting[0].after) == NEAR):
            group = self.waiting.popleft()
            if self.last[group.digest] == group.place:
                del self.last[group.digest]
            if group.rows:
                text = extract(group.lines, group.before + group.after)
                for row in group.rows:
                    yield row, text


def halo(edges: list[Row]) -> list[tuple[Row, int]]:
    """Which pages at the edges of ranges other ranges need, given each range's first and last contents of its outer hosts."""
    ranges: dict[int, dict[str, list[Row]]] = {}
    for e in sorted(edges, key=lambda e: (e["range"], e["nth"])):
        ranges.setdefault(e["range"], {"start": [], "first": [], "last": []})[e["side"]].append(e)
    order, out = sorted(ranges), []
    for own in range(len(order)):
        for step, near, far in ((-1, "first", "last"), (1, "last", "first")):
            host, seen = ranges[order[own]][near][0]["host"], set()
            at = own + step
            while 0 <= at < len(order) and len(seen) <= NEAR:
                there = ranges[order[at]]
                if there[far][0]["host"] != host:
                    break
                for e in there[far]:
                    if e["digest"] not in seen and len(seen) <= NEAR:
                        seen.add(e["digest"])
                        out.append((e, own))
                if there[near][0]["host"] != host:
                    break
                at += step
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if there is none) and n_chars (its code points) of each row of pages.

    Needs page_id, url and html; other columns are not read.  Null html counts as empty; a null url
    has no host, so such pages are neighbours of each other.  Pages of one URL are neighbours in the
    order of page_id, repeated rows too.  Whole pages are read; an empty table gives no rows.  The
    neighbours are the NEAR other contents before and after a page on its host; those beyond the
    edge of a task's range are sent to it, so that texts do not depend on the number of ranges.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    scratch, order = Scratch(pages.sparkSession, "pages"), ["host", "path", "url", "page_id"]
    ranged = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    kinds = ranged.schema
    keys = [T.StructField(c, kinds[c].dataType) for c in order]
    light = T.StructType([*keys, T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType())])
    edge = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("side", T.StringType()), T.StructField("nth", T.IntegerType()), *light])
    result = T.StructType([T.StructField("page_id", kinds["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    light_arrow, edge_arrow, result_arrow = (to_arrow_schema(x) for x in (light, edge, result))

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = batch["html"].to_pylist()
            more = [pa.array([digest(lines_of(x)) for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in order), *more], schema=light_arrow)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, host, first, last = None, None, {}, OrderedDict()
        for batch in batches:
            for row in batch.to_pylist():
                start = start or row
                if host != (row["host"],):
                    host = (row["host"],)
                    last.clear()
                if row["host"] == start["host"] and len(first) <= NEAR:
                    first.setdefault(row["digest"], row)
                last[row["digest"]] = row
                last.move_to_end(row["digest"])
                if len(last) > NEAR + 1:
                    last.popitem(last=False)
        number = TaskContext.get().partitionId()
        sides = (("start", [start] if start else []), ("first", first.values()), ("last", reversed(last.values())))
        yield pa.RecordBatch.from_pylist([{"range": number, "side": side, "nth": i, **row} for side, rows in sides for i, row in enumerate(rows)], schema=edge_arrow)

    @gives_back
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: Iterator[tuple[tuple, str]]) -> list[dict]:
            return [{"page_id": i, "url": url, "text": text, "n_chars": len(text)} for (i, url), text in found]

        near, where = Neighbours(), None
        for batch in slices(batches, "html"):
            out = []
            for row in batch.to_pylist():
                if where != (row["range"], row["host"]):
                    out += batch_of(near.ready(end=True))
                    near, where = Neighbours(), (row["range"], row["host"])
                near.add(lines_of(row["html"]), (row["page_id"], row["url"]) if row["own"] else None)
                out += batch_of(near.ready())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=result_arrow)
        if out := batch_of(near.ready(end=True)):
            yield pa.RecordBatch.from_pylist(out, schema=result_arrow)

    spark = pages.sparkSession
    known = scratch.save(ranged.mapInArrow(read, light), "contents")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (known.agg(F.sum("size")).first()[0] or 0) // RANGE_CHARS + 1)
    edges = known.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(outer, edge).collect()
    scratch.drop("contents")
    starts = [tuple(e[c] for c in order) for e in sorted((e for e in edges if e["side"] == "start"), key=lambda e: e["range"])]
    # a page's range is sought among the first starts of runs of ranges, then within a run
    run, keys_type = max(1, math.isqrt(len(starts))), T.ArrayType(T.StructType(keys))
    runs = [starts[i : i + run] for i in range(0, len(starts), run)]
    bounds = spark.createDataFrame([([r[0] for r in runs], runs)], T.StructType([T.StructField("firsts", keys_type), T.StructField("runs", T.ArrayType(keys_type))]))
    at = lambda array: F.greatest(F.lit(0), F.size(F.filter(array, lambda b: b <= F.struct(*order))) - 1)
    place = F.col("run") * run + F.when(F.size("runs") > 0, at(F.get("runs", F.col("run")))).otherwise(0)
    copies: dict[tuple, set[int]] = {}
    for e, target in halo(edges):
        copies.setdefault((e["page_id"], e["url"]), set()).add(target)
    sent = spark.createDataFrame([(*k, sorted(v)) for k, v in copies.items()], T.StructType([T.StructField("i", kinds["page_id"].dataType), T.StructField("u", T.StringType()), T.StructField("targets", T.ArrayType(T.IntegerType()))]))
    placed = ranged.crossJoin(F.broadcast(bounds)).withColumn("run", at(F.col("firsts"))).withColumn("home", place).drop("firsts", "runs", "run")
    placed = placed.join(F.broadcast(sent), F.col("page_id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u")), "left")
    ways = F.concat(F.array("home"), F.coalesce(F.array_except("targets", F.array("home")), F.array().cast("array<int>")))
    placed = placed.withColumn("range", F.explode(ways)).select(*order, "html", "range", (F.col("range") == F.col("home")).alias("own"))
    return placed.repartitionById(max(len(starts), 1), F.col("range")).sortWithinPartitions("range", *order).mapInArrow(extracted, result)
