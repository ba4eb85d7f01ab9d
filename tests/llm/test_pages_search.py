from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from kinfold.llm import html_extract, ngram_join, queries, topk, url_filter
from kinfold.llm.html_extract import Line, extract, lines_of, shared


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = (["abcd"[rng.randrange(4)] for _ in range(rng.randint(0, 9))] for _ in "ab")
        marks = shared(a, b)
        kept, rest = [x for x, m in zip(a, marks, strict=True) if m], iter(b)
        assert all(x in rest for x in kept) and len(kept) == common(a, b)


PAGE = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class="ad">Buy!</div>
<article><h1>Big   &amp;\n title</h1><p>One<b>two</b> <i>three</i>&nbsp;x<br><p>Next &lt;p&gt; &#233;<aside>side</aside><div id="cookie-notice">ok?</div>
<table><tr><td>a<td>b</table><form><p>mail</form></article><section class="comments"><p>first!</p></section><footer>&copy; us"""


def test_article_of_a_page():
    assert extract(lines_of(PAGE), []) == "Big & title\nOnetwo three x\nNext <p> é\na b"


def test_shared_lines_go_where_no_element_tells():
    page = lambda *body: "<body>" + "".join(f"<p>{x}</p>" for x in ("Menu", *body, "Imprint")) + "</body>"
    a, b = lines_of(page("only a", "both")), lines_of(page("only b", "both", "more b"))
    assert extract(a, [b]) == "only a" and extract(b, [a]) == "only b\nmore b"
    assert extract(a, [a, b]) == "only a"  # a copy says nothing
    assert extract(a, [a]) == extract(a, []) == "Menu\nonly a\nboth\nImprint"
    assert extract([Line("x", "not")], []) == ""


def test_alignment_decides_unmarked_lines_beside_an_article():
    page = lambda body, card: lines_of(f"<p>Menu</p><div><p>{body}</p></div><article>{card}</article><nav>x</nav><p>Imprint</p>")
    a, b = page("body of a", "card"), page("body of b", "card")
    assert extract(a, [b]) == "body of a\ncard" and extract(b, [a]) == "body of b\ncard"


def test_only_whole_names_mark_and_never_what_holds_the_article():
    for before, after in (("<div class='layout has-sidebar'>", "</div>"), ("<div class=with-related>", "</div>"), ("<div class='comments-open'>", "</div>"), ("<div id='sidebar'>", "</div>"), ("<form action=x>", "</form>"), ("<header><main>", "</main></header>"), ("<div hidden>", "</div>")):
        assert extract(lines_of(f"<nav>Home</nav>{before}<article><h1>Title</h1><p>text</article>{after}<div class='site_footer'>us</div>"), []) == "Title\ntext"
    assert extract(lines_of('<article><div class="entry-header"><h1>T</h1></div><div class=header>H</div><p title="the hidden gem">gem<p data-x=\'a class="ad"\'>x<p hidden>no<p class="big ad">no</article>'), []) == "T\nH\ngem\nx"
    others = "<aside><article>card</article></aside><div class='comments'><article>first!</article></div>"
    assert extract(lines_of(f"<div class=sidebar><article>one</article></div><article>two</article>{others}"), []) == "one\ntwo"


def test_neighbours_lie_beyond_copies_and_range_edges(spark):
    page = lambda *body: "".join(f"<p>{x}</p>" for x in ("Menu", *body, "Imprint"))
    bodies = [("same",)] * 12 + [("copied", "today"), ("copied", "yesterday"), ("z",), ("same",), ("y",), ("x",)]
    rows = [(i, f"http://a.b/{i:02}", page(*x)) for i, x in enumerate(bodies)] + [(90, "http://c.d/", page("alone"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 3, 19):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == {i: "\n".join(x) for i, x in enumerate(bodies)} | {90: "Menu\nalone\nImprint"}


def test_ids_of_headings_do_not_mark_inside_an_article():
    page = '<article><h2 id="menu" class="related">The menu</h2><section id="related-work"><p id="notice">Work</p></section><section id="related"><h3 class="ad">Kin</h3></section><div class="related">No</div></article>'
    assert extract(lines_of(page), []) == "The menu\nWork\nKin"


def by_hand(rows):
    """Texts by a plain statement of the rule: LCS by a full table with the NEAR other contents on each side."""
    from urllib.parse import urlsplit

    def marks(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        out, i, j = [False] * len(a), 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out[i] = True
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    hosts = {}
    for i, url, page in rows:
        hosts.setdefault(urlsplit(url).netloc, []).append((urlsplit(url).path, url, i, [x for x in lines_of(page) if x.kind != "not"]))
    found = {}
    for pages in hosts.values():
        pages.sort(key=lambda p: p[:3])
        for at, (_, _, i, own) in enumerate(pages):
            others = []
            for side in (pages[:at][::-1], pages[at + 1 :]):
                near = []
                for *_, lines in side:
                    if lines != own and lines not in near and len(near) < html_extract.NEAR:
                        near.append(lines)
                others += near
            mine = [x.text for x in own]
            shares = [m for m in (marks(mine, [x.text for x in o]) for o in others if [x.text for x in o] != mine)]
            if len(shares) < 3:
                shares = [m for m in shares if not all(m)]
            keep = [x.kind == "main" or 2 * sum(m[k] for m in shares) <= len(shares) or not shares for k, x in enumerate(own)]
            found[i] = "\n".join(x.text for x, k in zip(own, keep, strict=True) if k)
    return found


def test_pages_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        host = rng.choice(["a.b", "c.d", "e.f", "alone.x" if i == 7 else "a.b"])
        body = [f"<p>{host} menu</p>", f"<div>{host} top {rng.randrange(2)}</div>"] + [f"<p>body {rng.randrange(40)} of page</p>" for _ in range(rng.randint(0, 5))] + [f"<p>{host} imprint</p>"]
        if rng.random() < 0.5:
            body.insert(2, f"<article><h1>t {rng.randrange(30)}</h1><p>{host} imprint</p></article>")
        rows.append((i, f"http://{host}/{rng.randrange(60):03}", "".join(body)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == by_hand(rows)


def test_pages(spark):
    rows = [(1, "http://a.b/x/1", PAGE), (2, "http://a.b/x/2", PAGE), (3, None, None), (4, "no scheme", ""), (5, "http://a.b/y", "<p>" + "long " * 200_000), (1, "http://a.b/x/1", PAGE), (None, "http://c/", "<!-- never closed <p>x")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = html_extract.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.url or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    for r in got:
        assert r.n_chars == len(r.text)
        assert r.text == (extract(lines_of(PAGE), []) if r.page_id in (1, 2) else ("long " * 200_000).strip() if r.page_id == 5 else "")
    assert html_extract.extract_pages(df.filter("page_id < 0")).count() == 0


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), rest[cut:].split("?")[0].split("#")[0]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.com", "www.example.com", "EXAMPLE.com", "myexample.com", "a.net", "net", "x.y.net", "é.org", "com", "", ".com", "u@example.com:80"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/x', '/fr/?q=/en/', '#a', '?x', '/de/://'])}" for _ in range(400)] + [None, "", "nothing", "http:/half", "://", "http://a.com/" + "p" * 50_000]
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, queries.RULES).collect()}
    assert got == {i: judge(u, queries.RULES) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.filter("page_id < 0"), queries.RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, [], default="block").collect()} == {"block"}


def test_long_hosts_cost_no_more_than_rules_do(spark):
    table = url_filter.Digests(url_filter.Digests.pack(queries.RULES))
    import pandas as pd

    host = "a." * 200_000 + "example.com"
    looked_up = []
    real = url_filter.xxhash.xxh64_intdigest
    url_filter.xxhash.xxh64_intdigest = lambda s: looked_up.append(len(s)) or real(s)
    try:
        assert table.judge(pd.Series([host]), pd.Series(["/en/" + "x" * 100_000])) == (["example.com/en/"], ["block"])
    finally:
        url_filter.xxhash.xxh64_intdigest = real
    assert len(looked_up) <= 12 and max(looked_up) < 40


def test_url_digest_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 5)
    table = url_filter.Digests(url_filter.Digests.pack(queries.RULES))
    import pandas as pd

    assert table.judge(pd.Series(["example.com", "b.org"]), pd.Series(["/en/1", "/"]))[0] == ["example.com/en/", None]
    assert [v for v, _, _ in url_filter.Digests.pack([url_filter.Rule("block", "a", "/"), url_filter.Rule("allow", "A", "/")])[1]] == ["block"]
    with pytest.raises(ValueError, match="bytes of URL rules"):
        monkeypatch.setattr(url_filter, "MAX_BYTES", 3)
        url_filter.Digests.pack(queries.RULES)


def neighbours(rows, k):
    valid = [(n, i, [math.floor(64 * Fraction(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in valid:
        if i is not None and i % 20 == 0:
            scores = sorted((-max(-topk.LARGEST, min(topk.LARGEST, sum(a * b for a, b in zip(v, w, strict=False)))), j is None, j or 0) for m, j, w in valid if m != n)
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)] + [(200 + i, [1.0] * 8) for i in range(60)]
    rows += [(310, [1e307] * 8), (311, [-1e307] + [0.5] * 7), (320, [1e-3] * 8)]
    rows += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (20, [1.0] * 8), (20, [1.0] * 8), (None, [2.0] * 8), (304, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    monkeypatch.setattr(topk, "TILE_ROWS", 32)
    for numbers in (1 << 20, 16):
        monkeypatch.setattr(topk, "BLOCK_NUMBERS", numbers)
        got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect()), key=repr)
        assert got == neighbours(rows, 20)
    assert topk.top_k(df.filter("vec_id < 0")).count() == 0
    assert topk.top_k(df.filter("vec_id = 40")).count() == 0


def test_products_beyond_floating_point():
    q, x = np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 5.0], [2.0**70, 0.0], [0.0, 1.5e308]])
    assert topk.products(q, x, 1).tolist() == [[2**60 + 15, topk.LARGEST, topk.LARGEST]]
    assert topk.products(np.array([[1e307, 0.25]]), np.array([[0.0, 0.5]])).tolist() == [[16 * 32]]


def near(seed):
    """Texts with copies and edits at many similarities; a base with many close variants; short and empty ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(30))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    base = [word() for _ in range(150)]
    for i in range(330):
        t = list(base)
        t[i % 150] = word()
        rows.append(" ".join(t))
    rows += ["", None, " \n", "one two", "one two", "one  two", "a b c d e", "w " * 50_000, "w " * 50_000]
    return [(i if i % 97 else None, t) for i, t in enumerate(rows)] + [(3, rows[3]), (3, rows[3])]


def joined_by_hand(rows):
    """(doc_id, class_id, n_links) of every row, and the number of classes, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(rows[i][0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], smallest[find(i)], links[i]) for i in range(n)), key=by_id), len(members)


def by_id(r):
    return r[0] is None, r[0] or 0, repr(r[1:])


@pytest.mark.parametrize("limits", [{}, {"FULL": 6, "WHOLE": 20, "BLOCK": 16}])
def test_ngram_join_equals_brute_force(make, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = near(4)
    wanted, classes = joined_by_hand(rows)
    found = ngram_join.groups(make(rows)).collect()
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=by_id)
    missed = sum(a != b for a, b in zip(got, wanted, strict=True))
    assert missed <= 0.01 * len(rows)  # the forest's recall is 0.999 at the threshold
    assert sum(r.stays for r in found) == pytest.approx(classes, abs=2)
    assert all(r.doc_id == r.class_id for r in found if r.stays)


def chain(n):
    """Texts that share half of their words with the next ones: a chain of candidates, with close copies here and there."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40 * n + 200)]
    rows = [(i, " ".join(words[40 * i : 40 * i + 160])) for i in range(n)]
    return rows + [(n + i, rows[7 * i][1] + " more") for i in range(n // 8)]


def test_a_chain_of_candidates_is_verified_by_nodes(make, spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "WHOLE", 20)
    rows = chain(200)
    seen = []
    real = ngram_join._tiles
    monkeypatch.setattr(ngram_join, "_tiles", lambda wanted, width: seen.append(real(wanted, width)) or seen[-1])
    found = ngram_join.groups(make(rows)).collect()
    wanted, _ = joined_by_hand(rows)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=by_id) == wanted
    wide = ngram_join.groups(make(rows), recall=0.999999).collect()  # shorter prefixes, more candidates, the same links
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in wide), key=by_id) == wanted


def test_full_nodes_are_deepened_only_while_the_recall_holds():
    assert ngram_join.prefix_length(0.8, 20, 8, 0.999) == 5 and ngram_join.spare_trees(0.8, 20, 5, 8, 0.999) == 4
    assert ngram_join.recall_of(0.8, [8] * 4 + [5] * 16) >= 0.999 > ngram_join.recall_of(0.8, [8] * 5 + [5] * 15)
    assert ngram_join.spare_trees(0.8, 3, 5, 8, 0.999) == 0


def test_ngram_join_edges(make):
    assert ngram_join.groups(make([]).filter("doc_id < 0")).count() == 0
    docs = make([(9, "p q r s t u"), (4, "p q r s t u"), (5, None)])
    kept = ngram_join.dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5] and kept.columns == docs.columns
    assert ngram_join.prefix_length(0.8, 20, 8, 0.999) == 5
    for length in (1, 5, 8):
        assert {len(x) for x in ngram_join.signatures(np.arange(1, 50, dtype=np.uint64), length)} == {ngram_join.TREES}


def test_tiles_equal_one_block(make, monkeypatch):
    rows = near(4)[200:420]
    whole = {(r.doc_id, r.n_links, r.class_id) for r in ngram_join.groups(make(rows)).collect()}
    monkeypatch.setattr(ngram_join, "WHOLE", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    assert {(r.doc_id, r.n_links, r.class_id) for r in ngram_join.groups(make(rows)).collect()} == whole
