from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from kinfold.llm import conversation_repair as cr
from kinfold.llm import queries
from kinfold.llm.sql import ORACLE_SQL

GOOD = re.compile(r"(s?(ua)+)?")


def all_repairs(rows):
    """Cost and audit of the cheapest repair of (initial, fault) rows: every audit with up to four insertions is tried."""
    found = []

    def go(i, cost, audit, roles, inserted):
        if cost > 2 * len(rows) + 5 * len(rows):
            return
        if i == len(rows) and GOOD.fullmatch(roles):
            found.append((cost, audit))
        if inserted < 4:
            for r in "ua":
                go(i, cost + 5, audit + "I", roles + r, inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", roles, inserted)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                go(i + 1, cost + extra, audit + "K", roles + initial, inserted)
                for r in "ua":
                    go(i + 1, cost + extra + 1, audit + "R", roles + r, inserted)

    go(0, 0, "", "", 0)
    return min(found)


def test_audits_are_the_least_of_all():
    rng = random.Random(3)
    cases = [[]] + [[(rng.choice("suatua"), rng.choice(["none", "none", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(1, 5))] for _ in range(150)]
    for rows in cases:
        repair = cr.Repair()
        for row in rows:
            repair.row(*row)
        assert repair.result() == all_repairs(rows), rows


def by_strings(rows):
    """The same dynamic program with whole strings."""
    states = {0: (0, ""), 2: (5, "I"), 3: (10, "II")}
    for initial, fault in rows:
        new = {}

        def offer(state, cost, audit, new=new):
            new[state] = min(new.get(state, (cost, audit)), (cost, audit))

        extra = 5 if fault == "truncated" else 0
        for q, (c, a) in states.items():
            offer(q, c + 2, a + "D")
            if fault not in ("blank", "duplicate"):
                for after, r in ((2, "u"),) if q != 2 else ((3, "a"),):
                    offer(after, c + extra + (initial != r), a + ("K" if initial == r else "R"))
                if q == 0 and initial == "s":
                    offer(1, c + extra, a + "K")
        for q, after in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if q in new:
                offer(after, new[q][0] + 5, new[q][1] + "I")
        states = new
    return min(states[q] for q in (0, 3) if q in states)


@pytest.mark.parametrize(("nodes", "modulus"), [(20_000, cr.MODULUS), (50, cr.MODULUS), (50, 7)])
def test_long_audits_with_few_nodes_and_colliding_hashes(monkeypatch, nodes, modulus):
    monkeypatch.setattr(cr, "NODES", nodes)
    monkeypatch.setattr(cr, "MODULUS", modulus)
    rng = random.Random(5)
    for n in (3, 40, 700):
        rows = [(rng.choice("suatua"), rng.choice(["none", "none", "truncated", "blank", "duplicate"])) for _ in range(n)]
        repair = cr.Repair()
        repair.most = nodes
        for row in rows:
            repair.row(*row)
        assert repair.result() == by_strings(rows)


def test_prefix_search():
    audits = cr.Audits()
    strings = ["".join(x) for n in range(6) for x in itertools.product("DIK", repeat=n)]
    nodes = {}
    for s in strings:
        node = 0
        for c in s:
            node = audits.add(node, c)
        nodes[s] = node
        assert audits.text(node) == s
    rng = random.Random(1)
    for _ in range(3000):
        a, b = rng.choice(strings), rng.choice(strings)
        assert audits.less(nodes[a], nodes[b]) == (a < b)


CONV = "conv_id long, turn long, role string, text string, audit string, seen boolean"


def test_edges(spark):
    long = "word. " * 1_000_000
    rows = [
        (1, 0, "user", "hi."), (1, 1, "assistant", long),
        (2, None, None, None), (2, None, "user", "a?"), (2, 4, "user", "a?"), (2, 4, "assistant", "b"), (2, 4, "assistant", "b"),
        (None, 1, "system", "s."), (None, 2, "user", "x!"), (None, 3, "assistant", "y!"),
        (3, 7, "", ""),
        (4, 2, "system", "s."), (4, 2, "system", "s."),
    ]
    df = spark.createDataFrame([(*r, "z", True) for r in rows], CONV)
    got = {r.conv_id: r for r in cr.repaired(df, cr.digest, cr.AUDITS).collect()}
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].audit, got[1].cost, got[1].repaired_sha256) == ("KK", 0, h(f"user:hi.\nassistant:{long}"))
    # null role and text are a space; nulls come first; the second "a?" and the second "b" are duplicates
    assert (got[2].blank, got[2].duplicate, got[2].truncated, got[2].gaps) == (1, 2, 1, 0)
    assert (got[2].audit, got[2].cost) == ("DDDDD", 10) and got[2].repaired_sha256 == h("")
    assert (got[None].audit, got[None].illegal) == ("KKK", 0)
    assert (got[3].audit, got[3].cost, got[3].blank) == ("D", 2, 1)
    assert (got[4].duplicate, got[4].illegal, got[4].audit) == (1, 1, "DD")
    steps = [(r.step, r.edit, r.role, r.text) for r in cr.repaired(df).filter("conv_id IS NULL").orderBy("step").collect()]
    assert steps == [(0, "K", "system", "s."), (1, "K", "user", "x!"), (2, "K", "assistant", "y!")]
    assert cr.repaired(df.filter("conv_id > 99"), cr.digest, cr.AUDITS).count() == 0


def test_one_long_conversation_equals_sql(spark, tables, monkeypatch):
    import duckdb

    rng = random.Random(8)
    words = ["yes.", "no", " ", "why?", "go on!", "well,"]
    rows = [(7 if i % 3 == 0 else i // 5, rng.randrange(60), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(words) + rng.choice(["", f" {i}", f" {i}."])) for i in range(400)]
    place = tables(conversations=spark.createDataFrame(rows, CONV.rpartition(", audit")[0]).distinct())
    got = queries.op13_conversation_repair(spark, place)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{place}/conversations.parquet/*.parquet'")
    wanted = con.sql(ORACLE_SQL["op13_conversation_repair"])
    assert sorted(map(repr, map(tuple, got.select(*wanted.columns).collect()))) == sorted(map(repr, wanted.fetchall()))
