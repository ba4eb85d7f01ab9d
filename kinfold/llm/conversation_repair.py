"""Cheapest repairs of conversations' turn structure, with the edits that make them.

A dynamic program reads a conversation's rows once.  Its four states say what the repaired turns end
with, and each keeps the cheapest audit, the string of edits so far.  Audits share their beginnings:
an audit is a node that points to the one it prolongs, with a rolling hash of the whole string and
ancestors 1, 2, 4, ... letters back.  Nodes are looked up by their hash and the match is verified, so
that equal audits are one node whatever the hashes do.  Of two audits with equal cost the ASCII-least
wins: their longest common prefix is found over the ancestors, and the next letters decide.  Two
different audits of one state and cost after the same row never prolong each other (the difference
would be insertions that lead back to the same state, which cost), so the winner stays the winner.

Conversations are sorted by Spark; a task reads one row after the other.  Nodes that all states
share are written out and forgotten, and long texts wait in an unnamed file, so that memory does not
grow with a conversation.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import gives_back, small_side
from kinfold.scratch import Scratch

BLANK = " \t\n\x0b\x0c\r"
#: Costs of edits, and of leaving a row whose text breaks off.
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: What the repaired turns end with: nothing, a system turn, a user's, an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: By state: that after a user's or assistant's turn is added.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Modulus and base of the rolling hash; nodes kept before shared ones are written out; bytes of a conversation held in memory.
MODULUS, BASE, NODES, SPOOL = (1 << 61) - 1, 1_000_003, 20_000, 4 << 20

AUDITS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "step long, edit string, role string, text string"


class Audits:
    """Strings that share their beginnings; a string is the number of its node, 0 the empty one."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]
        self.known: dict[int, list[int]] = {}

    def add(self, node: int, letter: str) -> int:
        """The string of node with one more letter; equal strings are one node."""
        code = (self.hash[node] * BASE + ord(letter)) % MODULUS
        same = self.known.setdefault(code, [])
        for found in same:  # a hash tells nothing for certain: the node before and the letter do
            if self.up[found][0] == node and self.letter[found] == letter:
                return found
        ancestors, k = [node], 0
        while len(self.up[ancestors[k]]) > k:
            ancestors.append(self.up[ancestors[k]][k])
            k += 1
        same.append(len(self.letter))
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(code)
        self.up.append(tuple(ancestors))
        return len(self.letter) - 1

    def back(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.up[node][k], steps - (1 << k)
        return node

    def split(self, a: int, b: int) -> tuple[int, int, int]:
        """The longest common prefix of two strings, and the nodes one letter on (the prefix itself where a string ends)."""
        low = min(self.depth[a], self.depth[b])
        x, y = self.back(a, self.depth[a] - low), self.back(b, self.depth[b] - low)
        if x == y:
            return x, *(x if self.depth[n] == low else self.back(n, self.depth[n] - low - 1) for n in (a, b))
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.up[x][k] != self.up[y][k]:
                x, y = self.up[x][k], self.up[y][k]
        return self.up[x][0], x, y

    def less(self, a: int, b: int) -> bool:
        prefix, x, y = self.split(a, b)
        return a != b and (x == prefix or y != prefix and self.letter[x] < self.letter[y])

    def text(self, node: int) -> str:
        found = []
        while node:
            found.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(found))


class Repair:
    """The cheapest audit of the rows given so far, for each state."""

    def __init__(self) -> None:
        self.trie, self.written, self.most = Audits(), [], NODES
        self.states: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert()

    def _best(self, a: tuple[int, int] | None, b: tuple[int, int, str] | None) -> tuple[int, int] | None:
        """The better of a state and (cost, audit, letter to add)."""
        if b is None or a is not None and a[0] < b[0]:
            return a
        new = (b[0], self.trie.add(b[1], b[2]))
        return new if a is None or new[0] < a[0] or self.trie.less(new[1], a[1]) else a

    def _insert(self) -> None:
        for before in (NOTHING, SYSTEM, ASSISTANT, USER):  # an assistant's turn can follow the inserted user's
            if at := self.states[before]:
                self.states[NEXT[before]] = self._best(self.states[NEXT[before]], (at[0] + INSERT, at[1], "I"))

    def row(self, initial: str, fault: str) -> None:
        """Adds a row by its role's first letter and its fault (blank, duplicate, truncated or none)."""
        new: list[tuple[int, int] | None] = [None] * 4
        extra = BROKEN if fault == "truncated" else 0
        for state, at in enumerate(self.states):
            if at is None:
                continue
            cost, audit = at
            if fault not in ("blank", "duplicate"):
                after = NEXT[state]
                keeps = initial == ("u" if after == USER else "a")
                new[after] = self._best(new[after], (cost + extra + (0 if keeps else REROLE), audit, "K" if keeps else "R"))
                if initial == "s" and state == NOTHING:
                    new[SYSTEM] = self._best(new[SYSTEM], (cost + extra, audit, "K"))
            new[state] = self._best(new[state], (cost + DELETE, audit, "D"))
        self.states = new
        self._insert()
        if len(self.trie.letter) > self.most:
            self._forget()

    def _forget(self) -> None:
        """Writes out what all states' audits begin with, and keeps only the rest of them."""
        live, old = [at for at in self.states if at], self.trie
        shared = live[0][1]
        for _, node in live[1:]:
            shared = old.split(shared, node)[0]
        self.written.append(old.text(shared))
        self.trie, states = Audits(), []
        for at in self.states:
            node = 0
            for letter in old.text(at[1])[old.depth[shared] :] if at else "":
                node = self.trie.add(node, letter)
            states.append(at and (at[0], node))
        self.states, self.most = states, max(NODES, 2 * len(self.trie.letter))

    def result(self) -> tuple[int, str]:
        """Cost and audit of the cheapest repair; of equal ones the ASCII-least."""
        ends = [at for at in (self.states[NOTHING], self.states[ASSISTANT]) if at]
        cost = min(at[0] for at in ends)
        return cost, "".join(self.written) + min(self.trie.text(at[1]) for at in ends if at[0] == cost)


class Conversation:
    """What is known of one conversation while its rows arrive in order."""

    def __init__(self, conv_id: object):
        self.conv_id, self.repair, self.rows = conv_id, Repair(), 0
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.least, self.last = 0, None, None
        self.before: tuple | None = None
        self.texts = tempfile.SpooledTemporaryFile(max_size=SPOOL)

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """seen: the same role and text stand in a row with a lower turn."""
        bare = text.strip(BLANK)
        same = self.before == (turn, role, text)
        fault = "blank" if not bare else "duplicate" if seen or same else "truncated" if bare[-1] not in ".!?" else "none"
        if fault != "none":
            self.count[fault] += 1
        if self.before and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.repair.row(role[:1], fault)
        self.before, self.rows = (turn, role, text), self.rows + 1
        parts = role.encode(), text.encode()
        self.texts.write(struct.pack("<qq", *map(len, parts)) + parts[0] + parts[1])

    def edits(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of each step; of a deleted row as they were."""
        self.texts.seek(0)
        state = NOTHING
        for letter in audit:
            role, text = "", ""
            if letter != "I":
                n, m = struct.unpack("<qq", self.texts.read(16))
                role, text = self.texts.read(n).decode(), self.texts.read(m).decode()
            if letter == "K" and state == NOTHING and role[:1] == "s":
                state = SYSTEM
            elif letter != "D":
                state = NEXT[state]
                role = role if letter == "K" else ROLES[state]
            yield letter, role, text

    def gaps(self) -> int:
        return 0 if self.last is None else self.last - self.least + 1 - self.turns


def digest(found: Conversation) -> Iterator[tuple]:
    """One row of AUDITS; the repaired conversation is its role:text lines."""
    cost, audit = found.repair.result()
    total, first = hashlib.sha256(), True
    for letter, role, text in found.edits(audit):
        if letter != "D":
            total.update((b"" if first else b"\n") + role.encode() + b":")
            total.update(text.encode())
            first = False
    yield found.gaps(), *found.count.values(), cost, audit, total.hexdigest()


def steps(found: Conversation) -> Iterator[tuple]:
    """A row of EDITS for each edit, in order."""
    for step, edit in enumerate(found.edits(found.repair.result()[1])):
        yield step, *edit


def repaired(rows: DataFrame, finish: Callable[[Conversation], Iterator[tuple]] = steps, schema: str = EDITS, gone: Column | None = None) -> DataFrame:
    """conv_id and what finish makes of each conversation: by default its edits, one row each.

    Needs conv_id, turn (whole number), role and text; other columns are not read.  A conversation
    is its rows by turn (nulls first; rows of one turn by role, then text, so that repeated rows are
    neighbours).  Null conv_ids are one conversation; null role or text is one space.  Empty texts
    are blank.  Rows for which gone holds only keep their conversation in the result; one without
    other rows is repaired to nothing at no cost.  An empty table gives none.

    Rows with the same role and text at an earlier turn are found by their SHA-256; a task then reads
    its conversations' rows as Spark has sorted them.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    kind = rows.schema["conv_id"].dataType.simpleString()
    own = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), own.alias("gone"))
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    plain = scratch.save(plain.withColumn("content", F.unhex(F.sha2(F.concat_ws("\x00", name, F.length("role").cast("string"), "role", "text"), 256))), "rows")
    turn = F.struct("turn")
    again = plain.filter("NOT gone").groupBy("content").agg(F.min(turn).alias("first"), F.max(turn).alias("final")).filter("first != final")
    again = scratch.save(again.select("content", "first"), "again")
    seen = F.col("first").isNotNull() & (F.col("first") != turn)
    told = plain.join(small_side(again, again.count()), "content", "left").select("conv_id", "turn", "role", "text", "gone", seen.alias("seen"))
    placed = told.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, names = None, [], None
        for batch in batches:
            for conv_id, at, role, text, dropped, is_seen in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        out += ((now.conv_id, *row) for row in finish(now))
                        now.texts.close()
                        if len(out) > 2000:
                            yield as_batch(out)
                            out = []
                    now = Conversation(conv_id)
                if not dropped:
                    now.add(at, role, text, is_seen)
        if now:
            for row in finish(now):
                out.append((now.conv_id, *row))
                if len(out) > 2000:
                    yield as_batch(out)
                    out = []
            now.texts.close()
        if out:
            yield as_batch(out)

    target = rows.sparkSession.createDataFrame([], f"conv_id {kind}, {schema}").schema
    arrow = _arrow(target)

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return placed.mapInArrow(read, target)


def _arrow(schema: object) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """rows with faults by the CRC-32 of conv_id:turn, and which of them are gone.

    Of 20 values 0 drops a row, 1 empties its text, 2 takes its full stops, question and exclamation
    marks, 3 repeats it, and 4 makes the user speak.  Nulls count as one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    out = out.withColumns(
        {
            "text": F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role")),
            "copies": F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
        }
    )
    return out, F.col("fate") == 0
