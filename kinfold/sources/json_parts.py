"""The elements of JSON files of any size, found by all tasks at once.

Spark reads a file in splits, cut after closing braces, and tasks join these to blocks.  What a block
means depends on where it begins: inside a text or not, and how deep.  Each block is saved with its
effect for both beginnings (whether it leaves the text state as it found it, how much deeper it
ends), and the effects are composed over the blocks of a file, which are few.  With the state that
each block begins in, it is cut at the file's outer brackets and commas.  A piece of text between two
cuts that lies in one block is complete; those that blocks divide are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.operators.components import counted_side
from kinfold.scratch import Scratch
from kinfold.sources.files import FILE, empty_files

QUOTE, ESCAPE, COMMA = b'"\\,'
OPENS, CLOSES = b"[{", b"]}"
BLANK, INVALID = r"^[\x{FEFF} \t\r\n]*$", "no valid JSON"
#: A member's name and colon; its value follows.
MEMBER = r'^[ \t\r\n]*"((?:[^"\\]|\\.)*)"[ \t\r\n]*:'
#: Bytes of a block, and what may stand before a file's first character.
BLOCK_BYTES, BOM = 4_000_000, b"\xef\xbb\xbf"
#: A part of a file: the offset of its split, its number there, its bytes and effect, its first character that is no blank, the size of the whole file.
BLOCKS = f"{FILE} string, start long, block int, data binary, turns boolean, deeper_outside long, deeper_inside long, first string, size long"
#: A piece: what is cut off before it (null at a block's beginning), how deep it stands, its text; its number and its member's in the block; whether it begins and ends with a cut; at a block's end, what is open there.
PIECES = f"{FILE} string, start long, block int, n long, member long, lead string, level int, text string, begins boolean, ends boolean, still_open boolean"


def quotes(data: np.ndarray) -> np.ndarray:
    """1 at each quotation mark that opens or closes a text: no odd number of backslashes stands before it."""
    real = (data == QUOTE).astype(np.int8)
    slash = data == ESCAPE
    if slash.any():
        at = np.flatnonzero(real)
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))  # the last place that has no backslash
        before = np.where(at > 0, at - 1 - plain[at - 1], 0)
        real[at[before % 2 == 1]] = 0
    return real


def steps(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """1 for a bracket that opens, -1 for one that closes, outside of texts."""
    step = np.isin(data, np.frombuffer(OPENS, np.uint8)).astype(np.int8) - np.isin(data, np.frombuffer(CLOSES, np.uint8))
    return np.where(outside, step, 0)


@dataclass
class Effect:
    """What a stretch of a file does to the state before it, by whether it begins outside or inside a text."""

    turns: bool
    deeper: tuple[int, int]

    @staticmethod
    def of(data: np.ndarray) -> Effect:
        odd = np.cumsum(quotes(data), dtype=np.int32) & 1
        return Effect(bool(len(odd) and odd[-1]), (int(steps(data, odd == 0).sum()), int(steps(data, odd == 1).sum())))

    def then(self, after: Effect) -> Effect:
        return Effect(self.turns ^ after.turns, tuple(self.deeper[inside] + after.deeper[inside ^ self.turns] for inside in (0, 1)))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS from a scan's rows (file, start, size, bytes without the brace that ends them), as a task reads them."""
    key, held, size, number = None, [], 0, 0

    def block() -> pa.RecordBatch:
        data = b"".join(held)
        effect = Effect.of(np.frombuffer(data, np.uint8))
        first = data.lstrip(b" \t\r\n")[:1] if number or key[1] else data.removeprefix(BOM).lstrip(b" \t\r\n")[:1]
        return _batch([(*key[:2], number, data, effect.turns, *effect.deeper, first.decode("latin-1") or None, key[2])], BLOCKS)

    for batch in batches:
        for *now, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (now != key or size > BLOCK_BYTES):
                yield block()
                held, size, number = [], 0, number + 1
            if now != key:
                key, number = now, 0
            held += [text, b"}"]
            size += len(text) + 1
    if held:
        yield block()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECES of blocks that also have inside, depth, top (the file's first character) and cut_brace (the last byte is none of the file's)."""
    for batch in batches:
        for file, start, block, data, inside, depth, top, cut_brace in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(data, np.uint8)
            data = data[: len(data) - cut_brace]
            odd = (np.cumsum(quotes(data), dtype=np.int32) + inside) & 1
            outside = odd == 0
            step = steps(data, outside)
            after = depth + np.cumsum(step, dtype=np.int64)
            most = 2 if top == "{" else 1
            # brackets that lead to or from a depth up to most, and commas there
            cut = np.flatnonzero(((step > 0) & (after <= most)) | ((step < 0) & (after < most)) | ((data == COMMA) & outside & (after <= most) & (after > 0)))
            still = bool(len(data) and (after[-1] or odd[-1])) if len(data) else bool(depth or inside)
            rows, member = [(file, start, block, 0, 0, None, None, _text(data[: cut[0] if len(cut) else None]), False, len(cut) > 0, still)], 0
            for i, place in enumerate(cut.tolist()):
                lead, level = chr(data[place]), int(after[place])
                member += top == "{" and level == 1 and lead in "{,"
                rows.append((file, start, block, i + 1, member, lead, level, _text(data[place + 1 : cut[i + 1] if i + 1 < len(cut) else None]), True, i + 1 < len(cut), still))
            for a in range(0, len(rows), 20_000):
                yield _batch(rows[a : a + 20_000], PIECES)


def _text(data: np.ndarray) -> str:
    return data.tobytes().decode("utf-8", "replace")


def pieces(spark: SparkSession, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The pieces of all files below a path (FILE, n, member, lead, level, text), n from 0 in each file; and the files: FILE, top, ended (every bracket and text closes)."""
    meta = F.col("_metadata")
    scanned = spark.read.text(path, lineSep="}", wholetext=False, recursiveFileLookup=True)
    scanned = scanned.select(meta["file_path"].alias(FILE), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("data"))
    blocks = scratch.save(scanned.mapInArrow(_blocks, BLOCKS), "blocks")
    # effects composed over the blocks of a file: the state that each begins in
    order = Window.partitionBy(FILE).orderBy("start", "block")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(FILE)
    inside = F.coalesce(F.sum(F.col("turns").cast("int")).over(so_far), F.lit(0)) % 2
    deeper = F.when(F.col("inside") == 1, F.col("deeper_inside")).otherwise(F.col("deeper_outside"))
    states = blocks.withColumn("bytes", F.octet_length("data")).drop("data").withColumn("inside", inside.cast("int")).withColumn("deeper", deeper)
    states = states.withColumn("depth", F.coalesce(F.sum("deeper").over(so_far), F.lit(0)))
    states = states.withColumn("top", F.min_by("first", F.when(F.col("first").isNotNull(), F.struct("start", "block"))).over(whole))
    # a file that does not end with a brace has got one too many; a byte order mark (3 bytes) may not have been read
    more = F.sum("bytes").over(whole) - F.col("size")
    states = states.withColumn("cut_brace", (F.lead("start").over(order).isNull() & more.isin(1, -2)).cast("int"))
    key = [FILE, "start", "block"]
    states = scratch.save(states.select(*key, "inside", "depth", F.coalesce("top", F.lit("")).alias("top"), "cut_brace"), "states")
    told = blocks.select(*key, "data").join(counted_side(states), key)
    found = scratch.save(told.select(*key, "data", "inside", "depth", "top", "cut_brace").mapInArrow(_pieces, PIECES), "pieces")
    scratch.drop("blocks")
    # numbers in the block become numbers in the file
    sizes = found.groupBy(*key).agg(F.max("n").alias("n"), F.max("member").alias("member"), F.first("still_open").alias("still_open"))
    firsts = sizes.select(*key, "still_open", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"before_{c}") for c in ("n", "member")))
    firsts = scratch.save(firsts, "firsts")
    ends = firsts.groupBy(FILE).agg(F.max_by("still_open", F.struct("start", "block")).alias("open"))
    about = states.groupBy(FILE).agg(F.first("top").alias("top")).join(ends, FILE).select(FILE, "top", (~F.col("open")).alias("ended"))
    placed = found.join(counted_side(firsts.drop("still_open")), key)
    placed = placed.withColumns({c: F.col(c) + F.col(f"before_{c}") for c in ("n", "member")})
    complete = F.col("begins") & F.col("ends")
    parts = placed.filter(~complete).groupBy(FILE, "n").agg(F.sort_array(F.collect_list(F.struct("start", "block", "member", "begins", "lead", "level", "text"))).alias("parts"))
    head = F.get("parts", F.lit(0))  # the part with the cut: no other of this number comes before it
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    parts = parts.select(FILE, "n", head["member"].alias("member"), head["lead"].alias("lead"), head["level"].alias("level"), joined.alias("text"))
    return placed.filter(complete).select(*parts.columns).unionByName(parts), about


def _key(name: str) -> Column:
    """The name of a member as JSON writes it, read."""
    return F.try_parse_json(F.concat(F.lit('"'), F.regexp_extract(name, MEMBER, 1), F.lit('"'))).cast("string")


def one_value(name: str) -> Column:
    """The value that a text consists of; null if it is no JSON, or more than one value."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.regexp_replace(name, r"^\x{FEFF}", ""), F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))


def records(spark: SparkSession, path: str, scratch: Scratch, wrappers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """_records() with the rule that of repeated names in an object the last counts."""
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        return _records(spark, path, scratch, wrappers)
    finally:
        spark.conf.set(setting, before)


def _records(spark: SparkSession, path: str, scratch: Scratch, wrappers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The records of all exports below a path (FILE, pos, v), saved, and the files that give none (FILE, reason).

    An export is a list of records, an object that has such a list as its first member of one of
    these names (of repeated names the last counts), or one record.  A file that is no valid JSON as a
    whole gives no records, as a reader of whole files would have it: elements and members are parsed one by
    one, and what stands between them is checked.
    """
    found, about = pieces(spark, path, scratch)
    every = scratch.save(found.join(counted_side(scratch.save(about, "about")), FILE), "every")
    scratch.drop("pieces")
    is_blank, in_list, in_object = F.col("text").rlike(BLANK), F.col("top") == "[", F.col("top") == "{"
    opens = F.col("lead").isin("[", ",")
    # members of outer objects: their names, and what brackets hold their values
    heads = every.filter(in_object & (F.col("level") == 1) & F.col("lead").isin("{", ",")).select(FILE, "member", _key("text").alias("key"))
    kinds = every.filter(in_object & (F.col("level") == 2) & F.col("lead").isin("[", "{")).groupBy(FILE, "member").agg(F.min_by("lead", "n").alias("bracket"), F.min("n").alias("first"))
    members = scratch.save(heads.join(kinds, [FILE, "member"], "left"), "members")
    last = members.groupBy(FILE, "key").agg(F.max_by(F.struct("member", "bracket", "first"), "member").alias("m")).filter("m.bracket = '['")
    rank = F.array_position(F.array(*map(F.lit, wrappers)), F.col("key"))
    chosen = last.filter(rank > 0).groupBy(FILE).agg(F.min_by("m", rank).alias("m")).select(FILE, F.col("m.member").alias("chosen"))
    chosen = counted_side(scratch.save(chosen, "chosen"))
    of_members = every.filter(in_object).join(counted_side(members.select(FILE, "member", "bracket", "first")), [FILE, "member"], "left").join(chosen, FILE, "left")
    listed = every.filter(in_list & (F.col("level") == 1) & opens).select(FILE, F.lit(0).cast("long").alias("member"), (F.col("n") - 1).alias("pos"), "text", F.lit(True).alias("wanted"))
    wrapped = of_members.filter(F.col("chosen").isNotNull() & (F.col("bracket") == "[") & (F.col("level") == 2) & opens)
    wrapped = wrapped.select(FILE, "member", (F.col("n") - F.col("first")).alias("pos"), "text", (F.col("member") == F.col("chosen")).alias("wanted"))
    # what is no list element is put together again: an export without a wrapper whole, else each member that is no list
    plain = of_members.filter(F.col("chosen").isNull() | ((F.coalesce("bracket", F.lit("{")) != "[") & (F.col("level") > 0)))
    plain = plain.groupBy(FILE, F.when(F.col("chosen").isNotNull(), F.col("member")).alias("member")).agg(F.sort_array(F.collect_list(F.struct("n", F.concat(F.coalesce("lead", F.lit("")), "text").alias("t")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    text = F.when(F.col("member").isNull(), text).otherwise(F.concat(F.lit("{"), F.regexp_replace(text, r"^[{,]", ""), F.lit("}")))
    plain = plain.select(FILE, F.coalesce("member", F.lit(0)).alias("member"), F.lit(0).cast("long").alias("pos"), text.alias("text"), F.col("member").isNull().alias("wanted"))
    parsed = listed.unionByName(wrapped).unionByName(plain).select(FILE, "member", "pos", "wanted", one_value("text").alias("v"), is_blank.alias("empty"))
    parsed = scratch.save(parsed, "parsed")
    # an empty list has one empty element; other elements that are empty or can't be parsed spoil the file
    wrong = parsed.groupBy(FILE, "member").agg(F.count_if(F.col("v").isNull() & ~F.col("empty")).alias("bad"), F.count_if("empty").alias("empty"), F.count("*").alias("all"))
    wrong = wrong.filter((F.col("bad") > 0) | ((F.col("empty") > 0) & (F.col("all") > 1))).select(FILE)
    # so do texts before, after and between, and brackets that do not match
    closes = F.col("lead").isin("]", "}")
    match = ((F.col("level") == 0) & (F.col("lead") == F.when(in_list, "]").otherwise("}"))) | (in_object & (F.col("level") == 1))
    outside = every.filter((in_list | in_object) & ((F.col("lead").isNull() & ~is_blank) | (closes & (~is_blank | ~match)) | (F.col("level") < 0)))
    unlike = of_members.filter((F.col("level") == 1) & closes & (F.col("chosen").isNotNull()) & (F.col("lead") != F.when(F.col("bracket") == "[", "]").otherwise("}")))
    named = of_members.filter((F.col("level") == 1) & F.col("lead").isin("{", ",") & (F.col("bracket") == "[") & ~F.col("text").rlike(MEMBER + r"[ \t\r\n]*$"))
    alone = every.filter(~(in_list | in_object)).groupBy(FILE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), "").alias("text"))
    alone = alone.select(FILE, F.when(one_value("text").isNull(), INVALID).otherwise("neither a list nor an object").alias("reason"))
    nameless = of_members.filter((F.col("level") == 1) & F.col("lead").isin("{", ",") & F.col("chosen").isNotNull() & is_blank)
    files = spark.createDataFrame([(f,) for f in empty_files(spark, path)], f"{FILE} string")
    invalid = every.filter((in_list | in_object) & ~F.col("ended")).select(FILE).union(wrong).union(outside.select(FILE)).union(unlike.select(FILE)).union(named.select(FILE)).union(nameless.select(FILE)).union(files)
    bad = scratch.save(invalid.distinct().select(FILE, F.lit(INVALID).alias("reason")).unionByName(alone).groupBy(FILE).agg(F.max("reason").alias("reason")), "bad")
    scratch.drop("every")
    good = parsed.filter(F.col("wanted") & ~F.col("empty")).join(counted_side(bad.select(FILE)), FILE, "left_anti")
    return good.select(FILE, "pos", "v"), bad
