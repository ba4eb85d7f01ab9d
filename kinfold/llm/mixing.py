"""Mixing of sources to target weights.

The words of each source are summed; the sources' targets give a repetition rate for each source;
each document is taken floor(rate) times, and once more if a draw seeded by its hash falls below
the rate's fraction.  All of it is DataFrame code; what reaches the driver are sums of the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import free, global_rank, n_words, small_side
from kinfold.scratch import Scratch

#: Draws of each document that a source may choose from, so that it comes nearest to its target.
SEEDS = 64
#: No document is repeated more often.
MOST = 3


def _draws(doc_id: Column, size: Column) -> list[Column]:
    """SEEDS pairwise independent draws below 2^32 of a document, from one MD5 of its id and size."""
    digest = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")).cast("binary"))
    a, b = (F.conv(F.substring(digest, i, 8), 16, 10).cast("long") for i in (1, 9))
    return [F.pmod(a + k * b, F.lit(1 << 32)) for k in range(SEEDS)]


def sizes_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """source, doc_id and size (words) of each row of docs, saved."""
    return scratch.save(docs.select("source", "doc_id", n_words(F.col("text")).alias("size")), "sizes")


def source_plan(slim: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, weight, target, rate, seed; from what sizes_of() gives.

    Sources in code point order, null last, get the weights in turn.  Targets share all words by
    weight and stop at ``most`` times a source's size; the excess is shared again by weight.  A
    source without words has target and rate 0.  The seed is the draw (the lowest, in a tie) whose
    sum comes nearest to the target.
    """
    stats = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(stats, [F.col("source").asc_nulls_last()], "rank", scratch, "ranked")
    cycle = F.array(*map(F.lit, weights))
    ranked = scratch.save(ranked.select("source", "source_size", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).alias("weight")), "weighed")
    n, all_words, all_weight = ranked.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
    level, capped = (all_words or 0) / (all_weight or 1), 0
    while n:  # each round only adds sources that stop at their cap
        full = most * F.col("source_size") < F.lit(float(level)) * F.col("weight")
        now, words, weight = ranked.filter(full).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if now == capped or weight == all_weight:
            break
        capped, level = now, (all_words - most * words) / (all_weight - weight)
    target = F.least(F.lit(float(level)) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    plan = ranked.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = scratch.save(plan, "rates")
    chance = F.col("rate") - F.floor("rate")
    drawn = slim.join(small_side(plan.select(F.col("source").alias("__s"), "rate"), n), F.col("source").eqNullSafe(F.col("__s")))
    sums = drawn.groupBy("source").agg(*(F.sum(F.when(d < chance * float(1 << 32), F.col("size")).otherwise(0)).alias(f"s{k}") for k, d in enumerate(_draws(F.col("doc_id"), F.col("size")))))
    off = [F.struct(F.abs(F.col(f"s{k}") + F.floor("rate") * F.col("source_size") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(SEEDS)]
    sums = sums.withColumnRenamed("source", "__s")
    best = plan.join(sums, F.col("source").eqNullSafe(F.col("__s")))
    out = scratch.save(best.select(*plan.columns, F.array_min(F.array(*off))["k"].alias("seed")), "plan")
    scratch.drop("ranked", "weighed", "rates")
    return out


def _taken(docs: DataFrame, size: Column, plan: DataFrame, most: int) -> DataFrame:
    """docs with mix_size, mix_copies, mix_source_size and mix_target; columns by those names are replaced."""
    p = free("__mix_plan", docs)
    side = plan.select(F.struct("source", "source_size", "target", "rate", "seed").alias(p))
    chosen = F.element_at(F.array(*_draws(F.col("doc_id"), F.col("mix_size"))), F.col(f"{p}.seed") + 1)
    rate = F.col(f"{p}.rate")
    copies = F.least(F.floor(rate) + (chosen < (rate - F.floor(rate)) * float(1 << 32)).cast("long"), F.lit(most))
    joined = docs.join(small_side(side, plan.count()), F.col("source").eqNullSafe(F.col(f"{p}.source"))).withColumn("mix_size", size)
    joined = joined.withColumn("mix_copies", copies.cast("int"))
    return joined.withColumn("mix_source_size", F.col(f"{p}.source_size")).withColumn("mix_target", F.col(f"{p}.target")).drop(p)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """docs with columns mix_size, mix_source_size, mix_target, mix_copies: how often each is taken.

    Needs doc_id, text and source.  A null text has no words, a null source is a source of its own,
    a null doc_id is drawn by its size, repeated rows are taken alike, an empty table gives no rows.
    Every row is returned, those with no copies too.  Columns of docs by the names given here are
    replaced.  Reruns agree: draws depend on doc_id and size alone.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    return _taken(docs, n_words(F.col("text")), source_plan(sizes_of(docs, scratch), scratch, weights, most), most)


def shares(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """As mix(), without the texts, which are read once: doc_id, source and the columns that mix() adds."""
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = sizes_of(docs, scratch)
    return _taken(slim, F.col("size"), source_plan(slim, scratch, weights, most), most).drop("size")


def emit(docs: DataFrame, **how: object) -> DataFrame:
    """The mixed collection: each document as often as it is taken, with the columns of docs.

    Columns of docs by the names that mix() adds are kept as they are.
    """
    own = {c: free(f"{c}_given", docs) for c in docs.columns if c.lower() in ("mix_size", "mix_copies", "mix_source_size", "mix_target")}
    mixed = mix(docs.withColumnsRenamed(own), **how)
    copy = free("__mix_copy", mixed)
    out = mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col("mix_copies"))))
    return out.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))
