"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame.  run() writes each
stage's rows as Parquet below spark.checkpoint.dir and reads them back for the next, so a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from kinfold.llm.common import free
from kinfold.llm.queries import tokenizer_file
from kinfold.scratch import Scratch

#: A document goes if its toxicity reaches this.
TOXIC = 0.5
#: What packing's workers remember and encode at once here, where earlier stages have left their memory behind: less than alone.
PACKING_WORDS, PACKING_BYTES = 100_000, 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below TOXIC; those without text get the model's bias and stay."""
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free("__toxicity", docs)
    return toxicity.score(docs, machine, name).filter(F.col(name) < TOXIC).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id."""
    return ngram_join.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: between no and three rows."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a repeated document has pieces for each copy."""
    return packing.pack(docs, tokenizer_file(), finish=packing.with_crc, schema=packing.CRC_PIECES, cache_words=PACKING_WORDS, slice_bytes=PACKING_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, hash and tokenise: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents, one after the other."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
