"""Which records are of one person: those that share an e-mail or a phone, directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.components import connected_components
from kinfold.scratch import Scratch


def match_keys(profiles: DataFrame) -> DataFrame:
    """ord and key ("email:..." or "phone:...") of each record's different non-empty e-mails and phones."""
    def tagged(column: str, kind: str) -> Column:
        return F.transform(F.filter(F.col(column), lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))

    both = F.concat(tagged("emails", "email"), tagged("phones", "phone"))
    return profiles.select("ord", F.explode(F.array_distinct(both)).alias("key"))


def key_hubs(keys: DataFrame) -> DataFrame:
    """u and v: each record and the first record with the same key; linear in the keys, however many share one."""
    first = keys.groupBy("key").agg(F.min("ord").alias("v"), F.count("*").alias("n")).filter("n > 1").select("key", "v")
    return keys.join(first, "key").select(F.col("ord").alias("u"), "v").filter("u <> v")


def clusters(profiles: DataFrame, scratch: Scratch) -> DataFrame:
    """profiles with label: the smallest ord of the record's cluster, its own if nothing is shared."""
    keys = scratch.save(match_keys(profiles), "keys")
    members = connected_components(key_hubs(keys), scratch, "persons")
    return profiles.join(members.withColumnRenamed("node", "ord"), "ord", "left").withColumn("label", F.coalesce("label", "ord"))
