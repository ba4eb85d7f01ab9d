"""Intermediate tables in the folder that all machines of a cluster share.

Operators cut long lineages by writing a table and reading it back.  The place is
``spark.checkpoint.dir``; only where that is unset on one machine (tests, a laptop) a folder below
the working directory is used and the setting is filled in.  What is left of a session's tables
is deleted when it ends.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, set to a local default where none is named."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        place = "file://" + os.path.abspath(os.path.join("spark-warehouse", "shared"))
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class Scratch:
    """Named Parquet tables of one operator call; each can be dropped as soon as it is not needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinfold-{label}-{uuid.uuid4().hex}"
        path, files = self._opened(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str, *folders: str, large_rows: bool = False) -> DataFrame:
        """Write df and return a DataFrame that reads it back (a short lineage, exact sizes).

        folders: columns whose values get folders of their own, name/column=value, that can be dropped alone.
        large_rows: rows have MBs, so row groups, which are read and written whole, are bounded after every row instead of after 100.
        """
        path = f"{self.root}/{name}"
        bounds = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"} if large_rows else {}
        df.write.options(compression="zstd", **bounds).partitionBy(*folders).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._opened(f"{self.root}/{name}")
            files.delete(path, True)

    def _opened(self, place: str) -> tuple:
        """The JVM's path and file system of a place."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
