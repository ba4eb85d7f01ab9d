"""What readers know about the files that rows come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "__file"


def stem(file: Column) -> Column:
    """The name of a file without its folder and extension."""
    name = F.regexp_extract(file, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files below a path that have no bytes: no scan tells of them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, each = [], system.listFiles(place, True)
    while each.hasNext():
        file = each.next()
        name = file.getPath().getName()
        if file.getLen() == 0 and not name.startswith(("_", ".")):
            found.append(file.getPath().toUri().toString())
    return found
