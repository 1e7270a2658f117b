"""File inventory (P20 input): a recursive listing through the ``binaryFile`` source.
Only metadata columns are selected, so file contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.dates import ntz


def file_inventory(spark: SparkSession, root: str, as_of, glob: str | None = None) -> DataFrame:
    """(path, size, mtime, age_hours) of every file under ``root``; age relative to
    ``as_of`` (a timestamp), so the selection is reproducible."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    mt = F.col("mtime").cast("timestamp_ntz")
    age = (F.unix_micros(ntz(as_of).cast("timestamp")) - F.unix_micros(mt.cast("timestamp"))).cast("double") / 3.6e9
    return df.select("path", "size", mt.alias("mtime"), age.alias("age_hours"))
