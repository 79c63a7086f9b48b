"""Readers of the project's tables: explicit, column-pruned Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblore.session import cut


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of a folder; with columns given, only those are scanned."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


MOST_REPEATED = 1_000_000  # keys that may be broadcast (8 MB)


def once(df: DataFrame, key: str) -> DataFrame:
    """Each key once, wide columns unshuffled: only rows whose key comes several times are brought together.

    Keys that come several times are found on the key column alone; up to MOST_REPEATED of them are
    broadcast, more meet the rows by shuffle. A null key counts as a key. Of several rows an arbitrary one is kept.
    """
    several = cut(df.groupBy(F.col(key).alias("_key")).count().filter("count > 1").select("_key"))
    several = F.broadcast(several) if several.count() <= MOST_REPEATED else several
    again = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(several, again, "left_anti").unionByName(df.join(several, again, "left_semi").dropDuplicates([key]))
