"""Stage tables: each stage writes its own table, none is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StageStore:
    """Parquet stage tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def save(self, df: DataFrame, stage: str, by: tuple[str, ...] = ()) -> None:
        """Replace a stage; partitioned by the given columns."""
        df.write.mode("overwrite").partitionBy(*by).parquet(self.path(stage))

    def append(self, df: DataFrame, stage: str) -> None:
        df.write.mode("append").parquet(self.path(stage))

    def upsert(self, df: DataFrame, stage: str, key: str) -> None:
        """Rows of df replace stored rows of the same key; written beside the old table, then exchanged."""
        if self.has(stage):
            kept = self.load(stage).join(df.select(key).distinct(), key, "left_anti")
            df = kept.unionByName(df, allowMissingColumns=True)
        self.save(df, f"{stage}__next")
        self.save(self.load(f"{stage}__next"), stage)
        self.drop(f"{stage}__next")

    def load(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))

    def _fs(self, stage: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(stage))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, stage: str) -> bool:
        path, fs = self._fs(stage)
        return fs.exists(path)

    def drop(self, stage: str) -> None:
        path, fs = self._fs(stage)
        fs.delete(path, True)

    def find(self, stage: str, **equal: object) -> DataFrame:
        """Rows whose columns equal the given values (partition columns are pruned)."""
        df = self.load(stage)
        for name, value in equal.items():
            df = df.filter(F.col(name) == value)
        return df

    def unset(self, stage: str, column: str) -> None:
        """Drop one column of a stage."""
        self.save(self.load(stage).drop(column), f"{stage}__next")
        self.save(self.load(f"{stage}__next"), stage)
        self.drop(f"{stage}__next")

    def delete(self, stage: str, condition: Column) -> None:
        """Drop the rows that fulfil the condition; rows for which it is null stay."""
        self.save(self.load(stage).filter(~F.coalesce(condition, F.lit(False))), f"{stage}__next")
        self.save(self.load(f"{stage}__next"), stage)
        self.drop(f"{stage}__next")


def export_csv(df: DataFrame, folder: str) -> None:
    """Knowledge-base table as CSV with header and quoted texts."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(folder)


def import_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(folder)


def files_below(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return df.select("path", "length")


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def largest(df: DataFrame, column: str) -> DataFrame:
    """One row with the largest value of a column."""
    return df.agg(F.max(column).alias("largest"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as a string."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
