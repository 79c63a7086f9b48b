"""Session helpers: a local session for tests and benches, durable cut of lineage."""

from __future__ import annotations

import functools
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local master without one gets a temporary folder.

    Raises if a cluster session names no shared folder: a machine-local folder would not
    survive the loss of an executor.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"weblore-checkpoint-{os.getuid()}")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder once and read them from there.

    Used where a small intermediate table is read more than once, or where a loop would
    otherwise grow its lineage. It is a reliable checkpoint, so lost executors cost nothing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package's folder on the Python path of the session's workers.

    Needed where the driver found the package by sys.path alone. Executors elsewhere get it by
    --py-files or an installed package; a folder they lack does no harm.
    """
    folder = str(Path(__file__).resolve().parent.parent)

    @functools.wraps(query)
    def run(spark: SparkSession, tables: str) -> DataFrame:
        paths = spark.sparkContext.environment.get("PYTHONPATH", "")
        if folder not in paths.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (paths, folder) if p)
        return query(spark, tables)

    return run
