"""Session helpers: a local session for tests and benches, and reliable lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "syllabrook", **conf: str) -> SparkSession:
    """A session for one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``; only on one machine (``local`` masters), where that is unset, a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="syllabrook-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def _remove(context: SparkContext, path: str) -> None:
    """Delete a written table at the end of the program, if its session still runs."""
    if context._jsc is not None:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Survives the loss of executors. A table read back has its real size, while a checkpoint carries the
    estimated size of its whole past, which multiplies with every join: rounds that follow each other
    spend more and more time on it. Tables are deleted at the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/syllabrook-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark.sparkContext, path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Keep a result that several branches read; lost blocks are computed again from the lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
