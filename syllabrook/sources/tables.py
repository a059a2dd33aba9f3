"""Parquet table source and the rule for re-sent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Scan one table of a folder; column pruning and filters reach the scan.

    The schema is that of the files; with ``columns`` (name to type) these alone are read and cast, and a
    missing one is an error before any row is read (S28).
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns is None:
        return rows
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        raise ValueError(f"{name} lacks {', '.join(absent)}")
    return rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in columns.items()))


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key: re-sent rows repeat a key with all its content and never count twice.

    Rows with a null key are one group and come out as one row, so callers filter null keys first.
    """
    return df.dropDuplicates([key])
