"""Small relational operators: pages, latest versions, outcomes of batch changes, rules and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(n: int, most: int, least: int = 1) -> int:
    """A page size within its limits."""
    return max(least, min(n, most))


def page(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in a total order; each task keeps ``n``, so nothing is sorted as a whole (O1)."""
    return rows.orderBy(*order).limit(n)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (W1). Spark keeps one row a key before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row (key, regra) for each rule that a row breaks; a rule that is unknown (null) is kept, as in a CHECK (V1)."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return rows.select(F.col(key).cast("string").alias("chave"), F.explode(broken).alias("regra"))


def repeated(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Rows that break a uniqueness over ``columns``; rows with a null in one of them are out of it (V5, filtered unique index)."""
    rows = rows.select(F.col(key).cast("string").alias("chave"), *columns).dropna(subset=columns)
    several = rows.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(several, columns, "left_semi").select("chave", F.lit(name).alias("regra"))


def dangling(rows: DataFrame, key: str, column: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Rows whose reference leads nowhere; null references are allowed (V6)."""
    known = parents.select(F.col(parent_key).alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(known, column, "left_anti").select(F.col(key).cast("string").alias("chave"), F.lit(name).alias("regra"))
