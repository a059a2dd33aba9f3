"""Queries of problem 3: amounts in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.operators import units
from syllabrook.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts of stated unit in minutes, but for records whose unit is ``HORA`` letter for letter."""
    out = units.convert(table(spark, folder, "disciplina_equivalencia"), table(spark, folder, "unidade_medida"))
    stated = out.filter(F.col("metodo").isin("unidade", "texto", "ementa") & ~F.col("unidade_original").eqNullSafe("HORA"))
    return stated.select("registro_id", "campo", "minutos")


def p3_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """All amounts in minutes, with the source of the unit, predicted units and cases for review."""
    return units.convert(table(spark, folder, "disciplina_equivalencia"), table(spark, folder, "unidade_medida"))
