"""Queries of the general training-data operators (problems 1 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eav, units
from ..runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = eav.attribute_list(table(spark, sf_dir, "spec_attributes"))
    return eav.cells_of(eav.pivot(spark, sf_dir), attributes, ("int", "boolean", "text"))


def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per machine, a typed column per attribute."""
    return eav.pivot(spark, sf_dir)


def p1_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many machines fill each attribute."""
    attributes = eav.attribute_list(table(spark, sf_dir, "spec_attributes"))
    cells = eav.cells_of(eav.pivot(spark, sf_dir), attributes, ("int", "boolean", "text", "decimal"))
    return cells.groupBy("attr_name").agg(F.count("*").alias("n_machines"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.found(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p1_fill_rates": p1_fill_rates, "p7_found": p7_found}
