from pyspark.sql import functions as F

from tallyforge.operators import eav

ATTRIBUTES = [("axis_count", "int", None, ""), ("control_unit", "text", None, ""), ("weight", "decimal", "mass", "")]


def test_classes_build_their_own_columns(spark):
    data = [(1, "axis_count", "3", None), (1, "weight", None, 2.5), (2, "weight", None, 4.0), (3, "control_unit", "U", None), (4, "weight", None, 1.0)]
    cells = spark.createDataFrame(data, "machine_id long, attr_name string, text string, number double").select("machine_id", "attr_name", F.struct("text", "number").alias("cell"))
    entities = eav.entity_cells(cells, ATTRIBUTES)
    assert entities.columns == ["machine_id", "signature", "cells"]  # no wide row before the classes
    for most in (1, 2, 12):
        wide = eav.characteristic_sets(entities, ATTRIBUTES, most)
        assert sorted(tuple(r) for r in wide.collect()) == [(1, 3, None, 2.5), (2, None, None, 4.0), (3, None, "U", None), (4, None, None, 1.0)]
        assert dict(wide.dtypes)["axis_count"] == "bigint" and dict(wide.dtypes)["weight"] == "double"
