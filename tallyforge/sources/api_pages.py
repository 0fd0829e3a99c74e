"""Landed API payloads: written and read by Spark itself, so any file system that the cluster has will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import json_ops as J
from ..operators.links import breadth_first


def land(payloads: DataFrame, folder: str) -> None:
    """Stores payloads (page, payload, ...) as they came; further columns, such as a total from a header or the next cursor, are kept beside them."""
    payloads.write.mode("append").parquet(folder)


def read_items(spark: SparkSession, folder: str) -> DataFrame:
    """(page, ord, item): the items of each stored payload in their order, as JSON texts; a payload that is no JSON has none."""
    return spark.read.parquet(folder).select("page", F.posexplode(J.items(F.col("payload"))).alias("ord", "item"))


def until_end(payloads: DataFrame, source: str, page: str, payload: str, limit: int) -> DataFrame:
    """The pages of each source up to the one where a scan would stop: the first short one, or the second empty one in a row.

    Pages without a place are left out; a source's places are few numbers, not its items.
    """
    sized = payloads.where(F.col(page).isNotNull()).withColumn("__n", F.coalesce(F.size(J.items(F.col(payload))), F.lit(0)))
    counts = sized.groupBy(source, page).agg(F.max("__n").alias("__n"))
    before = F.lag("__n").over(W.partitionBy(source).orderBy(page))
    ends = counts.withColumn("__before", before).where((F.col("__n").between(1, limit - 1)) | (F.col("__n") == 0) & (F.col("__before") == 0)).groupBy(source).agg(F.min(page).alias("__last"))
    return sized.join(ends, source, "left").where(F.col("__last").isNull() | (F.col(page) <= F.col("__last"))).drop("__n", "__last")


def by_cursor(payloads: DataFrame, cursor: str, following: str, first: str) -> DataFrame:
    """(cursor, step) of the pages reached from the first one by following their cursors, each once; a ring ends by itself.

    A chain is followed one page a round, as the pages came.
    """
    edges = payloads.select(F.col(cursor).alias("src"), F.col(following).alias("dst"))
    seeds = payloads.where(F.col(cursor) == first).select(F.col(cursor).alias("node"))
    return breadth_first(edges, seeds, 1 << 30).select(F.col("node").alias(cursor), F.col("level").alias("step"))
