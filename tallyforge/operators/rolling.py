"""Looking back over ordered rows of a key without putting a key into one task.

Rows are windowed per key and time bucket.  What a bucket needs from before it
- the last rows of the buckets before - is carried in from a summary with one
short entry per key and bucket, so a key with a third of all rows is spread
over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def look_back(rows: DataFrame, key: str, order: list[str], bucket: Column, value: Column, depth: int) -> DataFrame:
    """``rows`` with ``before``: the values of the ``depth`` rows before each one, the nearest first; fewer at a key's start."""
    placed = rows.withColumn("__bucket", bucket).withColumn("__value", value)
    entry = F.struct(*order, F.col("__value").alias("v"))
    inner = W.partitionBy(key, "__bucket").orderBy(*order)
    own = [F.lag(entry, k).over(inner) for k in range(1, depth + 1)]
    local = placed.withColumn("__own", F.filter(F.array(*own), lambda x: x.isNotNull()))
    # the last ``depth`` entries of each bucket: only they can be looked back at from a later one
    back = W.partitionBy(key, "__bucket").orderBy(*[F.desc(c) for c in order])
    last = placed.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= depth)
    ends = last.groupBy(key, "__bucket").agg(F.reverse(F.sort_array(F.collect_list(entry))).alias("ends"))
    earlier = W.partitionBy(key).orderBy("__bucket").rowsBetween(-depth, -1)
    carried = ends.select(key, "__bucket", F.slice(F.flatten(F.reverse(F.collect_list("ends").over(earlier))), 1, depth).alias("__carried"))
    joined = local.join(carried, [key, "__bucket"])
    return joined.withColumn("before", F.transform(F.slice(F.concat("__own", "__carried"), 1, depth), lambda x: x["v"])).drop("__bucket", "__value", "__own", "__carried")
