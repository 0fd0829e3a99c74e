"""Incremental reads of landed files: de-duplication over all micro-batches, and upserts per micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 50) -> DataFrame:
    """A stream of a table's files, with the table's own schema."""
    schema = spark.read.parquet(path).schema
    pattern = path if path.endswith("/") else path + "*"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(pattern)


def deduplicated(stream: DataFrame, key: str, time: str) -> DataFrame:
    """One row per key among the rows that state key and time, however late a row comes.

    The keys of all batches are kept: a watermark would drop late rows and
    let expired keys out again, so rows would depend on how files fall into batches.
    """
    return stream.where(F.col(time).isNotNull() & F.col(key).isNotNull()).dropDuplicates([key])


# Keys that are kept for good lie on disk, not on the executors' heap.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def run_to_table(stream: DataFrame, name: str) -> str:
    """Runs a stream over all there is and gives the folder of its output."""
    spark = stream.sparkSession
    out = _place(spark, name)
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:  # the query takes the session's settings as it starts
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out + "/data").option("checkpointLocation", out + "/log").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return out + "/data"


def upsert_stream(stream: DataFrame, key: str, time: str, columns: list[str], place: str | None = None) -> str:
    """Keeps the latest row per key over all micro-batches; gives the folder of the table.

    Each batch is reduced to a row per key and written as a delta named by its
    number, so a batch that is run again after a failure writes the same delta
    again.  All that is known lies in the folder: a run that goes on at the
    same ``place`` reads it there.  The deltas are put together once, at the end.
    """
    spark = stream.sparkSession
    out = place or _place(spark, "upsert")
    kinds = dict(stream.dtypes)

    def latest(rows: DataFrame) -> DataFrame:
        at = F.coalesce(time, F.lit("0001-01-01").cast(kinds[time]))
        return rows.groupBy(key).agg(F.max(F.struct(at.alias("__at"), time, *columns)).alias("r")).select(key, f"r.{time}", *[f"r.{c}" for c in columns])

    def write(batch: DataFrame, number: int) -> None:
        latest(batch.where(F.col(key).isNotNull()).select(key, time, *columns)).write.mode("overwrite").parquet(f"{out}/deltas/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", out + "/log").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, time, *columns))
    latest(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out + "/deltas")).write.mode("overwrite").parquet(out + "/table")
    return out + "/table"
