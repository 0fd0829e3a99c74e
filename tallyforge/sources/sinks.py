"""Where results go: exports, appended logs, files of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How long texts of a log may be.
LOG_LIMITS = {"error_details": 5000, "log_output": 10000}


def export_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Chosen columns under new names; one file per partition."""
    df.select(*[F.col(c).alias(n) for c, n in columns.items()]).write.mode("overwrite").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Log rows with their long texts cut to size."""
    kept = {c: F.left(F.col(c), F.lit(n)) for c, n in LOG_LIMITS.items() if c in df.columns}
    df.withColumns(kept).write.mode("append").parquet(path)
