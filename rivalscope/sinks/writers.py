"""Parquet and JSON writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, ts: str | None = None) -> None:
    """Append facts, one folder per day when a time column is given."""
    if ts is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("date", F.col(ts).cast("date")).write.mode("append").partitionBy("date").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Replace only the partitions present in ``df`` (safe to run again)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition).parquet(path))


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON documents per part of a report."""
    for name, df in frames.items():
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{path}/{name}")
