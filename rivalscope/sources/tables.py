"""Table readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import INPUT_TABLES, schema_of


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A Parquet table with its declared schema (no inference pass over files)."""
    return spark.read.schema(schema_of(name)).parquet(f"{folder}/{name}.parquet")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """HTML page corpus (page_id, url, html)."""
    return read_table(spark, "pages", folder)


def input_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, name, folder) for name in INPUT_TABLES}
