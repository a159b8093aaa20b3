"""Streaming ingest of crawl results: upserts, appends and new crawl seeds.

Each micro-batch writes only its own rows, into folders named by its batch
number; a repeated batch replaces the same folders. Keyed tables are merged by
key when they are read, and :func:`compact` folds old batches into one. So the
cost of a batch follows its size, not the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import canonical_url, url_id
from ..operators.relational import latest_by
from ..sinks.upserts import upsert_pages
from ..sinks.writers import overwrite
from ..sources.crawl import accepted, ingest_crawl_results, rejected, typed

SCHEMAS = {
    "web_pages": "url_hash string, url string, domain string, page_type string, seen_at timestamp, batch bigint",
    "products": "url_hash string, domain string, title string, current_price decimal(10,2), in_stock boolean, "
                "last_updated_at timestamp, batch bigint",
    "snapshots": "url_hash string, status_code int, final_url string, title string, seo_flags string, "
                 "created_at timestamp, batch bigint",
    "jobs": "url string, domain string, status string, job_type string, finished_at timestamp, batch bigint",
    "rejects": "value string, received_at timestamp, batch bigint",
    "seeds": "url_id string, url string, job_type string, priority int, batch bigint",
}


def write_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """One micro-batch (JSON texts in ``value``, optionally ``received_at``) to all tables."""
    if "received_at" not in batch.columns:
        batch = batch.withColumn("received_at", F.current_timestamp())
    rows = typed(batch).persist()  # the texts are parsed once for all tables
    now = F.col("received_at")
    out = ingest_crawl_results(accepted(rows), now)
    seeds = out["next_urls"].select(url_id("url").alias("url_id"), canonical_url("url").alias("url"), "job_type", "priority")
    parts = {"web_pages": out["pages"], "products": out["products"], "snapshots": out["snapshots"], "jobs": out["jobs"],
             "seeds": seeds.filter(F.col("url_id").isNotNull()).dropDuplicates(["url_id"]),
             "rejects": rejected(rows)}
    try:
        for name, df in parts.items():
            overwrite(df, f"{root}/{name}/batch={batch_id}")
    finally:
        rows.unpersist()


def ingest_stream(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the ingest; by default it handles what is there and stops."""
    return (stream.writeStream.foreachBatch(lambda df, i: write_batch(df, i, root))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def read_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a table, every batch."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def current_pages(spark: SparkSession, root: str) -> DataFrame:
    """One row per page with first and last sighting."""
    seen = read_rows(spark, root, "web_pages").select(
        "url_hash", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"),
        F.lit(None).cast("string").alias("last_error"))
    return upsert_pages(seen.limit(0), seen)


def current_products(spark: SparkSession, root: str) -> DataFrame:
    """Newest title and price of each product."""
    return latest_by(read_rows(spark, root, "products"), ["url_hash"], ["last_updated_at", "batch", "title"]).drop("batch")


def current_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Each crawl seed once, as first seen."""
    rows = read_rows(spark, root, "seeds")
    return rows.groupBy("url_id").agg(F.min_by(F.struct("url", "job_type", "priority"), F.struct("batch", "job_type")).alias("_r")).select("url_id", "_r.*")


def compact(spark: SparkSession, root: str, name: str, up_to: int, out_root: str) -> None:
    """Fold the batches up to a number into batch 0 of another root; readers move over when it is done."""
    rows = read_rows(spark, root, name)
    overwrite(rows.filter(F.col("batch") <= up_to).drop("batch"), f"{out_root}/{name}/batch=0")
    newer = rows.filter(F.col("batch") > up_to)
    newer.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out_root}/{name}")
