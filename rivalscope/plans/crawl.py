"""Crawl job listings and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import fixed, seconds_between, where_optional
from ..operators.relational import page, topk

STATUSES = ["queued", "inflight", "retry_scheduled", "failed", "completed"]


def jobs_page(jobs: DataFrame, number: int = 1, size: int = 50, status: str | None = None, domain: str | None = None,
              job_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    listed = where_optional(jobs, status=status, domain=domain, job_type=job_type)
    return (page(listed, [F.desc_nulls_last("queued_at"), F.asc("id")], number, size),
            listed.agg(F.count(F.lit(1)).alias("total")))


def _count_status(*names: str):
    return [F.count_if(F.col("status") == n).alias(n) for n in names]


def job_totals(jobs: DataFrame, as_of) -> DataFrame:
    """Totals by status, jobs finished lately and the mean duration, as one row."""
    now = F.lit(as_of) if not hasattr(as_of, "cast") else as_of
    done = F.col("finished_at")
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), *_count_status("completed", "queued", "inflight", "failed", "retry_scheduled"),
        F.count_if(done > now - F.expr("INTERVAL 1 HOUR")).alias("last_hour"),
        F.count_if(done > now - F.expr("INTERVAL 24 HOURS")).alias("last_24h"),
        fixed(F.avg(seconds_between(done, "started_at")), 4).alias("avg_duration_seconds"))


def domain_totals(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The n domains with most jobs."""
    per = jobs.groupBy("domain").agg(F.count(F.lit(1)).alias("total"), *_count_status("completed", "failed"),
                                     F.max("finished_at").alias("last_scraped"))
    return topk(per, [F.desc("total"), F.asc("domain")], n)


def recent_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    return topk(jobs, [F.desc("queued_at"), F.desc("id")], n)


def frontier_stats(jobs: DataFrame) -> DataFrame:
    """Jobs per domain and status, one column per status."""
    counts = jobs.groupBy("domain").pivot("status", STATUSES).agg(F.count(F.lit(1))).na.fill(0)
    return counts.withColumn("queue_depth", F.col("queued") + F.col("retry_scheduled"))


def domain_inflight(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("domain").agg(F.count_if(F.col("status") == "inflight").alias("inflight"))


def recent_events(events: DataFrame, source: str | None = None, n: int = 50) -> DataFrame:
    """Newest webhook events, optionally of one source."""
    return topk(where_optional(events, source=source), [F.desc("received_at"), F.desc("id")], n)


def job_row(payload: DataFrame) -> DataFrame:
    """Job table row of a failed-job payload: epoch seconds to time, job type with a default."""
    r = F.col("result")
    return payload.select(
        r["id"].alias("id"), r["url"].alias("url"), r["domain"].alias("domain"), r["priority"].alias("priority"),
        r["retries"].alias("retries"), F.coalesce(r["status"], F.lit("failed")).alias("status"),
        F.timestamp_seconds(r["queued_at"]).alias("queued_at"), F.timestamp_seconds(r["started_at"]).alias("started_at"),
        F.timestamp_seconds(r["completed_at"]).alias("finished_at"),
        F.coalesce(r["job_type"], F.lit("homepage_sitemap_crawl")).alias("job_type"), r["last_error"].alias("last_error"))
