"""Daily aggregates that are kept up to date from a log of touched days.

Every batch of facts is written by day and leaves the days it touched in a log. A
refresh reads the log since the last refresh, recomputes those days only, and replaces
only their folders; rows of the last hour are held back, and their days come again at
the next refresh. A repeated batch or refresh replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.writers import overwrite, overwrite_partitions
from .metrics import withhold_latest


def record(facts: DataFrame, batch_id: int, root: str, ts: str = "snapshot_time") -> None:
    """Write one batch of facts by day, and the days it touches to the log."""
    rows = facts.withColumn("day", F.col(ts).cast("date"))
    # One folder a day and batch, so that a batch that runs again replaces its own rows.
    overwrite_partitions(rows.withColumn("batch", F.lit(batch_id)), f"{root}/facts", "day", "batch")
    overwrite(rows.select("day").distinct(), f"{root}/touched/batch={batch_id}")


def _log(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except Exception as e:  # no refresh yet
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def refresh(spark: SparkSession, root: str, aggregate: Callable[[DataFrame], DataFrame], as_of, ts: str = "snapshot_time",
            hold_hours: int = 1) -> int:
    """Bring ``root/daily`` up to ``as_of``; ``aggregate`` gives rows with ``day``. Returns how many days were recomputed.

    Facts are joined with the touched days, so only their folders are read (dynamic partition pruning).
    """
    touched = spark.read.schema("day date, batch int").parquet(f"{root}/touched")
    runs = _log(spark, root, "refreshed", "up_to int, held date, run int")
    last = runs.agg(F.max("up_to").alias("up_to"), F.max("run").alias("run")).first()
    done = -1 if last["up_to"] is None else last["up_to"]
    up_to = touched.agg(F.max("batch")).first()[0]
    run = 0 if last["run"] is None else last["run"] + 1
    held = runs.filter((F.col("run") == run - 1) & F.col("held").isNotNull()).select(F.col("held").alias("day"))
    days = touched.filter(F.col("batch") > done).select("day").union(held).distinct()
    facts = spark.read.parquet(f"{root}/facts").join(days, "day", "left_semi")
    overwrite_partitions(aggregate(withhold_latest(facts, ts, as_of, hold_hours)), f"{root}/daily", "day")
    # Days that still have rows in the last hour come again.
    later = facts.filter(F.col(ts) >= F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hold_hours))).select(F.col("day").alias("held")).distinct()
    mark = spark.range(1).select(F.lit(None).cast("date").alias("held")).union(later).withColumn("up_to", F.lit(up_to).cast("int"))
    n = days.count()
    overwrite(mark.select("up_to", "held"), f"{root}/refreshed/run={run}")
    return n
