"""Windowed metrics, request rates and bans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import fixed


def post_daily_metrics_stream(stream: DataFrame, ts: str = "snapshot_time", late: str = "7 days") -> DataFrame:
    """Daily means per post, updated while rows up to ``late`` old arrive (update mode)."""
    cols = {"like_count": "avg_likes", "comment_count": "avg_comments", "view_count": "avg_views"}
    return (stream.withWatermark(ts, late).groupBy("external_post_id", F.window(ts, "1 day").alias("w"))
            .agg(*[fixed(F.avg(c), 4).alias(n) for c, n in cols.items() if c in stream.columns])
            .select("external_post_id", F.col("w.start").cast("date").alias("day"),
                    *[n for c, n in cols.items() if c in stream.columns]))


def withhold_latest(df: DataFrame, ts: str, as_of, hours: int = 1) -> DataFrame:
    """Rows older than the last hour, which is still moving."""
    return df.filter(F.col(ts) < F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))


def rate_usage(df: DataFrame, ts: str = "ts", proxy: str = "proxy", domain: str = "domain", span: str = "1 hour",
               limit: int = 50) -> DataFrame:
    """Requests per proxy, domain and window, with a flag at the limit. Works on tables and streams."""
    return (df.groupBy(proxy, domain, F.window(ts, span).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
            .select(proxy, domain, F.col("w.start").alias("window_start"), "requests",
                    (F.col("requests") >= limit).alias("at_limit")))


def rate_breaches(df: DataFrame, hourly: int = 50, daily: int = 500, **cols: str) -> DataFrame:
    """Windows of either length that reached their limit."""
    parts = [rate_usage(df, span=s, limit=n, **cols).filter("at_limit").withColumn("span", F.lit(s))
             for s, n in (("1 hour", hourly), ("1 day", daily))]
    return parts[0].unionByName(parts[1])


def rate_usage_stream(stream: DataFrame, span: str = "1 hour", limit: int = 50, late: str = "10 minutes") -> DataFrame:
    return rate_usage(stream.withWatermark("ts", late), span=span, limit=limit)


def banned_until(failures: DataFrame, as_of: Column, proxy: str = "proxy", ts: str = "ts", minutes: int = 10) -> DataFrame:
    """Proxies whose newest failure before ``as_of`` is less than the ban time old."""
    last = failures.filter(F.col(ts) <= as_of).groupBy(proxy).agg(F.max(ts).alias("last_failure"))
    return last.filter(F.col("last_failure") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)) > as_of)


def healthy(proxies: DataFrame, failures: DataFrame, as_of: Column, proxy: str = "proxy", ts: str = "ts",
            minutes: int = 10) -> DataFrame:
    """Proxies that are not banned at a point in time."""
    return proxies.join(banned_until(failures, as_of, proxy, ts, minutes).select(proxy), proxy, "left_anti")


def served_while_banned(df: DataFrame, proxy: str, ts: str, failed: Column, minutes: int = 10) -> DataFrame:
    """Requests made within the ban time after an earlier failure of the same proxy.

    A RANGE frame over event time replaces an interval join, so a proxy with
    many failures does not multiply rows. Long series of a proxy are cut into
    day buckets; a failure is copied in front of every later day its ban reaches.
    """
    span, day = minutes * 60_000_000, 86_400_000_000
    base = (df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
            .withColumn("_day", F.floor(F.col("_t") / day)).withColumn("_copy", F.lit(False)))
    reach = F.floor((F.pmod(F.col("_t"), F.lit(day)) + span - 1) / day)
    head = (base.filter(failed & (reach >= 1)).withColumn("_step", F.explode(F.sequence(F.lit(1).cast("bigint"), reach)))
            .withColumns({"_day": F.col("_day") + F.col("_step"), "_copy": F.lit(True)}).drop("_step"))
    w = Window.partitionBy(proxy, "_day").orderBy("_t").rangeBetween(-span + 1, -1)
    return (base.unionByName(head).withColumn("recent_failures", F.count(F.when(failed, F.lit(1))).over(w))
            .filter(~F.col("_copy") & (F.col("recent_failures") > 0)).drop("_t", "_day", "_copy"))
