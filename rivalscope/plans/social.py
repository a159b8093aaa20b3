"""Social scores, their time series and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import engagement, fixed, label, ratio
from ..operators.series import lagged, minmax_norm, rolling

SERIES = ["competitor_id", "platform"]


def _months_back(as_of, months: int) -> Column:
    return F.lit(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))


def posts_recent(accounts: DataFrame, posts: DataFrame, as_of, months: int = 3) -> DataFrame:
    """Post means per account; accounts without recent posts stay with a count of zero.

    Posts are filtered and reduced per account before they meet the accounts.
    """
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("like_count", "comment_count", "share_count")}
    per_account = (posts.filter(F.col("publish_time") >= _months_back(as_of, months)).groupBy("account_id").agg(
        F.avg(engagement()).alias("e"), F.avg(zero["like_count"]).alias("l"), F.avg(zero["comment_count"]).alias("c"),
        F.avg(zero["share_count"]).alias("s"), F.count(F.lit(1)).alias("n")))
    # A kept account without posts counts its one empty row as zeros.
    def mean(c: str) -> Column:
        return fixed(F.coalesce(F.col(c), F.lit(0.0)), 2)
    n = F.coalesce("n", F.lit(0))
    return (accounts.select(F.col("id").alias("account_id"), *SERIES).join(per_account, "account_id", "left").select(
        "account_id", *SERIES, mean("e").alias("avg_engagement"), mean("l").alias("avg_likes_per_post"),
        mean("c").alias("avg_comments_per_post"), mean("s").alias("avg_shares_per_post"),
        n.alias("posts_last_3m"), fixed(n / F.lit(3.0), 2).alias("posts_per_month")))


def growth(metrics: DataFrame, as_of, months: int = 3) -> DataFrame:
    """Newest follower count and growth inside the window, in one pass per account."""
    recent = F.when(F.col("snapshot_time") >= _months_back(as_of, months), F.col("follower_count"))
    g = metrics.groupBy("account_id").agg(
        F.max_by("follower_count", F.struct("snapshot_time", "id")).alias("follower_count"),
        F.max(recent).alias("hi"), F.min(recent).alias("lo"))
    return g.select(
        "account_id", "follower_count",
        fixed(F.coalesce(ratio(F.col("hi") - F.col("lo"), "lo"), F.lit(0.0)), 4).alias("growth_rate"),
        F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)).alias("follower_delta"))


def account_metrics(accounts: DataFrame, metrics: DataFrame, posts: DataFrame, as_of, months: int = 3) -> DataFrame:
    """One row per account that has a metric row."""
    return (posts_recent(accounts, posts, as_of, months).join(growth(metrics, as_of, months), "account_id")
            .withColumn("reach_score", F.log10(F.lit(1) + F.col("follower_count")))
            .withColumn("engagement_rate", fixed(ratio("avg_engagement", "follower_count"), 6)))


def competitor_social_score(accounts: DataFrame, metrics: DataFrame, posts: DataFrame, as_of,
                            months: int = 3) -> DataFrame:
    """Follower-weighted score per competitor and platform."""
    normed = minmax_norm(account_metrics(accounts, metrics, posts, as_of, months), ["platform"], {
        "engagement_rate": "engagement_norm", "reach_score": "reach_norm",
        "posts_per_month": "activity_norm", "growth_rate": "growth_norm"})
    per_month = F.col("posts_per_month") * F.col("avg_engagement")
    scored = normed.select(
        "*",
        fixed(0.35 * F.col("engagement_norm") + 0.25 * F.col("reach_norm") + 0.20 * F.col("activity_norm")
              + 0.20 * F.col("growth_norm"), 4).alias("account_score"),
        fixed(per_month, 2).alias("engagement_per_month"),
        fixed(ratio(per_month, "follower_count") * 1000, 2).alias("engagement_per_1k_followers"),
        fixed(ratio(per_month, "follower_count") * 1000 * F.col("growth_rate"), 4).alias("performance_index"),
        fixed(F.col("posts_last_3m") / F.lit(90.0), 4).alias("posting_consistency"))

    def wavg(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("follower_count")), F.sum("follower_count"))

    def mean(c: str, places: int, name: str | None = None) -> Column:
        return fixed(F.avg(c), places).alias(name or c)

    return scored.groupBy(*SERIES).agg(
        fixed(F.coalesce(wavg("account_score"), F.lit(0.0)), 4).alias("score"),
        mean("engagement_norm", 4, "engagement_score"), mean("reach_norm", 4, "reach_score_"),
        mean("activity_norm", 4, "activity_score"), mean("growth_norm", 4, "growth_score"),
        mean("avg_likes_per_post", 2), mean("avg_comments_per_post", 2), mean("avg_shares_per_post", 2),
        fixed(wavg("posts_per_month"), 2).alias("posts_per_month"),
        fixed(wavg("engagement_per_month"), 2).alias("engagement_per_month"),
        mean("engagement_per_1k_followers", 2), mean("performance_index", 4),
        F.sum("follower_delta").cast("bigint").alias("follower_growth_absolute"),
        mean("posting_consistency", 4)).withColumnRenamed("reach_score_", "reach_score")


def competitor_social_score_simple(accounts: DataFrame, metrics: DataFrame, posts: DataFrame, as_of,
                                   months: int = 3) -> DataFrame:
    """Engagement per follower only; accounts without metrics stay."""
    e = posts_recent(accounts, posts, as_of, months)
    latest = metrics.groupBy("account_id").agg(
        F.max_by("follower_count", F.struct("snapshot_time", "id")).alias("follower_count"))
    rate = ratio("avg_engagement", "follower_count")
    return e.join(latest, "account_id", "left").groupBy(*SERIES).agg(
        fixed(F.avg(rate), 4).alias("score"), fixed(F.avg(rate), 4).alias("engagement_score"),
        F.lit(0.0).alias("reach_score"), F.lit(0.0).alias("activity_score"), F.lit(0.0).alias("growth_score"),
        fixed(F.avg("posts_per_month"), 2).alias("posts_per_month"),
        fixed(F.avg(F.col("avg_engagement") * F.col("posts_per_month")), 2).alias("engagement_per_month"),
        fixed(F.avg(rate * 1000), 2).alias("engagement_per_1k_followers"),
        fixed(F.avg("avg_likes_per_post"), 2).alias("avg_likes_per_post"),
        fixed(F.avg("avg_comments_per_post"), 2).alias("avg_comments_per_post"),
        fixed(F.avg("avg_shares_per_post"), 2).alias("avg_shares_per_post"),
        F.lit(0).cast("bigint").alias("follower_growth_absolute"), F.lit(0.0).alias("posting_consistency"))


def snapshot_scores(scores: DataFrame, as_of_date) -> DataFrame:
    """Score rows of one day for the history table (written by partition overwrite)."""
    return scores.select(F.lit(as_of_date).cast("date").alias("snapshot_date"), *SERIES, "score", "engagement_score",
                         "reach_score", "activity_score", "growth_score")


def social_time_series(history: DataFrame) -> DataFrame:
    """Deltas, momentum, volatility, averages and labels along each series.

    A series has one row per day, so a window partition stays short.
    """
    d = lagged(history.withColumn("score", F.col("score").cast("double")), SERIES, "snapshot_date", "score")
    d = d.withColumns({
        "score_delta": fixed(F.col("score") - F.col("prev_score"), 4),
        "score_acceleration": fixed((F.col("score") - F.col("prev_score"))
                                    - (F.col("prev_score") - F.col("prev_score_2")), 4)})
    for col, rows, how, name in (("score_delta", 7, "avg", "momentum"), ("score", 7, "stddev", "volatility"),
                                 ("score", 7, "avg", "score_7d_avg"), ("score", 30, "avg", "score_30d_avg")):
        d = rolling(d, SERIES, "snapshot_date", col, rows, how, name)
    steady = F.lit(1.0) / (F.col("volatility") + 0.0001)
    return d.withColumns({
        "stability_score": fixed(steady, 4),
        "composite_score": fixed(0.6 * F.col("score") + 0.25 * F.coalesce("momentum", F.lit(0.0)) + 0.15 * steady, 4),
        "trend_direction": label("score_delta", [(0.01, "up")], [(-0.01, "down")], "flat"),
        "momentum_state": label("momentum", [(0.01, "accelerating")], [(-0.01, "declining")], "stable")})


def forecast_regression(history: DataFrame, as_of_date) -> DataFrame:
    """Straight line through each series, 7 and 30 steps past its end (one grouping, no join back)."""
    w = Window.partitionBy(*SERIES).orderBy("snapshot_date")
    t = history.withColumn("score", F.col("score").cast("double")).withColumn("t", F.row_number().over(w))
    g = t.groupBy(*SERIES).agg(F.regr_slope("score", "t").alias("slope"),
                               F.regr_intercept("score", "t").alias("icept"), F.max("t").alias("n"))
    return g.select(*SERIES, F.lit(as_of_date).cast("date").alias("forecast_date"),
                    (F.col("icept") + F.col("slope") * (F.col("n") + 7)).alias("forecast_score_7d"),
                    (F.col("icept") + F.col("slope") * (F.col("n") + 30)).alias("forecast_score_30d"),
                    F.col("slope").alias("trend_slope"))


def forecast_momentum(series: DataFrame, as_of_date) -> DataFrame:
    return series.filter(F.col("snapshot_date") == F.lit(as_of_date).cast("date")).select(
        *SERIES, "snapshot_date", "score", "momentum",
        (F.col("score") + F.col("momentum") * 7).alias("forecast_7d"),
        (F.col("score") + F.col("momentum") * 30).alias("forecast_30d"))


def forecast_smoothed(history: DataFrame) -> DataFrame:
    """Seven-row mean carried on by its last step."""
    s = rolling(history.withColumn("score", F.col("score").cast("double")), SERIES, "snapshot_date", "score", 7,
                "avg", "smoothed_score", places=None)
    w = Window.partitionBy(*SERIES).orderBy("snapshot_date")
    s = s.withColumn("_step", F.col("smoothed_score") - F.lag("smoothed_score").over(w))
    return s.select(*SERIES, "snapshot_date", "smoothed_score",
                    (F.col("smoothed_score") + F.col("_step") * 7).alias("forecast_7d"),
                    (F.col("smoothed_score") + F.col("_step") * 30).alias("forecast_30d"))


def post_daily_metrics(metrics: DataFrame) -> DataFrame:
    """Mean counts per post and day."""
    names = {"like_count": "avg_likes", "comment_count": "avg_comments", "view_count": "avg_views"}
    return metrics.groupBy("external_post_id", F.col("snapshot_time").cast("date").alias("day")).agg(
        *[fixed(F.avg(c), 4).alias(n) for c, n in names.items() if c in metrics.columns])
