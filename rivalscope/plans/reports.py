"""Report, context and analysis datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import engagement, fixed, where_optional
from ..operators.relational import one_row, top_n_per_group, topk
from .competitors import top_categories


def posts_of(posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Posts with competitor and platform of their account."""
    owner = accounts.select(F.col("id").alias("account_id"), "competitor_id", "platform")
    return posts.join(owner, "account_id")


def top_posts(posts: DataFrame, accounts: DataFrame, competitor_id: int | None = None, platform: str | None = None,
              n: int = 20) -> DataFrame:
    """Posts with most engagement, of one competitor or of each."""
    p = where_optional(posts_of(posts, accounts), competitor_id=competitor_id, platform=platform)
    p = p.withColumn("total_engagement", engagement().cast("bigint"))
    order = [F.desc("total_engagement"), F.asc("id"), F.asc("publish_time")]
    return topk(p, order, n) if competitor_id is not None else top_n_per_group(p, ["competitor_id"], order, n)


def report_social_posts(posts: DataFrame, accounts: DataFrame, n: int = 20) -> DataFrame:
    """Top posts per competitor by likes plus comments; a NULL count makes the sum NULL and sorts last."""
    p = posts_of(posts, accounts).withColumn("reactions", (F.col("like_count") + F.col("comment_count")).cast("bigint"))
    return top_n_per_group(p, ["competitor_id"], [F.desc_nulls_last("reactions"), F.asc("id"), F.asc("publish_time")], n)


def report_seo_gap(summary: DataFrame) -> DataFrame:
    return (summary.select("domain", "avg_seo_score", "avg_content_score", "avg_technical_score")
            .orderBy(F.desc_nulls_last("avg_seo_score"), "domain"))


def report_platform(competitors: DataFrame, pages: DataFrame, products: DataFrame, competitor_id: int) -> DataFrame:
    """One row: page and product counts of a competitor."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("competitor_id") == competitor_id).agg(F.count(F.lit(1)).alias(name))
    who = competitors.filter(F.col("id") == competitor_id).agg(
        F.max("id").alias("id"), F.max("domain").alias("domain"), F.max("name").alias("name"))
    return one_row(who, n(pages, "page_count"), n(products, "product_count"))


def context_social(social: DataFrame, competitors: DataFrame) -> DataFrame:
    names = competitors.select(F.col("id").alias("competitor_id"), "domain")
    return social.join(names, "competitor_id").select(
        "competitor_id", "domain", "platform", fixed("engagement_score", 4).alias("engagement_score"),
        fixed("posts_per_month", 2).alias("posts_per_month"), fixed("avg_likes_per_post", 2).alias("avg_likes"),
        fixed("avg_comments_per_post", 2).alias("avg_comments"))


def context_recent_posts(posts: DataFrame, accounts: DataFrame, n: int = 20) -> DataFrame:
    """Newest posts per competitor with a 200-character preview."""
    p = posts_of(posts, accounts)
    if "text" in p.columns:
        p = p.withColumn("content_preview", F.left("text", F.lit(200))).drop("text")
    return top_n_per_group(p, ["competitor_id"], [F.desc("publish_time"), F.desc("id"), F.desc("like_count")], n)


def context_categories(products: DataFrame, n: int = 10) -> DataFrame:
    return top_categories(products, n)


def context_issues(plan: DataFrame, n: int = 5) -> DataFrame:
    return top_n_per_group(plan, ["competitor_id"], [F.desc("total_priority"), F.asc("issue")], n).select(
        "competitor_id", "issue", "total_affected_pages", "total_priority", "priority_level")


def analysis_bundle(scores: DataFrame, series: DataFrame, posts: DataFrame, accounts: DataFrame, max_rows: int = 90,
                    posts_each: int = 5) -> DataFrame:
    """One JSON document per competitor and platform.

    Nested lists have a fixed greatest length: the newest ``max_rows`` series
    rows and ``posts_each`` top posts.
    """
    keys = ["competitor_id", "platform"]
    s = top_n_per_group(series, keys, [F.desc("snapshot_date")], max_rows)
    s = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("snapshot_date", "score", "momentum"))).alias("series"))
    p = posts_of(posts, accounts).withColumn("total_engagement", engagement().cast("bigint"))
    p = top_n_per_group(p, keys, [F.desc("total_engagement"), F.asc("id"), F.asc("publish_time")], posts_each)
    p = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "total_engagement"))).alias("posts"))
    out = scores.select(*keys, "score", "engagement_score").join(s, keys, "left").join(p, keys, "left")
    return out.select(*keys, F.to_json(F.struct("score", "engagement_score", "series", "posts")).alias("document"))


def latest_analyses(analyses: DataFrame, n: int = 5) -> DataFrame:
    """Newest stored analyses per competitor."""
    return top_n_per_group(analyses, ["competitor_id"], [F.desc("analysis_date"), F.desc("id")], n)


def smoothed_tail(smoothed: DataFrame, n: int = 10) -> DataFrame:
    """Newest smoothed forecasts of each competitor, ordered by platform then day."""
    w = Window.partitionBy("competitor_id").orderBy(F.asc("platform"), F.desc("snapshot_date"))
    return smoothed.withColumn("position", F.row_number().over(w).cast("bigint")).filter(F.col("position") <= n)
