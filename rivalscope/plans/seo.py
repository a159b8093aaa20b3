"""Page SEO scores, competitor summary and gap matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import fixed, weighted
from ..operators.relational import latest_by, pairwise_gap

SCORES = ("content_score", "on_page_score", "technical_score", "overall_score", "ux_score")


def _ux_score():
    """Breadcrumbs, lists, paragraph length, internal and external links."""
    parts = [
        (F.col("has_breadcrumbs"), 60, 0.25),
        (F.col("bullet_list_count") + F.col("number_list_count") > 0, 70, 0.20),
        (F.col("avg_paragraph_word_count").between(40, 120), 50, 0.25),
        (F.col("internal_links_count") > 10, 70, 0.15),
        (F.col("external_links_count") > 0, 80, 0.15),
    ]
    return weighted([(F.when(test, 100).otherwise(low), w) for test, low, w in parts])


def page_seo_scores(snapshots: DataFrame, all_snapshots: bool = False) -> DataFrame:
    """One scored row per page (its newest snapshot), or per snapshot.

    Scores are computed before the newest row is picked: the shuffle carries
    five numbers per snapshot, not the stored JSON.
    """
    names = ["content_score", "on_page_score", "technical_score", "overall_seo_score"]
    kind = "struct<scores:struct<" + ",".join(f"{n}_percent:string" for n in names) + ">>"
    parsed = snapshots.withColumn("_r", F.from_json("seo_flags", kind))

    def stored(name: str):
        return F.coalesce(F.col(f"_r.scores.{name}_percent").try_cast("double"), F.lit(70.0))

    scored = parsed.select(
        "page_url_hash", "id", "created_at",
        stored("content_score").alias("content_score"),
        stored("on_page_score").alias("on_page_score"),
        stored("technical_score").alias("technical_score"),
        stored("overall_seo_score").alias("overall_score"),
        _ux_score().alias("ux_score"))
    if not all_snapshots:
        scored = latest_by(scored, ["page_url_hash"],
                           ["created_at", "id", "content_score", "ux_score"])
    mix = {"overall_score": 0.50, "content_score": 0.20, "on_page_score": 0.15,
           "technical_score": 0.10, "ux_score": 0.05}
    return scored.select("id", "page_url_hash", *[fixed(c, 2).alias(c) for c in SCORES],
                         weighted(mix, places=2).alias("page_seo_score"))


def competitor_seo_summary(page_scores: DataFrame, pages: DataFrame, competitors: DataFrame) -> DataFrame:
    """Mean, median and spread of page scores per competitor.

    Scores have two decimals, so the exact median keeps at most some ten
    thousand distinct values per group however many pages there are.
    """
    grouped = (page_scores.join(pages.select(F.col("url_hash").alias("page_url_hash"), "competitor_id"), "page_url_hash")
               .groupBy("competitor_id").agg(
                   F.count(F.lit(1)).alias("total_pages"),
                   fixed(F.avg("page_seo_score"), 2).alias("avg_seo_score"),
                   fixed(F.median("page_seo_score"), 2).alias("median_seo_score"),
                   fixed(F.avg("content_score"), 2).alias("avg_content_score"),
                   fixed(F.avg("on_page_score"), 2).alias("avg_on_page_score"),
                   fixed(F.avg("technical_score"), 2).alias("avg_technical_score"),
                   fixed(F.avg("ux_score"), 2).alias("avg_ux_score"),
                   fixed(F.stddev_samp("page_seo_score"), 2).alias("seo_stddev")))
    names = competitors.select(F.col("id").alias("competitor_id"), "domain")
    return grouped.join(names, "competitor_id").select(
        "competitor_id", "domain", *[c for c in grouped.columns if c != "competitor_id"])


def competitor_gap_matrix(summary: DataFrame, blocks: int = 16) -> DataFrame:
    """Score differences of every ordered pair of competitors."""
    dims = ["seo", "content", "on_page", "technical", "ux"]
    pairs = pairwise_gap(summary, "competitor_id", [f"avg_{d}_score" for d in dims], blocks)
    name = summary.select("competitor_id", "domain")
    return (pairs.join(name.toDF("key_a", "domain_a"), "key_a").join(name.toDF("key_b", "domain_b"), "key_b")
            .select("domain_a", F.col("key_a").alias("competitor_a"), "domain_b", F.col("key_b").alias("competitor_b"),
                    *[fixed(f"avg_{d}_score_gap", 2).alias(f"{d}_gap") for d in dims]))
