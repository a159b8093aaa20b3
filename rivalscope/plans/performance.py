"""Page speed and overall page scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import band, fixed, weighted

# Metric, score column, upper bounds with scores, weight.
SPEED_RULES = [
    ("ttfb", "ttfb_score", [(200, 1), (500, 0.8), (1000, 0.6), (2000, 0.3)], 0.20),
    ("first_paint", "fp_score", [(1000, 1), (2000, 0.7), (3000, 0.4)], 0.20),
    ("dom_interactive", "di_score", [(1000, 1), (2000, 0.7), (4000, 0.4)], 0.20),
    ("dom_complete", "dc_score", [(2000, 1), (4000, 0.7), (6000, 0.4)], 0.15),
    ("page_size", "ps_score", [(200000, 1), (500000, 0.7), (1000000, 0.4)], 0.10),
    ("dom_size", "dom_score", [(800, 1), (1500, 0.7), (3000, 0.4)], 0.10),
    ("resource_count", "res_score", [(30, 1), (60, 0.7), (100, 0.4)], 0.05),
]
SPEED_SCORES = [name for _, name, _, _ in SPEED_RULES]


def with_speed_scores(pages: DataFrame, minus_one: str = "null") -> DataFrame:
    """Banded scores from the technical metadata, parsed once per row.

    ``minus_one="null"`` reads -1 as missing; ``"value"`` takes it as a number.
    """
    missing = {"null": -1.0, "value": None}[minus_one]
    kind = "struct<" + ",".join(f"{m}:double" for m, _, _, _ in SPEED_RULES) + ">"
    parsed = pages.withColumn("_m", F.from_json("technical_metadata", kind))
    scored = parsed.withColumns({name: band(F.col(f"_m.{metric}"), bands, 0.0, missing)
                                 for metric, name, bands, _ in SPEED_RULES})
    mix = {name: w for _, name, _, w in SPEED_RULES}
    return scored.withColumn("page_speed_score", weighted(mix, places=4)).drop("_m")


def page_performance_scores(pages: DataFrame, competitors: DataFrame, minus_one: str = "null") -> DataFrame:
    names = competitors.select(F.col("id").alias("competitor_id"), "domain")
    return (with_speed_scores(pages, minus_one).join(names, "competitor_id", "left")
            .select("url_hash", "competitor_id", "domain", *SPEED_SCORES, "page_speed_score"))


def page_overall_scores(pages: DataFrame, seo: DataFrame, minus_one: str = "null") -> DataFrame:
    """0.7 SEO + 0.3 speed. Speed is derived from the page row itself, so only the SEO side is joined."""
    speed = with_speed_scores(pages, minus_one).select(
        "url_hash", "competitor_id", fixed(F.col("page_speed_score") * 100, 2).alias("page_speed_score"))
    s = seo.select(F.col("page_url_hash").alias("url_hash"), F.col("overall_score").alias("seo_score"))
    mix = {"seo_score": 0.7, "page_speed_score": 0.3}
    return speed.join(s, "url_hash", "left").select(
        "url_hash", "competitor_id", "seo_score", "page_speed_score", weighted(mix, places=4).alias("overall_score"))


def competitor_page_scores(overall: DataFrame, score: str = "overall_score") -> DataFrame:
    return overall.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        fixed(F.avg(score), 4).alias("avg_score"),
        fixed(F.median(score), 4).alias("median_score"),
        fixed(F.min(score), 4).alias("worst_page_score"),
        fixed(F.max(score), 4).alias("best_page_score"))


def page_type_scores(overall: DataFrame, pages: DataFrame) -> DataFrame:
    typed = overall.drop("competitor_id").join(pages.select("url_hash", "competitor_id", "page_type"), ["url_hash"])
    return typed.groupBy("competitor_id", "page_type").agg(fixed(F.avg("overall_score"), 4).alias("avg_score"))


def speed_breakdown(performance: DataFrame, competitor_id: int | None = None) -> DataFrame:
    """Mean of every banded score, for one competitor or for each."""
    means = [fixed(F.avg(c), 6).alias(f"avg_{c}") for c in [*SPEED_SCORES, "page_speed_score"]]
    if competitor_id is not None:
        return performance.filter(F.col("competitor_id") == competitor_id).agg(*means)
    return performance.groupBy("competitor_id").agg(*means)


def performance_ranking(page_scores: DataFrame, competitors: DataFrame) -> DataFrame:
    names = competitors.select(F.col("id").alias("competitor_id"), "domain")
    return (page_scores.join(names, "competitor_id")
            .select("competitor_id", "domain", "total_pages", "avg_score", "median_score",
                    "worst_page_score", "best_page_score")
            .orderBy(F.desc_nulls_last("avg_score"), "competitor_id"))
