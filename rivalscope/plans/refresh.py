"""Refresh of all derived tables in dependency order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sinks.writers import overwrite, overwrite_partitions
from . import issues, market, performance, seo, social

#: Derived tables and the tables each one reads.
DEPENDS: dict[str, list[str]] = {
    "page_seo_scores": ["page_snapshots"],
    "competitor_seo_summary": ["page_seo_scores", "web_pages", "competitors"],
    "competitor_gap_matrix": ["competitor_seo_summary"],
    "competitor_top_issues": ["page_snapshots", "web_pages"],
    "competitor_action_plan": ["competitor_top_issues"],
    "page_performance_scores": ["web_pages", "competitors"],
    "page_overall_scores": ["web_pages", "page_seo_scores"],
    "competitor_page_scores": ["page_overall_scores"],
    "page_type_scores": ["page_overall_scores", "web_pages"],
    "competitor_market_scores": ["competitors", "products", "target_categories"],
    "competitor_social_score": ["social_accounts", "social_account_metrics", "social_posts"],
    "competitor_social_score_history": ["competitor_social_score"],
    "competitor_social_time_series": ["competitor_social_score_history"],
    "forecast_regression": ["competitor_social_score_history"],
    "forecast_momentum": ["competitor_social_time_series"],
    "forecast_smoothed": ["competitor_social_score_history"],
    "post_daily_metrics": ["social_post_metrics"],
}


def _builders(as_of, as_of_date) -> dict[str, Callable[..., DataFrame]]:
    return {
        "page_seo_scores": seo.page_seo_scores,
        "competitor_seo_summary": seo.competitor_seo_summary,
        "competitor_gap_matrix": seo.competitor_gap_matrix,
        "competitor_top_issues": issues.competitor_top_issues,
        "competitor_action_plan": issues.competitor_action_plan,
        "page_performance_scores": performance.page_performance_scores,
        "page_overall_scores": performance.page_overall_scores,
        "competitor_page_scores": performance.competitor_page_scores,
        "page_type_scores": performance.page_type_scores,
        "competitor_market_scores": market.competitor_market_scores,
        "competitor_social_score": lambda a, m, p: social.competitor_social_score(a, m, p, as_of),
        "competitor_social_score_history": lambda s: social.snapshot_scores(s, as_of_date),
        "competitor_social_time_series": social.social_time_series,
        "forecast_regression": lambda h: social.forecast_regression(h, as_of_date),
        "forecast_momentum": lambda s: social.forecast_momentum(s, as_of_date),
        "forecast_smoothed": social.forecast_smoothed,
        "post_daily_metrics": social.post_daily_metrics,
    }


def refresh_order(names: list[str] | None = None) -> list[str]:
    """Derived tables so that every table follows the ones it reads."""
    done: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS.get(name, []):
            visit(dep)
        if name in DEPENDS and name not in done:
            done.append(name)

    for n in names or DEPENDS:
        visit(n)
    return done


def refresh_all(spark: SparkSession, inputs: dict[str, DataFrame], out_dir: str, as_of, as_of_date,
                only: list[str] | None = None) -> list[str]:
    """Write every derived table; each step reads the files of the steps before it.

    The score history keeps its other days: only the partition of ``as_of_date``
    is replaced, so a second run of the day changes nothing else.
    """
    build = _builders(as_of, as_of_date)

    def source(name: str) -> DataFrame:
        return spark.read.parquet(f"{out_dir}/{name}") if name in DEPENDS else inputs[name]

    written = []
    for name in refresh_order(only):
        if any(d not in DEPENDS and d not in inputs for d in DEPENDS[name]):
            continue
        df = build[name](*[source(d) for d in DEPENDS[name]])
        path = f"{out_dir}/{name}"
        if name == "competitor_social_score_history":
            overwrite_partitions(df, path, "snapshot_date")
        else:
            overwrite(df, path)
        written.append(name)
    return written
