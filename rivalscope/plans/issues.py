"""Issue lists and action plans from stored audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import fixed, label, ratio
from ..functions.text import issue_key, issue_numbers

_ISSUES = "struct<scores:struct<content_issues:array<string>,on_page_issues:array<string>,technical_issues:array<string>>>"


def issue_array(seo_flags: str = "seo_flags") -> Column:
    """The three stored issue lists as one array."""
    lists = F.from_json(seo_flags, _ISSUES)["scores"]
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(lists[n], empty) for n in ("content_issues", "on_page_issues", "technical_issues")])


def issues_long(snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per snapshot issue with its competitor."""
    lists = snapshots.select("page_url_hash", issue_array().alias("_issues"))
    owner = pages.select(F.col("url_hash").alias("page_url_hash"), "competitor_id")
    # The outer form keeps the optimizer from parsing the JSON a second time in a filter.
    return lists.join(owner, "page_url_hash").select(
        "competitor_id", "page_url_hash", F.explode_outer("_issues").alias("issue")).filter(F.col("issue").isNotNull())


def issue_impact(issue: str = "issue") -> Column:
    """Penalty, else lost score, else the first number, else 1.

    A plain text test comes before each pattern, so most patterns are not run.
    """
    n = issue_numbers(issue)
    text = F.col(issue)
    score = F.when(text.contains("Score:"), n["score_value"])
    return F.coalesce(
        F.when(text.contains("Penalty:"), n["penalty_value"]),
        F.when(score.isNotNull(), n["score_max"] - score).otherwise(F.coalesce(n["raw_number"], F.lit(1.0))))


def competitor_top_issues(snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues of a competitor by impact, reach and priority.

    Snapshots are reduced to one row per page and issue text before they meet
    the pages, so a page with very many snapshots is spread by issue, stays
    small in the join, and each text is matched against the patterns once. One issue row of each page is then marked; the marks add
    up to the competitor's page count, so no distinct aggregate and no second
    pass over the snapshots is needed. The windows at the end run over one row
    per distinct issue text of a competitor.
    """
    long = snapshots.select("page_url_hash", F.explode_outer(issue_array()).alias("issue")).filter(F.col("issue").isNotNull())
    texts = long.groupBy("page_url_hash", "issue").agg(F.count(F.lit(1)).alias("n"))
    owner = pages.select(F.col("url_hash").alias("page_url_hash"), "competitor_id")
    per_page = (texts.join(owner, "page_url_hash")
                .select("page_url_hash", "competitor_id", issue_key("issue").alias("issue"), "n",
                        (issue_impact() * F.col("n")).alias("impact"))
                .groupBy("page_url_hash", "competitor_id", "issue").agg(F.sum("n").alias("n"), F.sum("impact").alias("impact")))
    first = F.row_number().over(Window.partitionBy("page_url_hash").orderBy("issue")) == 1
    per_issue = per_page.withColumn("mark", first.cast("int")).groupBy("competitor_id", "issue").agg(
        F.sum("n").alias("occurrence_count"), F.count(F.lit(1)).alias("affected_pages"),
        F.sum("impact").alias("total_impact"), F.sum("mark").alias("mark"))
    whole = Window.partitionBy("competitor_id")
    metrics = (per_issue.withColumns({"_impact": F.sum("total_impact").over(whole), "_pages": F.sum("mark").over(whole)})
               .withColumn("impact_ratio", fixed(ratio("total_impact", "_impact"), 4))
               .withColumn("coverage_ratio", fixed(ratio("affected_pages", "_pages"), 4))
               .withColumn("priority_score", fixed(
                   (F.col("impact_ratio") * 0.6 + F.col("coverage_ratio") * 0.4)
                   * F.log10(F.lit(1) + F.col("affected_pages")), 4)))
    order = Window.partitionBy("competitor_id").orderBy(F.desc("priority_score"), "issue")
    return metrics.select(
        "competitor_id", "issue", "occurrence_count", "affected_pages",
        fixed("total_impact", 2).alias("total_impact"),
        fixed(ratio("total_impact", "occurrence_count"), 2).alias("avg_impact"),
        "impact_ratio", "coverage_ratio", "priority_score",
        F.row_number().over(order).cast("bigint").alias("rank"))


def competitor_action_plan(top_issues: DataFrame) -> DataFrame:
    plan = top_issues.groupBy("competitor_id", "issue").agg(
        F.sum("priority_score").alias("total_priority"), F.avg("priority_score").alias("avg_priority"),
        F.sum("affected_pages").alias("total_affected_pages"))
    level = label("total_priority", above=[(0.5, "critical"), (0.2, "high"), (0.1, "medium")], otherwise="low")
    return plan.withColumn("priority_level", level)


def competitor_action_plan_simple(snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """Issue counts only, with constant priority."""
    return (issues_long(snapshots, pages)
            .groupBy("competitor_id", F.lower(F.trim("issue")).alias("issue"))
            .agg(F.count(F.lit(1)).alias("total_affected_pages"))
            .select("competitor_id", "issue", "total_affected_pages", F.lit(1.0).alias("total_priority"),
                    F.lit(0.0).alias("avg_priority"), F.lit("low").alias("priority_level")))


def competitor_top_issues_simple(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Ranked by affected pages times their share; ties share a rank."""
    sizes = pages.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("_pages"))
    share = fixed(ratio("total_affected_pages", "_pages"), 4)
    w = Window.partitionBy("competitor_id").orderBy(F.desc("priority_score"))
    return (plan.join(sizes, "competitor_id")
            .select("competitor_id", "issue", F.col("total_affected_pages").alias("occurrence_count"),
                    F.col("total_affected_pages").alias("affected_pages"),
                    F.col("total_affected_pages").cast("double").alias("total_impact"),
                    F.lit(1.0).alias("avg_impact"), share.alias("impact_ratio"), share.alias("coverage_ratio"),
                    fixed(F.col("total_affected_pages") * share, 4).alias("priority_score"))
            .withColumn("rank", F.rank().over(w).cast("bigint")))
