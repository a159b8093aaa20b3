"""Competitor lists, comparison, profile, listings and overview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import fixed, mean_available, where_in, where_optional
from ..operators.search import like_pattern, search
from ..operators.relational import one_row, page, top_n_per_group, topk, with_counts


def _social_mean(social: DataFrame) -> DataFrame:
    return social.groupBy(F.col("competitor_id").alias("id")).agg(fixed(F.avg("score"), 4).alias("social_score"))


def competitor_list(competitors: DataFrame, summary: DataFrame, page_scores: DataFrame, social: DataFrame,
                    market: DataFrame, pages: DataFrame, products: DataFrame) -> DataFrame:
    """Every competitor with its four scores and counts. Facts are reduced to one row per competitor first."""
    out = competitors.select("id", "domain", "name")
    for frame, cols in ((summary, {"avg_seo_score": "seo_score"}), (page_scores, {"avg_score": "perf_score"}),
                        (market, {"final_score": "market_score"})):
        out = out.join(frame.select(F.col("competitor_id").alias("id"), *[F.col(a).alias(b) for a, b in cols.items()]),
                       "id", "left")
    out = out.join(_social_mean(social), "id", "left")
    out = with_counts(out, "id", {"page_count": (pages, "competitor_id"), "product_count": (products, "competitor_id")})
    return out.select("id", "domain", "name", "seo_score", "perf_score", "social_score", "market_score",
                      "page_count", "product_count")


def scorecard(competitors: DataFrame, summary: DataFrame, page_scores: DataFrame, market: DataFrame,
              social: DataFrame) -> DataFrame:
    """Left joins of all score tables on the competitor."""
    s = summary.select(F.col("competitor_id").alias("id"), "avg_seo_score", "avg_content_score", "avg_on_page_score",
                       "avg_technical_score", "avg_ux_score")
    p = page_scores.select(F.col("competitor_id").alias("id"), F.col("avg_score").alias("perf_score"), "total_pages")
    m = market.select(F.col("competitor_id").alias("id"), F.col("final_score").alias("market_score"), "coverage_score",
                      "category_balance_score", "assortment_score")
    return (competitors.select("id", "domain", "name").join(s, "id", "left").join(p, "id", "left").join(m, "id", "left")
            .join(_social_mean(social), "id", "left")
            .withColumn("social_score", F.coalesce("social_score", F.lit(0.0))))


def price_range(products: DataFrame) -> DataFrame:
    """Product counts, stock and price range in one pass over the products."""
    price = F.col("current_price").cast("double")
    return products.groupBy(F.col("competitor_id").alias("id")).agg(
        F.count(F.lit(1)).alias("product_count"), F.count_if(F.col("in_stock")).alias("in_stock_count"),
        fixed(F.min(price), 2).alias("min_price"), fixed(F.max(price), 2).alias("max_price"),
        fixed(F.avg(price), 2).alias("avg_price"), F.count(price).alias("priced_products"))


def top_categories(products: DataFrame, n: int = 10) -> DataFrame:
    """The n largest categories of each competitor with product count and mean price."""
    counts = products.filter(F.col("category").isNotNull()).groupBy("competitor_id", "category").agg(
        F.count(F.lit(1)).alias("product_count"), fixed(F.avg(F.col("current_price").cast("double")), 2).alias("avg_price"))
    return top_n_per_group(counts, ["competitor_id"], [F.desc("product_count"), F.asc("category")], n)


def compare(ids: Sequence[int], competitors: DataFrame, summary: DataFrame, page_scores: DataFrame, market: DataFrame,
            social: DataFrame, products: DataFrame) -> DataFrame:
    """One comparison row per chosen competitor: scores, price range, top categories, composite score."""
    chosen = where_in(competitors, "id", ids)
    mine = products.filter(F.col("competitor_id").isin(list(ids)))
    return comparison(chosen, summary, page_scores, market, social, mine)


def comparison(competitors: DataFrame, summary: DataFrame, page_scores: DataFrame, market: DataFrame,
               social: DataFrame, products: DataFrame) -> DataFrame:
    """The comparison row of every given competitor. At most ten categories are nested per row."""
    nested = top_categories(products).groupBy(F.col("competitor_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "category", F.col("product_count").alias("count")))).alias("categories"))
    ranges = price_range(products)
    card = scorecard(competitors, summary, page_scores, market, social)
    out = card.join(ranges, "id", "left").join(nested, "id", "left")
    return out.withColumn("composite_score", mean_available("avg_seo_score", "perf_score", "social_score", "market_score"))


def accounts_of(accounts: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Accounts of the compared competitors as rows, not as one nested list."""
    return where_in(accounts, "competitor_id", ids)


def competitor_profile(competitor_id: int | None, competitors: DataFrame, summary: DataFrame, page_scores: DataFrame,
                       market: DataFrame) -> DataFrame:
    """All score dimensions of one competitor (or of each)."""
    who = where_optional(competitors.select("id", "domain", "name"), id=competitor_id)
    s = summary.select(F.col("competitor_id").alias("id"), "avg_seo_score", "median_seo_score", "avg_content_score",
                       "avg_on_page_score", "avg_technical_score", "avg_ux_score")
    p = page_scores.select(F.col("competitor_id").alias("id"), F.col("avg_score").alias("avg_perf_score"),
                           F.col("median_score").alias("median_perf_score"), "total_pages")
    m = market.select(F.col("competitor_id").alias("id"), F.col("final_score").alias("market_score"), "coverage_score",
                      "category_balance_score", "assortment_score", "availability_score")
    return who.join(s, "id", "left").join(p, "id", "left").join(m, "id", "left")


def pages_page(pages: DataFrame, overall: DataFrame, competitor_id: int | None = None, number: int = 1, size: int = 50,
               page_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of a competitor's pages by score, and the total."""
    mine = where_optional(pages, competitor_id=competitor_id)
    listed = where_optional(mine, page_type=page_type).join(
        overall.select("url_hash", "seo_score", "page_speed_score", "overall_score"), "url_hash", "left")
    return (page(listed, [F.desc_nulls_last("overall_score"), F.asc("url_hash")], number, size),
            mine.agg(F.count(F.lit(1)).alias("total")))


def products_page(products: DataFrame, competitor_id: int | None = None, number: int = 1, size: int = 50,
                  in_stock: bool | None = None) -> tuple[DataFrame, DataFrame]:
    mine = where_optional(products, competitor_id=competitor_id)
    listed = where_optional(mine, in_stock=in_stock)
    return (page(listed, [F.desc_nulls_last("last_updated_at"), F.asc("id")], number, size),
            mine.agg(F.count(F.lit(1)).alias("total")))


def search_products(products: DataFrame, competitors: DataFrame, text: str, limit: int = 20,
                    competitor_id: int | None = None, index: str | None = None) -> DataFrame:
    """Products whose title or category contains a text, newest first; ``index``: folder of their gram index."""
    mine = where_optional(products, competitor_id=competitor_id)
    if index is not None:
        hits = search(mine, index, "id", ["title", "category"], text)
    else:
        like = like_pattern(text)
        hits = mine.filter(F.col("title").ilike(like) | F.col("category").ilike(like))
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("domain").alias("competitor_domain"))
    return topk(hits.join(names, "competitor_id"), [F.desc_nulls_last("last_updated_at"), F.asc("id")], limit)


def history(rows: DataFrame, product_id: int | None, limit: int = 90) -> DataFrame:
    """Newest history rows of one product, or of each product when none is given."""
    order = [F.desc("recorded_at"), F.desc("id")]
    if product_id is not None:
        return topk(rows.filter(F.col("product_id") == product_id), order, limit)
    return top_n_per_group(rows, ["product_id"], order, limit)


def overview_kpis(competitors: DataFrame, pages: DataFrame, products: DataFrame, jobs: DataFrame,
                  active: Sequence[str] = ("queued", "inflight", "retry_scheduled")) -> DataFrame:
    """Counts for the overview as one row."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))
    status = F.col("status")
    return one_row(n(competitors, "competitors_total"), n(pages, "pages_total"), n(products, "products_total"),
                   jobs.agg(F.count_if(status.isin(list(active))).alias("jobs_active"),
                            F.count_if(status == "failed").alias("jobs_failed"),
                            F.count_if(status == "completed").alias("jobs_completed")))


def score_overview(summary: DataFrame, page_scores: DataFrame, social: DataFrame, market: DataFrame) -> DataFrame:
    """Mean of each score over all competitors. SEO and speed means are NULL when either table is empty."""
    row = one_row(summary.agg(F.avg("avg_seo_score").alias("s")), page_scores.agg(F.avg("avg_score").alias("p")),
                  social.agg(fixed(F.avg("score"), 4).alias("avg_social")),
                  market.agg(fixed(F.avg("final_score"), 2).alias("avg_market")))
    both = F.col("s").isNotNull() & F.col("p").isNotNull()
    return row.select(F.when(both, fixed("s", 2)).alias("avg_seo"), F.when(both, fixed("p", 2)).alias("avg_perf"),
                      "avg_social", "avg_market")


def critical_issues(plan: DataFrame, n: int = 10, level: str = "critical") -> DataFrame:
    return topk(plan.filter(F.col("priority_level") == level)
                .select("competitor_id", "issue", "total_affected_pages", "total_priority"),
                [F.desc("total_priority"), F.asc("competitor_id"), F.asc("issue")], n)


def ranked(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """Listing by a score, best first."""
    order: list[Column] = [F.desc_nulls_last(score), *[F.asc(t) for t in ties]]
    return df.orderBy(*order)
