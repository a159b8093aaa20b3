"""Market scores: category coverage, balance, assortment and availability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import completeness, fixed, ratio, weighted
from ..functions.text import normalize_text
from ..operators.relational import anti_join

CATEGORY_CAP = 25


def _per_category(products: DataFrame, accents: bool = True) -> DataFrame:
    """Products reduced to one row per competitor and category, the only pass over products."""
    return products.groupBy("competitor_id", normalize_text("category", accents).alias("category_key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("in_stock")).alias("n_stock"),
        F.sum(completeness()).alias("points"))


def active_categories(target_categories: DataFrame) -> DataFrame:
    return target_categories.filter("is_active").select(
        F.col("normalized_name").alias("category_key"), F.col("relevance_weight").cast("double").alias("weight"))


def complete_grid_totals(competitors: DataFrame, products: DataFrame, target_categories: DataFrame) -> DataFrame:
    """Capped weighted category counts of every competitor.

    A category without products adds zero, so the full competitor x category
    grid is never built: matched cells are summed and missing competitors get 0.
    """
    cats = active_categories(target_categories)
    cells = _per_category(products).join(cats, "category_key")
    sums = cells.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("filled_cells"),
        F.sum(F.least("n", F.lit(CATEGORY_CAP)) * F.col("weight")).alias("capped_weight"))
    return (competitors.select(F.col("id").alias("competitor_id")).join(sums, "competitor_id", "left")
            .na.fill(0, ["filled_cells", "capped_weight"]))


def competitor_market_scores(competitors: DataFrame, products: DataFrame, target_categories: DataFrame) -> DataFrame:
    cats = active_categories(target_categories)
    total = cats.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("t")).scalar()
    cells = _per_category(products).join(cats, "category_key", "left")
    matched = F.col("weight").isNotNull()
    sums = cells.groupBy("competitor_id").agg(
        F.sum("weight").alias("matched_weight"),
        F.sum(F.least("n", F.lit(CATEGORY_CAP)) * F.col("weight")).alias("capped_weight"),
        F.sum(F.when(matched, F.col("points"))).alias("points"),
        F.sum(F.when(matched, F.col("n"))).alias("n_matched"),
        F.sum("n_stock").alias("n_stock"), F.sum("n").alias("n"))
    joined = competitors.select(F.col("id").alias("competitor_id"), F.col("domain").alias("competitor_domain")).join(
        sums, "competitor_id", "left")

    def score(num, den):
        return F.coalesce(fixed(num, 2) if den is None else fixed(ratio(num, den) * 100, 2), F.lit(0.0))

    out = joined.select(
        "competitor_id", "competitor_domain",
        score(F.col("matched_weight"), total).alias("coverage_score"),
        score(F.col("capped_weight"), total * CATEGORY_CAP).alias("category_balance_score"),
        score(ratio("points", "n_matched"), None).alias("assortment_score"),
        score(F.col("n_stock"), F.col("n")).alias("availability_score"))
    mix = {"coverage_score": 0.40, "category_balance_score": 0.25, "assortment_score": 0.20, "availability_score": 0.15}
    return out.withColumn("final_score", weighted(mix, places=2))


def competitor_market_scores_simple(competitors: DataFrame, products: DataFrame,
                                    target_categories: DataFrame) -> DataFrame:
    """Coverage and availability only; category names keep their accents."""
    cats = target_categories.filter("is_active").select(
        normalize_text("category_name", accents=False).alias("category_key"),
        F.col("relevance_weight").cast("double").alias("weight"))
    total = cats.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("t")).scalar()
    sums = _per_category(products, accents=False).join(cats, "category_key", "left").groupBy("competitor_id").agg(
        F.sum("weight").alias("w"), F.sum("n_stock").alias("n_stock"), F.sum("n").alias("n"))
    out = competitors.select(F.col("id").alias("competitor_id"), F.col("domain").alias("competitor_domain")).join(
        sums, "competitor_id", "left").select(
        "competitor_id", "competitor_domain",
        F.coalesce(fixed(ratio("w", total) * 100, 2), F.lit(0.0)).alias("coverage_score"),
        F.lit(0.0).alias("category_balance_score"), F.lit(0.0).alias("assortment_score"),
        F.coalesce(fixed(ratio("n_stock", "n") * 100, 2), F.lit(0.0)).alias("availability_score"))
    return out.withColumn("final_score", weighted({"coverage_score": 0.40, "availability_score": 0.15}, places=2))


def distinct_matches(products: DataFrame, target_categories: DataFrame) -> DataFrame:
    """Distinct target categories each competitor sells."""
    keys = products.select("competitor_id", normalize_text("category").alias("category_key")).distinct()
    return keys.join(active_categories(target_categories), "category_key")


def matched_products(products: DataFrame, target_categories: DataFrame) -> DataFrame:
    """Products in any active target category."""
    keyed = products.withColumn("category_key", normalize_text("category"))
    return keyed.join(active_categories(target_categories), "category_key", "left_semi")


def add_category(categories: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split new categories into accepted rows, with the parent id looked up, and rejected duplicates.

    ``new`` has category_name, parent_category_name, relevance_weight.
    """
    keyed = new.withColumn("normalized_name", normalize_text("category_name"))
    known = categories.select("normalized_name")
    accepted = anti_join(keyed, known, ["normalized_name"]).dropDuplicates(["normalized_name"])
    parents = categories.select(F.col("id").alias("parent_category_id"), F.col("normalized_name").alias("_parent"))
    resolved = (accepted.withColumn("_parent", normalize_text("parent_category_name"))
                .join(parents, "_parent", "left").drop("_parent"))
    return resolved, keyed.join(known, "normalized_name", "left_semi")


def category_tree(categories: DataFrame) -> DataFrame:
    """Each category with its parent's name."""
    parent = categories.select(F.col("id").alias("parent_category_id"), F.col("category_name").alias("parent_name"))
    return categories.join(parent, "parent_category_id", "left")
