"""Sitemap files: entries, index resolution and name classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import as_col
from ..session import ensure_checkpoint_dir

_ENTRY = "struct<loc:string,lastmod:string,changefreq:string,priority:string>"


def _clean(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def sitemap_entries(files: DataFrame, source: str = "sitemap_url", text: str = "xml") -> DataFrame:
    """Entries of urlset files held as text (source, xml)."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)(<url>.*?</url>)"), 1)
    e = F.from_xml(F.col("_b"), _ENTRY, {"mode": "PERMISSIVE"})
    return _entry_rows(files.select(F.col(source).alias("source_sitemap"), F.explode(blocks).alias("_b"))
                       .select("source_sitemap", e.alias("e")).select("source_sitemap", "e.*"))


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of urlset files in a folder; large files are split by the XML reader."""
    df = spark.read.format("xml").option("rowTag", "url").schema(
        "loc string, lastmod string, changefreq string, priority string").load(path)
    return _entry_rows(df.select(F.col("_metadata.file_path").alias("source_sitemap"), "*"))


def _entry_rows(df: DataFrame) -> DataFrame:
    return df.select("source_sitemap", _clean(F.col("loc")).alias("loc"), _clean(F.col("lastmod")).alias("lastmod"),
                     _clean(F.col("changefreq")).alias("changefreq"),
                     F.trim("priority").try_cast("double").alias("priority")).filter(F.col("loc").isNotNull())


def sitemap_children(files: DataFrame, source: str = "sitemap_url", text: str = "xml") -> DataFrame:
    """(parent, child) edges of sitemap index files."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<sitemap>.*?<loc>(.*?)</loc>.*?</sitemap>"), 1)
    return (files.select(F.col(source).alias("parent"), F.explode(blocks).alias("child"))
            .select("parent", F.trim("child").alias("child")).filter(F.col("child") != ""))


def resolve_sitemaps(seeds: DataFrame, edges: DataFrame, max_sitemaps: int | None = None) -> DataFrame:
    """Every file reachable from a seed, with root, shortest depth and smallest parent there.

    ``seeds`` has column url, ``edges`` has parent and child. Each level joins
    the last one's files with their edges and leaves out what was seen before,
    until nothing new is found; a level is checkpointed, so lineage stays short.
    ``max_sitemaps`` keeps that many files per root, nearest first.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    step = edges.select(F.col("parent").alias("url"), "child")
    level = seeds.select(F.col("url").alias("root"), "url", F.lit(0).alias("depth"),
                         F.lit(None).cast("string").alias("parent")).distinct().checkpoint()
    out = level
    while level.take(1):
        new = level.join(step, "url").select("root", F.col("child").alias("url"), F.col("depth") + 1, F.col("url").alias("parent")).toDF(
            "root", "url", "depth", "parent")
        level = (new.join(out.select("root", "url"), ["root", "url"], "left_anti")
                 .groupBy("root", "url").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent")).checkpoint())
        out = out.unionByName(level)
    if max_sitemaps is None:
        return out
    w = Window.partitionBy("root").orderBy("depth", "url")
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_sitemaps).drop("_n")


def classify_sitemap_name(c: Column | str) -> Column:
    """product, category or other from a sitemap file name; NULL without a sign."""
    name = F.lower(F.element_at(F.split(F.regexp_replace(as_col(c), r"[?#].*$", ""), "/"), -1))
    # Name patterns in the order they are tried.
    skip = r"post[-_]sitemap|page[-_]sitemap|cms[-_]block[-_]sitemap|portfolio[-_]sitemap|product[_-]tag[-_]sitemap|basel[_-]sidebar[-_]sitemap|author[-_]sitemap"
    product = r"product[-_]sitemap|produit[-_]sitemap|sitemap[-_]product"
    category = r"category[-_]sitemap|categorie[-_]sitemap|product[_-]cat[-_]sitemap|project[_-]cat[-_]sitemap|sitemap[-_]categor"
    return (F.when(name.rlike(skip), "other").when(name.rlike(product), "product").when(name.rlike(category), "category"))
