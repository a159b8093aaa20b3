"""URL classes, URL discovery and page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_col
from ..functions.text import ascii_fold
from ..functions.urls import unquote, url_part
from ..sources.sitemaps import classify_sitemap_name

# URL patterns of each class in the order the classes are tried.
URL_PATTERNS: dict[str, list[str]] = {
    "other": [r"/author", r"/page/\d+"],
    "category": [r"(nos\-)?categor(?:y|ie|ies)?/[0-9a-zA-Z\-]+/?", r"/(nos\-)?categor", r"/collection[s]?/", r"/catalog\/?",
                 r"/products", r"/produits", r"/c/", r"/cat/", r"\/\d{1,3}-[0-9a-zA-Z+\-?]+\/?$", r"[nos\-]?marque[s]?"],
    "product": [r"/product[s]?/[0-9\w-]+/?", r"/produit[s]?/[0-9\w-]+/?", r"/item[s]?/[0-9\w-]+/?", r"/p/[0-9\w-]+/?",
                r"[a-zA-Z][a-zA-Z0-9-]+-\d+\.html$", r"[?&](?:id|pid|product_id|item_id)=\d+", r"/product/[0-9\w-]+/?$",
                r"/\w+/[a-zA-Z0-9-]+-[A-Z0-9]{6,}/?$"],
    "blog": [r"/blog[s]?", r"/article[s]?", r"/post[s]?", r"/tag[s]?", r"/wiki", r"/content"],
    "news": [r"/news", r"/actualit"],
    "about": [r"/about[\w-]*", r"/a[-_/]?propos[\w-]*", r"/qui[-_/]?sommes(?:[-_/]?nous)?"],
    "contact": [r"/contact[\w-]*"],
    "event": [r"/event[s]?[\w-]*", r"/evenement[s]?[\w-]*"],
    "promo": [r"/promo(?:tion)?s?", r"/offre[s]?", r"/pack[s]?"],
    "auth": [r"/login", r"/logout", r"password", r"register|registration", r"account", r"checkout", r"\bcart\b", r"wishlist"],
    "support": [r"ticket[s]?"],
    "rules": [r"conditions", r"mentions", r"politique", r"confidentialite"],
}
# Path segments under which products lie.
SHOP_ROOTS = ["shop", "boutique", "cat", "produits"]


def family(name: str) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in URL_PATTERNS[name])


def matchable(c: Column | str) -> Column:
    """URL as it is matched: decoded, ASCII, lower case."""
    return F.lower(ascii_fold(unquote(c)))


def classify_by_depth(c: Column | str) -> Column:
    """category or product from the depth below a shop root; NULL elsewhere."""
    path = url_part(F.lower(as_col(c)), "path")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    roots = F.array(*[F.lit(r) for r in SHOP_ROOTS])
    at = F.array_position(F.transform(segments, lambda s: F.array_contains(roots, s)), F.lit(True))
    last = F.try_element_at(segments, F.lit(-1))
    below = F.size(segments) - at
    slug = last.rlike(r"^[a-z0-9][a-z0-9-]{1,}$") & ~last.rlike(r"^\d+$")
    return F.when(at > 0, F.when(below <= 2, "category").when(slug, "product"))


def classify_url(c: Column | str, path_only: bool = False) -> Column:
    """One of twelve classes. All families sit in one projection; the first match wins.

    ``path_only`` leaves the host out, which by default can match a family.
    """
    full = matchable(c)
    u = F.regexp_replace(full, r"^[a-z][a-z0-9+.\-]*://[^/?#]*", "") if path_only else full
    out = None
    for name in URL_PATTERNS:
        hit = u.rlike(family(name))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out, classify_by_depth(full), F.lit("other"))


def classify_sitemap_entries(entries: DataFrame, loc: str = "loc", source: str = "source_sitemap") -> DataFrame:
    """Class from the sitemap file name, else from the URL."""
    return entries.withColumn("url_class", F.coalesce(classify_sitemap_name(source), classify_url(loc)))


def discover_urls(entries: DataFrame, homepage_links: DataFrame, site: str = "site") -> DataFrame:
    """Sitemap entries of each site; homepage links for sites without entries."""
    with_entries = entries.select(site).distinct()
    fallback = homepage_links.join(with_entries, site, "left_anti")
    return entries.withColumn("source", F.lit("sitemap")).unionByName(fallback.withColumn("source", F.lit("homepage")))


def page_type(url_class: Column, signals: dict[str, Column]) -> Column:
    """Page type from the URL class and boolean page signals.

    Signals: schema_product, single_product_named, filters, paginated.
    """
    s = {k: F.coalesce(v, F.lit(False)) for k, v in signals.items()}
    # Classes that are never content.
    side = ["about", "contact", "event", "promo", "auth", "support", "rules"]
    return (F.when(url_class.isin(side), "other")
            .when(url_class == "home", "general")
            .when(s["schema_product"] | s["single_product_named"], "product_detail")
            .when(s["filters"] & s["paginated"], "product_list_paginated")
            .when(s["filters"], "product_list")
            .when(~url_class.isin("product", "category"), "content_list")
            .otherwise("unknown"))
