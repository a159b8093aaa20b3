"""Crawl result payloads and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_price
from ..functions.urls import normalize_domain, url_hash, url_host
from ..operators.relational import union_all
from ..schemas import CRAWL_RESULT

#: Page type and default job type of each event kind.
EVENT_KINDS = {
    "crawl_result": ("homepage", "homepage_sitemap_crawl"),
    "content_scrape_result": ("content", "extract_page_content"),
    "product_list_scrape_result": ("product_list", "extract_product_list"),
    "product_scrape_result": ("product_detail", "extract_product_detail"),
}
#: URL classes that become crawl jobs, with priority.
SEED_CLASSES = {
    "extract_product_list": (["product", "category"], 2),
    "extract_page_content": (["blog", "news", "other"], 4),
}
_PRODUCT = "struct<title:string,price:string,in_stock:boolean,url:string>"
_LINK = "struct<url:string,href:string>"


def parse_crawl_results(raw: DataFrame, body: str = "value") -> DataFrame:
    """JSON texts with ``event`` and ``result`` to typed columns, with ``received_at`` where present; see :func:`rejected_texts`."""
    return accepted(typed(raw, body))


def typed(raw: DataFrame, body: str = "value") -> DataFrame:
    """JSON texts beside their typed columns, both kinds of rows: parse once, then :func:`accepted` and :func:`rejected`."""
    parsed = F.from_json(F.col(body), f"struct<event:string,result:{CRAWL_RESULT}>")
    own = [c for c in raw.columns if c == "received_at"]
    return raw.select(F.col(body).cast("string").alias("value"), *own, parsed.alias("_p")).select(
        "value", *own, F.col("_p.event").alias("event"), F.col("_p.result").alias("r"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("r.url").isNotNull()).drop("value")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("r.url").isNull()).drop("event", "r")


def rejected_texts(raw: DataFrame, body: str = "value") -> DataFrame:
    """The rows that :func:`parse_crawl_results` leaves out: no JSON of the kind, or no result URL."""
    parsed = F.from_json(F.col(body), f"struct<event:string,result:{CRAWL_RESULT}>")
    return raw.filter(parsed["result"]["url"].isNull())


def _by_kind(index: int) -> Column:
    pairs = [x for k, v in EVENT_KINDS.items() for x in (F.lit(k), F.lit(v[index]))]
    return F.try_element_at(F.create_map(*pairs), F.col("event"))


def ingest_crawl_results(parsed: DataFrame, received_at: Column) -> dict[str, DataFrame]:
    """Route parsed results to table rows: pages, snapshots, products, jobs, next_urls.

    Every derived list is a projection of its own payload row; nothing is grouped.
    """
    r = parsed.select("event", "r.*", received_at.alias("_at")).withColumns({
        "url_hash": url_hash("url"), "domain": normalize_domain("domain")})
    own = r.select("url_hash", "url", "domain", _by_kind(0).alias("page_type"), F.col("_at").alias("seen_at"))
    homepage = r.filter(F.col("event") == "crawl_result").select(
        "domain", "_at", F.explode("homepage_urls").alias("url_class", "urls")).select(
        "domain", "_at", "url_class", F.explode("urls").alias("url"))
    linked = homepage.select(url_hash("url").alias("url_hash"), "url", normalize_domain(url_host("url")).alias("domain"),
                             F.lit("unknown").alias("page_type"), F.col("_at").alias("seen_at"))
    snapshots = r.select("url_hash", "status_code", "final_url", "title",
                         F.to_json(F.struct(F.get_json_object("seo_report", "$.scores").alias("scores"))).alias("seo_flags"),
                         F.col("_at").alias("created_at"))
    prod = F.from_json("product", _PRODUCT)
    products = (r.filter((F.col("event") == "product_scrape_result") & F.col("product").isNotNull())
                .select("url_hash", "domain", prod["title"].alias("title"), parse_price(prod["price"]).alias("current_price"),
                        F.coalesce(prod["in_stock"], F.lit(True)).alias("in_stock"), F.col("_at").alias("last_updated_at")))
    jobs = r.select("url", "domain", F.lit("completed").alias("status"),
                    F.coalesce("job_type", _by_kind(1)).alias("job_type"), F.col("_at").alias("finished_at"))
    item = F.col("item")
    link = F.from_json(item, _LINK)
    listed = (r.filter(F.col("event") == "product_list_scrape_result").select("domain", F.explode("products").alias("item"))
              .select("domain", F.coalesce(F.when(item.startswith("http"), item), link["url"], link["href"]).alias("url"))
              .filter(F.col("url").startswith("http"))
              .select("url", F.lit("extract_product_detail").alias("job_type"), F.lit(2).alias("priority")))
    return {"pages": own.unionByName(linked), "snapshots": snapshots, "products": products, "jobs": jobs,
            "next_urls": seed_union(homepage).unionByName(listed)}


def seed_union(classified: DataFrame) -> DataFrame:
    """Crawl seeds from classified URLs (url_class, url)."""
    return union_all(*[
        classified.filter(F.col("url_class").isin(classes)).select(
            "url", F.lit(job).alias("job_type"), F.lit(priority).alias("priority"))
        for job, (classes, priority) in SEED_CLASSES.items()])


#: A hit whose address contains one of these is no competitor.
BLOCKED_PARTS = [
    "facebook.com", "fb.com", "instagram.com", "linkedin.com", "tiktok.com", "youtube.com", "pinterest.com",
    "snapchat.com", "whatsapp.com", "t.me", "telegram.org", ".fr",
]
_SITE = r"\b(((http[s]?://)?[a-z0-9]+(-[a-z0-9]+)*\.)+[a-z]{2,})\b"


def search_results_to_seeds(results: DataFrame, link: str = "link") -> DataFrame:
    """Search hits to homepage jobs: site address, blanks and blocked sites dropped, one row per address."""
    url = F.regexp_extract(F.col(link), _SITE, 1)
    blocked = "|".join(p.replace(".", r"\.") for p in BLOCKED_PARTS)
    return (results.select(url.alias("url")).filter((F.trim("url") != "") & ~F.col("url").rlike(blocked))
            .distinct()
            .select("url", F.lit(2).alias("priority"), F.lit("homepage_sitemap_crawl").alias("job_type")))
