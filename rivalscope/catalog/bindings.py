"""The model tables, derived from the input tables.

Each entry is one SELECT that means the same in Spark and in ANSI SQL. The
Spark side runs it through :func:`bind`; a query's SQL side uses it as a CTE
through :func:`with_`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

BINDINGS: dict[str, str] = {
    "competitors": """SELECT s_suppkey AS id, lower(replace(s_name, '#', '-')) || '.example' AS domain, s_name AS name FROM supplier""",
    "products": """SELECT l_suppkey AS competitor_id, l_suppkey * 1000000 + l_partkey AS id, p_name AS title, p_brand AS brand, p_type AS category, p_retailprice AS current_price, max(l_returnflag) <> 'R' AS in_stock, CASE WHEN p_size % 4 = 0 THEN '{}' ELSE '{"size": ' || cast(p_size AS string) || '}' END AS specifications, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_updated_at FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_partkey, p_name, p_brand, p_type, p_retailprice, p_size""",
    "target_categories": """SELECT DISTINCT p_type AS category_name, lower(p_type) AS normalized_name, 1 + length(p_type) % 3 AS relevance_weight, p_type <> 'PROMO' AS is_active FROM part""",
    "price_history": """SELECT l_partkey AS product_id, l_extendedprice / l_quantity AS price, l_shipdate AS recorded_at, l_orderkey * 10 + l_linenumber AS id FROM lineitem""",
    "stock_history": """SELECT l_partkey AS product_id, l_returnflag <> 'R' AS in_stock, l_shipdate AS recorded_at, l_orderkey * 10 + l_linenumber AS id FROM lineitem""",
    "page_dim": """SELECT l_orderkey AS page_id, cast(l_orderkey AS string) AS url_hash, min(l_suppkey) AS competitor_id, min(l_returnflag) AS page_type, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at FROM lineitem GROUP BY l_orderkey""",
    "pages_perf": """SELECT cast(l_orderkey AS string) AS url_hash, min(l_suppkey) AS competitor_id, '{"ttfb": ' || cast(CASE WHEN min(l_linenumber) = max(l_linenumber) THEN -1 ELSE cast(floor(sum(l_quantity)) AS int) * 10 END AS string) || ', "first_paint": ' || cast(cast(floor(max(l_extendedprice) / 20) AS int) AS string) || ', "dom_size": ' || cast(cast(floor(sum(l_quantity)) AS int) * 15 AS string) || ', "resource_count": ' || cast(count(*) * 20 AS string) || '}' AS technical_metadata FROM lineitem GROUP BY l_orderkey""",
    "page_snapshots": """SELECT l_orderkey * 10 + l_linenumber AS id, cast(l_orderkey AS string) AS page_url_hash, l_linestatus = 'O' AS has_breadcrumbs, l_linenumber % 3 AS bullet_list_count, l_linenumber % 2 AS number_list_count, cast(floor(l_quantity) AS int) * 4 AS avg_paragraph_word_count, l_linenumber * 3 AS internal_links_count, l_linenumber % 4 AS external_links_count, '{"scores": {"content_score_percent": ' || cast(cast(floor(l_quantity) AS int) * 2 AS string) || ', "content_issues": ["Readability: Very difficult to read (Score: 1.0/10.0)"], "on_page_issues": ["Image Alt Text: ' || cast(l_linenumber AS string) || ' images missing alt text. (Score: 2.5/7.0)"], "technical_issues": ["Mixed Content: Mixed content found. (Penalty: 8.0/8.0)"]}}' AS seo_flags, l_shipdate AS created_at FROM lineitem""",
    "social_accounts": """SELECT c_custkey AS id, c_nationkey % 10 + 1 AS competitor_id, c_mktsegment AS platform, c_name AS username FROM customer""",
    "social_account_metrics": """SELECT o_orderkey AS id, o_custkey AS account_id, cast(floor(o_totalprice) AS int) AS follower_count, o_orderdate AS snapshot_time FROM orders""",
    "social_posts": """SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS account_id, l_shipdate AS publish_time, cast(floor(l_quantity) AS int) * 10 AS like_count, l_linenumber AS comment_count, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber * 2 END AS share_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "score_history": """SELECT cast(ts AS date) AS snapshot_date, user_id % 5 AS competitor_id, event_type AS platform, cast(max(value) / 400 AS decimal(18, 6)) AS score FROM events GROUP BY cast(ts AS date), user_id % 5, event_type""",
    "post_metrics": """SELECT event_id AS id, user_id AS external_post_id, cast(floor(value) AS int) AS like_count, ts AS snapshot_time FROM events""",
    "scrape_jobs": """SELECT event_id AS id, 'site' || cast(user_id AS string) || '.example' AS domain, CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'inflight' ELSE 'retry_scheduled' END AS status, cast(floor(value) AS int) % 10 + 1 AS priority, ts AS queued_at FROM events""",
    "webhook_events": """SELECT event_id AS id, event_type AS source, props AS payload, ts AS received_at FROM events""",
    "urls": """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.Shop.example' ELSE 'http://shop.example:80' END || CASE p_partkey % 17 WHEN 0 THEN '/product/item-' WHEN 1 THEN '/category/kind-' WHEN 2 THEN '/blogs/text-' WHEN 3 THEN '/actualités/n' WHEN 4 THEN '/about-' WHEN 5 THEN '/contact-' WHEN 6 THEN '/events/e' WHEN 7 THEN '/promotions/d' WHEN 8 THEN '/login?next=' WHEN 9 THEN '/ticket/' WHEN 10 THEN '/mentions-' WHEN 11 THEN '/shop/a/b/' WHEN 12 THEN '/shop/a/b/d/drill' WHEN 13 THEN '/list?b=2&a=' WHEN 14 THEN '/page/' WHEN 15 THEN '/12-tools-' ELSE '/misc/' END || cast(p_partkey AS string) AS url FROM part""",
    # The same pages under the nation of their supplier: 25 competitors at any scale.
    "nation_competitors": """SELECT n_nationkey AS id, lower(replace(n_name, '_', '-')) || '.example' AS domain, n_name AS name FROM nation""",
    "nation_pages": """SELECT cast(l_orderkey AS string) AS url_hash, min(s_nationkey) AS competitor_id, min(l_returnflag) AS page_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey""",
}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


#: Tables whose rows are costly to work on (texts, pages, stored reports).
COSTLY = {"documents", "pages", "page_snapshots"}
#: Model tables that make a page of each small row: what they read is spread.
MADE_PAGES = {"shop_pages", "kind_pages", "item_pages", "home_pages"}


def bind(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A model table or an input table as a DataFrame."""
    def table(t: str) -> DataFrame:
        df = read_table(spark, t, folder)
        return spread(df) if name in COSTLY or name in MADE_PAGES else df

    if name in TABLES:
        return table(name)
    text = BINDINGS[name]
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    # Only table names are format fields; braces of JSON text are doubled.
    for t in used:
        text = text.replace("{" + t + "}", f"\x00{t}\x01")
    text = text.replace("{", "{{").replace("}", "}}").replace("\x00", "{").replace("\x01", "}")
    return spark.sql(text, **{t: table(t) for t in used})


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small file over all cores, for queries whose cost is per row.

    A file of one row group is one task. Input that already has at least one
    task per core is left as it is, so large input is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def with_(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the SQL side of a query."""
    return "WITH " + ", ".join(f"{n} AS ({BINDINGS[n]})" for n in names)


def R(expr: str, places: int) -> str:
    """SQL rounding that equals ``functions.rules.fixed``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {places}) AS DOUBLE)"
