"""Indexes and stored forms: deep pages, gram search, rule prefixes, continuous aggregates, sketches, written facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import relational as rel
from ..operators import vectors as vx
from ..operators.search import write_gram_index
from ..plans import competitors as comp
from ..plans import social
from ..plans.refresh import refresh_all
from ..session import work_folder
from ..sinks import writers
from ..sources import policies
from ..streaming import continuous, ingest
from . import R, bind, query, with_
from . import scores as S
from .relational import _RULES, robots
from .streams import payloads


@query("srt_02_deep_page", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5 OFFSET 49995")
def _(spark, d):
    rows = bind(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rel.page(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 10_000, 5)


@query("prj_10_search_indexed", with_("products", "competitors") + """ SELECT p.id, title, category, c.domain AS competitor_domain FROM products p
JOIN competitors c ON c.id = p.competitor_id WHERE title ILIKE '%RING%' OR category ILIKE '%RING%' ORDER BY last_updated_at DESC, p.id LIMIT 20""")
def _(spark, d):
    products, folder = bind(spark, d, "products"), work_folder(spark, "grams")
    write_gram_index(products, "id", ["title", "category"], folder)
    return comp.search_products(products, bind(spark, d, "competitors"), "RING", index=folder).select("id", "title", "category", "competitor_domain")


@query("cls_09_longest_rule", _RULES + r""", u AS (SELECT DISTINCT site, CASE WHEN starts_with(s, 'Disallow: ') THEN substr(s, 11) || '/x' ELSE '/' || s END AS path FROM lines WHERE s <> '') SELECT u.site, u.path, max_by(r.path, length(r.path)) AS rule
FROM u JOIN rules r ON r.site = u.site AND starts_with(u.path, r.path) GROUP BY u.site, u.path""")
def _(spark, d):
    files = robots(spark, d)
    lines = files.select("site", F.explode(F.split("text", "\n")).alias("_s")).select("site", F.trim("_s").alias("_s")).filter("_s <> ''")
    path = F.when(F.startswith("_s", F.lit("Disallow: ")), F.concat(F.substr("_s", F.lit(11)), F.lit("/x"))).otherwise(F.concat(F.lit("/"), "_s"))
    return policies.matching_rules(lines.select("site", path.alias("path")), policies.robots_rules(files))


@query("cls_09_large_site", """SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND l_suppkey % 10 <> 3""")
def _(spark, d):
    """One site whose rules grow with the orders: a rule for each finished order, and one for a section."""
    rules = bind(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.lit("s").alias("site"), F.concat(F.lit("/o/"), "o_orderkey", F.lit("/")).alias("path"))
    section = spark.createDataFrame([("s", "/x3/")], "site string, path string")
    urls = bind(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("s").alias("site"), F.when(
        F.col("l_suppkey") % 10 == 3, F.concat(F.lit("/x3/"), "l_orderkey")).otherwise(F.concat(F.lit("/o/"), "l_orderkey", F.lit("/"), "l_linenumber")).alias("path"))
    return policies.apply_robots(urls, rules.union(section)).select("l_orderkey", "l_linenumber")


@query("str_06_continuous", with_("post_metrics") + f""" SELECT external_post_id, CAST(snapshot_time AS DATE) AS day, {R('avg(like_count)', 4)} AS avg_likes FROM post_metrics
WHERE snapshot_time < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR GROUP BY 1, 2""")
def _(spark, d):
    """Three batches in no order of time, a refresh after each."""
    facts, root = bind(spark, d, "post_metrics"), work_folder(spark, "daily")
    for batch in range(3):
        continuous.record(facts.filter(F.col("id") % 3 == batch), batch, root)
        continuous.refresh(spark, root, social.post_daily_metrics, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return spark.read.parquet(f"{root}/daily").select("external_post_id", "day", "avg_likes")


@query("agg_03_distinct_sketch", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    """Sketches by month, united by flag; the exact count beside them and whether the estimate is within its bound."""
    li = bind(spark, d, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    stored, folder = rel.distinct_sketches(li, ["l_returnflag", "month"], "l_partkey"), work_folder(spark, "sketches")
    writers.overwrite(stored, folder)
    near = rel.distinct_estimates(spark.read.parquet(folder), ["l_returnflag"])
    exact = li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
    return exact.join(near, "l_returnflag").select("l_returnflag", "parts", (F.abs(F.col("estimate") / F.col("parts") - 1) < 0.05).alias("near"))


@query("snk_05_append_facts", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(spark, d):
    orders, folder = bind(spark, d, "orders").withColumn("month", F.trunc("o_orderdate", "month")), work_folder(spark, "facts")
    for part in range(2):
        writers.append(orders.filter(F.col("o_orderkey") % 2 == part), folder, "month")
    return spark.read.parquet(folder).groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("keys"))


@query("snk_10_report_documents", "SELECT n_nationkey AS id, n_name AS name, count(*) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    folder = work_folder(spark, "report")
    rows = (bind(spark, d, "nation").join(bind(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("suppliers")))
    writers.write_report({"nations": rows}, folder)
    return spark.read.schema(T.StructType(list(rows.schema))).json(f"{folder}/nations")


@query("str_10_ingest_batches", """SELECT 'web_pages' AS part, count(*) + 2 * count(*) FILTER (WHERE event_type = 'click') AS n_rows FROM events UNION ALL SELECT 'snapshots', count(*) FROM events
UNION ALL SELECT 'products', count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) FROM events UNION ALL SELECT 'jobs', count(*) FROM events
UNION ALL SELECT 'rejects', count(*) FILTER (WHERE event_id % 7 = 0) FROM events""")
def _(spark, d):
    """Two micro-batches through the sink of the ingest stream, with texts that can't be parsed among them."""
    rows, root = payloads(spark, d), work_folder(spark, "ingest")
    broken = bind(spark, d, "events").filter("event_id % 7 = 0").select("event_id", F.lit("no json").alias("value"))
    for batch in range(2):
        ingest.write_batch(rows.unionByName(broken).filter(F.col("event_id") % 2 == batch).select("value"), batch, root)
    return rel.union_all(*[ingest.read_rows(spark, root, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("part"), "n_rows")
                           for n in ("web_pages", "snapshots", "products", "jobs", "rejects")])


@query("snk_09_refresh", with_("page_snapshots", "page_dim", "competitors") + S.SEO + S.summary_sql("page_dim", "competitors") + " SELECT * FROM summary")
def _(spark, d):
    """A refresh in order of dependency, run twice; the second run replaces what the first wrote."""
    inputs = {"page_snapshots": bind(spark, d, "page_snapshots"), "web_pages": bind(spark, d, "page_dim"), "competitors": bind(spark, d, "competitors")}
    folder = work_folder(spark, "refresh")
    for _ in range(2):
        refresh_all(spark, inputs, folder, S.as_of(), S.LAST_DAY, only=["competitor_seo_summary"])
    return spark.read.parquet(f"{folder}/competitor_seo_summary")


@query("udf_05_embed_hook", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS characters, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS letters FROM documents")
def _(spark, d):
    """A user's model given as a hook: built once a task, fed with batches of texts."""
    def model():
        return lambda texts: [[len(t), t.count("e")] for t in texts]
    out = vx.embed(bind(spark, d, "documents").select("doc_id", "text"), "text", model)
    return out.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("characters"), F.get("embedding", F.lit(1)).cast("double").alias("letters"))
