"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import fixed
from ..operators import relational as rel
from ..plans import social
from ..sinks.upserts import replace_set
from ..sources import crawl as src_crawl
from ..streaming import frontier, metrics
from . import R, bind, query, with_
from . import scores as S


def job_events(spark, d):
    """Job events: one URL per user and event value band, in time order."""
    e = F.col("event_type")
    kind = (F.when(e == "error", "failed").when(e == "purchase", "completed").when(e == "view", "inflight").otherwise("queued"))
    return bind(spark, d, "events").select(
        F.concat_ws("-", F.lit("u"), "user_id").alias("url_id"), F.concat(F.lit("site"), F.col("user_id") % 7).alias("domain"),
        kind.alias("event"), "ts", F.when(e == "error", F.concat(F.lit("e"), F.col("event_id"))).alias("error"), "event_id")


_EV = """WITH ev AS (SELECT 'u-' || user_id AS url_id, 'site' || (user_id % 7) AS domain, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
WHEN 'view' THEN 'inflight' ELSE 'queued' END AS event, ts, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error, event_id FROM events)"""


@query("str_01_dedup_seen", _EV + " SELECT url_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY ts, event_id) AS rn FROM ev) WHERE rn = 1")
def _(spark, d):
    return frontier.dedup_seen_batch(job_events(spark, d), tie="event_id").select("url_id", "event_id")


@query("str_02_job_state", _EV + """ SELECT url_id, domain, CASE WHEN event = 'failed' AND retries <= 3 THEN 'retry_scheduled' ELSE event END AS status, retries, last_error FROM (
SELECT url_id, arg_max(domain, (ts, event_id)) AS domain, arg_max(event, (ts, event_id)) AS event, count(*) FILTER (WHERE event = 'failed') AS retries,
arg_max(error, (ts, event_id)) FILTER (WHERE event = 'failed') AS last_error FROM ev GROUP BY url_id)""")
def _(spark, d):
    return frontier.job_state_batch(job_events(spark, d), "event_id")


@query("str_03_expired_leases", _EV + " SELECT event_id FROM ev WHERE event = 'inflight' AND ts + INTERVAL 300 SECOND <= TIMESTAMP '2024-01-15 00:00:00'")
def _(spark, d):
    s = job_events(spark, d).withColumnsRenamed({"event": "status", "ts": "started_at"})
    return frontier.expired_leases(s, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("str_04_retry_plan", """SELECT event_id, CASE WHEN n > 3 THEN 'failed' ELSE 'retry_scheduled' END AS status, CASE WHEN n <= 3 THEN least(300.0, 10.0 * pow(2.0, greatest(0, n - 1))) END AS delay_seconds,
CASE WHEN n <= 3 THEN CAST(ts + to_seconds(CAST(least(300.0, 10.0 * pow(2.0, greatest(0, n - 1))) AS INTEGER)) AS VARCHAR) END AS next_retry FROM (SELECT event_id, ts, CAST(floor(value) AS INTEGER) % 6 AS n FROM events WHERE event_type = 'error')""")
def _(spark, d):
    f = bind(spark, d, "events").filter("event_type = 'error'").select(
        "event_id", F.col("ts").alias("failed_at"), (F.floor("value").cast("int") % 6).alias("retries"))
    return frontier.retry_plan(f).select("event_id", "status", "delay_seconds", F.col("next_retry_at").cast("string").alias("next_retry"))


@query("str_05_select_batch", with_("scrape_jobs") + """, q AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN priority <= 3 THEN 0 ELSE 1 END, queued_at, id) AS slot FROM scrape_jobs WHERE status = 'queued'),
b AS (SELECT domain, count(*) FILTER (WHERE status = 'inflight') AS busy FROM scrape_jobs GROUP BY domain) SELECT q.id, q.domain, q.slot FROM q JOIN b USING (domain) WHERE slot <= 10 - least(busy, 10) AND slot <= 10""")
def _(spark, d):
    return frontier.select_batch(bind(spark, d, "scrape_jobs")).select("id", "domain", "slot")


@query("udf_03_lane_expression", with_("scrape_jobs") + """, q AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY -priority, queued_at, id) AS slot FROM scrape_jobs WHERE status IN ('queued', 'retry_scheduled')
AND (status = 'queued' OR queued_at <= TIMESTAMP '2024-01-15 00:00:00')), b AS (SELECT domain, count(*) FILTER (WHERE status = 'inflight') AS busy FROM scrape_jobs GROUP BY domain)
SELECT q.id, q.domain, q.slot FROM q JOIN b USING (domain) WHERE slot <= 20 - busy AND slot <= 20""")
def _(spark, d):
    due = (F.col("status") == "retry_scheduled") & (F.col("queued_at") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return frontier.select_batch(bind(spark, d, "scrape_jobs"), cap=20, due=due, lane_expr=-F.col("priority")).select("id", "domain", "slot")


@query("str_06_daily_metrics", with_("post_metrics") + f""" SELECT external_post_id, CAST(snapshot_time AS DATE) AS day, {R('avg(like_count)', 4)} AS avg_likes FROM post_metrics
WHERE snapshot_time < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR GROUP BY 1, 2""")
def _(spark, d):
    m = metrics.withhold_latest(bind(spark, d, "post_metrics"), "snapshot_time", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return social.post_daily_metrics(m)


_P = "SELECT user_id AS proxy, event_type AS domain, ts FROM events"


@query("str_07_rate_usage", f"SELECT proxy, domain, CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, count(*) AS requests, count(*) >= 2 AS at_limit FROM ({_P}) GROUP BY 1, 2, 3")
def _(spark, d):
    e = bind(spark, d, "events").select(F.col("user_id").alias("proxy"), F.col("event_type").alias("domain"), "ts")
    return metrics.rate_usage(e, limit=2).withColumn("window_start", F.col("window_start").cast("string"))


@query("str_07_rate_breaches", f"""SELECT proxy, domain, CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, count(*) AS requests, '1 hour' AS span FROM ({_P}) GROUP BY 1, 2, 3 HAVING count(*) >= 2
UNION ALL SELECT proxy, domain, CAST(date_trunc('day', ts) AS TIMESTAMP)::VARCHAR, count(*), '1 day' FROM ({_P}) GROUP BY 1, 2, 3 HAVING count(*) >= 4""")
def _(spark, d):
    e = bind(spark, d, "events").select(F.col("user_id").alias("proxy"), F.col("event_type").alias("domain"), "ts")
    return metrics.rate_breaches(e, hourly=2, daily=4).select("proxy", "domain", F.col("window_start").cast("string").alias("window_start"), "requests", "span")


@query("str_08_healthy", """SELECT DISTINCT user_id AS proxy FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error'
AND ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 600 MINUTE)""")
def _(spark, d):
    e = bind(spark, d, "events").withColumnRenamed("user_id", "proxy")
    return metrics.healthy(e.select("proxy").distinct(), e.filter("event_type = 'error'"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), minutes=600)


@query("str_08_served_while_banned", """SELECT e.event_id, count(*) AS recent_failures FROM events e JOIN events f ON f.user_id = e.user_id AND f.event_type = 'error' AND f.ts < e.ts
AND f.ts > e.ts - INTERVAL 120 MINUTE GROUP BY e.event_id""")
def _(spark, d):
    e = bind(spark, d, "events")
    return metrics.served_while_banned(e, "user_id", "ts", F.col("event_type") == "error", 120).select("event_id", "recent_failures")


@query("str_09_replace_set", "SELECT DISTINCT event_type AS member FROM events")
def _(spark, d):
    return replace_set(bind(spark, d, "events").withColumnRenamed("event_type", "member"), "member")


@query("str_11_snapshot_scores", S._SOCIAL + S.SOCIAL + " SELECT DATE '2001-08-01' AS snapshot_date, competitor_id, platform, score, engagement_score, reach_score, activity_score, growth_score FROM social")
def _(spark, d):
    return social.snapshot_scores(S.social_of(spark, d), "2001-08-01")


@query("str_13_cached_queries", "SELECT o_orderkey, o_custkey IN (SELECT s_suppkey FROM supplier) AS cached FROM orders")
def _(spark, d):
    r = bind(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("query"))
    hit, miss = frontier.cached_queries(r, bind(spark, d, "supplier").select(F.col("s_suppkey").alias("query")))
    return rel.union_all(hit.withColumn("cached", F.lit(True)), miss.withColumn("cached", F.lit(False))).select("o_orderkey", "cached")


def payloads(spark, d):
    """Crawl result payloads built from the events."""
    kinds = list(src_crawl.EVENT_KINDS)
    e = F.col("event_type")
    kind = F.when(e == "click", kinds[0]).when(e == "view", kinds[1]).when(e == "error", kinds[2]).otherwise(kinds[3])
    body = F.to_json(F.struct(
        kind.alias("event"),
        F.struct(F.concat(F.lit("https://www.site"), "user_id", F.lit(".example/p/"), "event_id").alias("url"),
                 F.concat(F.lit("www.site"), "user_id", F.lit(".example")).alias("domain"), F.lit(200).alias("status_code"),
                 F.create_map(F.lit("product"), F.array(F.concat(F.lit("https://site.example/product/"), "event_id")),
                              F.lit("about"), F.array(F.lit("https://site.example/about"))).alias("homepage_urls"),
                 F.array(F.concat(F.lit("https://site.example/d/"), "event_id"), F.lit("skip")).alias("products"),
                 F.struct(F.concat(F.lit("T"), "event_id").alias("title"), F.concat(F.floor("value"), F.lit(",50 DT")).alias("price")).alias("product"),
                 F.lit('{"scores": {"content_score_percent": 50}}').alias("seo_report")).alias("result")))
    return bind(spark, d, "events").select("event_id", body.alias("value"))


@query("src_02_ingest_counts", """SELECT 'pages' AS part, count(*) + 2 * count(*) FILTER (WHERE event_type = 'click') AS n_rows FROM events UNION ALL SELECT 'snapshots', count(*) FROM events
UNION ALL SELECT 'products', count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) FROM events UNION ALL SELECT 'jobs', count(*) FROM events
UNION ALL SELECT 'next_urls', count(*) FILTER (WHERE event_type IN ('click', 'error')) FROM events""")
def _(spark, d):
    out = src_crawl.ingest_crawl_results(src_crawl.parse_crawl_results(payloads(spark, d)), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return rel.union_all(*[df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("part"), "n_rows") for n, df in out.items()])


@query("snk_01_products_upsert", f"""SELECT sha256('https://www.site' || user_id || '.example/p/' || event_id) AS url_hash, 'site' || user_id || '.example' AS domain, 'T' || event_id AS title,
{R('floor(value) + 0.5', 2)} AS current_price FROM events WHERE event_type IN ('purchase', 'signup')""")
def _(spark, d):
    out = src_crawl.ingest_crawl_results(src_crawl.parse_crawl_results(payloads(spark, d)), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out["products"].select("url_hash", "domain", "title", fixed(F.col("current_price").cast("double"), 2).alias("current_price"))


@query("prj_16_job_rows", "SELECT event_id AS id, 'homepage_sitemap_crawl' AS job_type, event_id * 10 AS queued_epoch FROM events")
def _(spark, d):
    from ..plans.crawl import job_row
    from ..schemas import CRAWL_RESULT
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), (F.col("event_id") * 10.0).alias("queued_at")))
    p = bind(spark, d, "events").select(F.from_json(body, CRAWL_RESULT).alias("result"))
    return job_row(p).select(F.col("id").cast("bigint").alias("id"), "job_type", F.unix_seconds("queued_at").alias("queued_epoch"))


@query("prj_18_cdn_flags", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Google' WHEN 'view' THEN 'Akamai' ELSE '' END AS cdns FROM events")
def _(spark, d):
    from ..functions.urls import cdn_flags
    e = F.col("event_type")
    h = F.create_map(F.when(e == "view", "x-akamai-id").otherwise("server"), F.when(e == "click", "GWS").otherwise("nginx"))
    return bind(spark, d, "events").select("event_id", F.array_join(cdn_flags(h), ",").alias("cdns"))


@query("prj_04_resolve_url", "SELECT event_id, CASE event_type WHEN 'click' THEN 'https://s.example/a/x' || event_id WHEN 'view' THEN 'https://s.example/x' || event_id "
       "WHEN 'error' THEN 'https://o.example/' || event_id WHEN 'purchase' THEN 'https://s.example/up' || event_id END AS url FROM events")
def _(spark, d):
    from ..functions.urls import resolve_url
    e, i = F.col("event_type"), F.col("event_id").cast("string")
    href = (F.when(e == "click", F.concat(F.lit("x"), i)).when(e == "view", F.concat(F.lit("/x"), i, F.lit("#top")))
            .when(e == "error", F.concat(F.lit("//o.example/"), i)).when(e == "purchase", F.concat(F.lit("../a/../up"), i)).otherwise("javascript:void(0)"))
    return bind(spark, d, "events").select("event_id", resolve_url(href, F.lit("https://s.example/a/b?q=1#f")).alias("url"))



@query("src_04_sitemap_entries", "SELECT 'f' || l_orderkey AS source_sitemap, 'https://s.example/' || l_orderkey || '/' || l_linenumber AS loc, CAST(l_linenumber / 10.0 AS DOUBLE) AS priority FROM lineitem")
def _(spark, d):
    from ..sources.sitemaps import sitemap_entries
    xml = F.concat(F.lit("<urlset><url><loc> https://s.example/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit(" </loc><priority>0."),
                   "l_linenumber", F.lit("</priority></url><url><loc></loc></url></urlset>"))
    f = bind(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_orderkey").alias("sitemap_url"), xml.alias("xml"))
    return sitemap_entries(f).select("source_sitemap", "loc", "priority")


@query("src_08_ai_policy_groups", "SELECT event_id AS site, CAST(1 AS INTEGER) AS group_no, 'GPTBot' AS user_agent, '/d' || event_id AS disallows, '5' AS crawl_delay, 'deny' AS training FROM events UNION ALL "
       "SELECT event_id, 2, event_type, '', NULL, NULL FROM events")
def _(spark, d):
    from ..sources.policies import ai_policy_groups
    t = F.concat(F.lit("Contact: a@b.c\nUser-agent: GPTBot # bot\nDisallow: /d"), "event_id", F.lit("\nCrawl-delay: 5\nTraining: deny\n\nUser-Agent: "), "event_type", F.lit("\nallow: /\nX-Y: z"))
    g = ai_policy_groups(bind(spark, d, "events").select(F.col("event_id").alias("site"), t.alias("text")))
    return g.select("site", "group_no", "user_agent", F.array_join("disallows", ",").alias("disallows"), "crawl_delay", "training")
