"""Lists, comparison, overview, crawl and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import fixed
from ..plans import competitors as comp
from ..plans import crawl, issues, market, performance, reports, seo, social
from . import R, bind, query, with_
from . import scores as S

_ALL = (with_("page_snapshots", "pages_perf", "page_dim", "competitors", "products", "target_categories",
              "social_accounts", "social_account_metrics", "social_posts")
        + S.SEO + S.summary_sql("page_dim", "competitors") + S.perf_sql() + S.OVERALL + S.PAGE_SCORES + S.MARKET + S.SOCIAL)
_SMEAN = f"(SELECT competitor_id, {R('avg(score)', 4)} AS score FROM social GROUP BY competitor_id)"


def parts(spark, d):
    return dict(competitors=bind(spark, d, "competitors"), summary=S.summary_of(spark, d),
                page_scores=S.page_scores_of(spark, d), market=S.market_of(spark, d), social=S.social_of(spark, d))


@query("sco_20_overview_kpis", with_("competitors", "page_dim", "products", "scrape_jobs") + """ SELECT
(SELECT count(*) FROM competitors) AS competitors_total, (SELECT count(*) FROM page_dim) AS pages_total,
(SELECT count(*) FROM products) AS products_total,
(SELECT count(*) FROM scrape_jobs WHERE status IN ('queued','inflight','retry_scheduled')) AS jobs_active,
(SELECT count(*) FROM scrape_jobs WHERE status = 'failed') AS jobs_failed,
(SELECT count(*) FROM scrape_jobs WHERE status = 'completed') AS jobs_completed""")
def _(spark, d):
    return comp.overview_kpis(*[bind(spark, d, n) for n in ("competitors", "page_dim", "products", "scrape_jobs")])


@query("sco_20_overview_scores", _ALL + f""" SELECT {R('avg(avg_seo_score)', 2)} AS avg_seo, {R('avg(avg_score)', 2)} AS avg_perf,
(SELECT {R('avg(score)', 4)} FROM social) AS avg_social, (SELECT {R('avg(final_score)', 2)} FROM market) AS avg_market
FROM summary CROSS JOIN page_scores""")
def _(spark, d):
    p = parts(spark, d)
    return comp.score_overview(p["summary"], p["page_scores"], p["social"], p["market"])


@query("sco_20_critical_issues", with_("page_snapshots", "page_dim") + S.TOP_ISSUES + S.PLAN
       + " SELECT competitor_id, issue, total_affected_pages, total_priority FROM plan WHERE priority_level = 'critical' "
         "ORDER BY total_priority DESC, competitor_id, issue LIMIT 10")
def _(spark, d):
    return comp.critical_issues(S.plan_of(spark, d))


@query("sco_21_competitor_list", _ALL + f""" SELECT c.id, c.domain, c.name, cs.avg_seo_score AS seo_score, cps.avg_score AS perf_score,
css.score AS social_score, cms.final_score AS market_score,
(SELECT count(*) FROM page_dim p WHERE p.competitor_id = c.id) AS page_count,
(SELECT count(*) FROM products pr WHERE pr.competitor_id = c.id) AS product_count
FROM competitors c LEFT JOIN summary cs ON cs.competitor_id = c.id LEFT JOIN page_scores cps ON cps.competitor_id = c.id
LEFT JOIN {_SMEAN} css ON css.competitor_id = c.id LEFT JOIN market cms ON cms.competitor_id = c.id""")
def _(spark, d):
    return comp.competitor_list(pages=bind(spark, d, "page_dim"), products=bind(spark, d, "products"), **parts(spark, d))


_CARD = f"""SELECT c.id, c.domain, c.name, cs.avg_seo_score, cs.avg_content_score, cs.avg_on_page_score, cs.avg_technical_score,
cs.avg_ux_score, cps.avg_score AS perf_score, cps.total_pages, cms.final_score AS market_score, cms.coverage_score,
cms.category_balance_score, cms.assortment_score, coalesce(css.score, 0) AS social_score
FROM competitors c LEFT JOIN summary cs ON cs.competitor_id = c.id LEFT JOIN page_scores cps ON cps.competitor_id = c.id
LEFT JOIN market cms ON cms.competitor_id = c.id LEFT JOIN {_SMEAN} css ON css.competitor_id = c.id"""


@query("joi_10_scorecard", _ALL + " " + _CARD)
def _(spark, d):
    return comp.scorecard(**parts(spark, d))


_CATS = S.cte("cats", f"""SELECT competitor_id, category, count(*) AS product_count, {R('avg(current_price)', 2)} AS avg_price,
row_number() OVER (PARTITION BY competitor_id ORDER BY count(*) DESC, category) AS rank
FROM products WHERE category IS NOT NULL GROUP BY competitor_id, category""")


@query("sco_22_comparison", _ALL + S.cte("card", _CARD) + _CATS + f""" SELECT card.*, r.product_count, r.in_stock_count, r.min_price,
r.max_price, r.avg_price, r.priced_products, k.categories,
{R('(coalesce(avg_seo_score,0) + coalesce(perf_score,0) + social_score + coalesce(market_score,0)) / (CASE WHEN avg_seo_score IS NULL THEN 0 ELSE 1 END + CASE WHEN perf_score IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN market_score IS NULL THEN 0 ELSE 1 END)', 4)} AS composite_score
FROM card LEFT JOIN (SELECT competitor_id, count(*) AS product_count, count(*) FILTER (WHERE in_stock) AS in_stock_count,
 {R('min(current_price)', 2)} AS min_price, {R('max(current_price)', 2)} AS max_price, {R('avg(current_price)', 2)} AS avg_price,
 count(current_price) AS priced_products FROM products GROUP BY competitor_id) r ON r.competitor_id = card.id
LEFT JOIN (SELECT competitor_id, string_agg(category || ':' || product_count, ',' ORDER BY rank) AS categories FROM cats WHERE rank <= 10
 GROUP BY competitor_id) k ON k.competitor_id = card.id""")
def _(spark, d):
    p = parts(spark, d)
    out = comp.comparison(p["competitors"], p["summary"], p["page_scores"], p["market"], p["social"], bind(spark, d, "products"))
    return out.withColumn("categories", F.array_join(F.transform(
        "categories", lambda x: F.concat(x["category"], F.lit(":"), x["count"])), ","))


@query("sco_23_competitor_profile", _ALL + """ SELECT c.id, c.domain, c.name, cs.avg_seo_score, cs.median_seo_score, cs.avg_content_score,
cs.avg_on_page_score, cs.avg_technical_score, cs.avg_ux_score, cps.avg_score AS avg_perf_score, cps.median_score AS median_perf_score,
cps.total_pages, cms.final_score AS market_score, cms.coverage_score, cms.category_balance_score, cms.assortment_score, cms.availability_score
FROM competitors c LEFT JOIN summary cs ON cs.competitor_id = c.id LEFT JOIN page_scores cps ON cps.competitor_id = c.id
LEFT JOIN market cms ON cms.competitor_id = c.id""")
def _(spark, d):
    p = parts(spark, d)
    return comp.competitor_profile(None, p["competitors"], p["summary"], p["page_scores"], p["market"])


@query("sco_24_pages_page", S._PAGES + """ SELECT p.url_hash, p.competitor_id, p.page_type, o.seo_score, o.page_speed_score, o.overall_score
FROM page_dim p LEFT JOIN overall o ON o.url_hash = p.url_hash ORDER BY o.overall_score DESC NULLS LAST, p.url_hash LIMIT 50 OFFSET 50""")
def _(spark, d):
    items, _ = comp.pages_page(bind(spark, d, "page_dim"), S.overall_of(spark, d), number=2)
    return items.select("url_hash", "competitor_id", "page_type", "seo_score", "page_speed_score", "overall_score")


@query("sco_24_products_page", with_("products") + """ SELECT id, competitor_id, title, category, brand, current_price, in_stock
FROM products WHERE in_stock ORDER BY last_updated_at DESC, id LIMIT 50 OFFSET 100""")
def _(spark, d):
    items, _ = comp.products_page(bind(spark, d, "products"), number=3, in_stock=True)
    return items.select("id", "competitor_id", "title", "category", "brand", "current_price", "in_stock")


@query("sco_25_price_history", with_("price_history") + f""" SELECT * FROM (SELECT product_id, {R('price', 4)} AS price, id,
row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, id DESC, price DESC) AS rank FROM price_history) WHERE rank <= 90""")
def _(spark, d):
    from ..operators.relational import top_n_per_group
    h = top_n_per_group(bind(spark, d, "price_history"), ["product_id"], [F.desc("recorded_at"), F.desc("id"), F.desc("price")], 90)
    return h.select("product_id", fixed("price", 4).alias("price"), "id", "rank")


@query("sco_25_stock_history", with_("stock_history") + """ SELECT product_id, in_stock, id, CAST(recorded_at AS DATE) AS day FROM stock_history
WHERE product_id = 7 ORDER BY recorded_at DESC, id DESC LIMIT 90""")
def _(spark, d):
    return comp.history(bind(spark, d, "stock_history"), 7, 90).select(
        "product_id", "in_stock", "id", F.col("recorded_at").cast("date").alias("day"))


@query("sco_25_stock_history_whole", with_("stock_history") + """ SELECT * FROM (SELECT product_id, in_stock, id, CAST(recorded_at AS DATE) AS day,
row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, id DESC) AS rank FROM stock_history) WHERE rank <= 90""")
def _(spark, d):
    return comp.history(bind(spark, d, "stock_history"), None, 90).select(
        "product_id", "in_stock", "id", F.col("recorded_at").cast("date").alias("day"), "rank")


@query("sco_26_speed_breakdown", with_("pages_perf", "competitors") + S.perf_sql() + " SELECT competitor_id, " + ", ".join(
    R(f"avg({c})", 6) + f" AS avg_{c}" for c in [*performance.SPEED_SCORES, "page_speed_score"]) + " FROM perf GROUP BY competitor_id")
def _(spark, d):
    return performance.speed_breakdown(performance.with_speed_scores(bind(spark, d, "pages_perf")))


@query("sco_26_performance_ranking", S._PAGES + S.PAGE_SCORES + " SELECT p.competitor_id, c.domain, total_pages, avg_score, median_score, "
       "worst_page_score, best_page_score FROM page_scores p JOIN competitors c ON c.id = p.competitor_id")
def _(spark, d):
    return performance.performance_ranking(S.page_scores_of(spark, d), bind(spark, d, "competitors"))


@query("sco_27_seo_ranking", with_("page_snapshots", "page_dim", "competitors") + S.SEO + S.summary_sql("page_dim", "competitors")
       + " SELECT * FROM summary ORDER BY avg_seo_score DESC, competitor_id")
def _(spark, d):
    return comp.ranked(S.summary_of(spark, d), "avg_seo_score", "competitor_id")


@query("sco_27_seo_pages", with_("page_snapshots", "page_dim") + S.SEO + """ SELECT p.url_hash, p.page_type, content_score, on_page_score,
technical_score, ux_score, overall_score, page_seo_score FROM seo s JOIN page_dim p ON s.page_url_hash = p.url_hash
ORDER BY page_seo_score DESC, p.url_hash LIMIT 50""")
def _(spark, d):
    s = S.seo_of(spark, d).withColumnRenamed("page_url_hash", "url_hash").drop("id")
    return (s.join(bind(spark, d, "page_dim").select("url_hash", "page_type"), "url_hash")
            .orderBy(F.desc("page_seo_score"), "url_hash").limit(50))


@query("sco_27_top_issues_list", with_("page_snapshots", "page_dim") + S.TOP_ISSUES + " SELECT * FROM top_issues WHERE rank <= 20")
def _(spark, d):
    return S.top_issues_of(spark, d).filter(F.col("rank") <= 20)


@query("sco_28_social_summary", _ALL + " SELECT s.competitor_id, c.domain, c.name, s.platform, s.score, s.engagement_score, s.reach_score, "
       "s.activity_score, s.growth_score, s.posts_per_month FROM social s JOIN competitors c ON c.id = s.competitor_id")
def _(spark, d):
    names = bind(spark, d, "competitors").withColumnRenamed("id", "competitor_id")
    return comp.ranked(S.social_of(spark, d).join(names, "competitor_id").select(
        "competitor_id", "domain", "name", "platform", "score", "engagement_score", "reach_score", "activity_score",
        "growth_score", "posts_per_month"), "score", "competitor_id", "platform")


@query("sco_28_top_posts", with_("social_posts", "social_accounts") + f""" SELECT competitor_id, platform, id, total_engagement, rank FROM (
SELECT a.competitor_id, a.platform, p.id, CAST({S.ENGAGED} AS BIGINT) AS total_engagement,
row_number() OVER (PARTITION BY a.competitor_id ORDER BY ({S.ENGAGED}) DESC, p.id, p.publish_time) AS rank
FROM social_posts p JOIN social_accounts a ON a.id = p.account_id) WHERE rank <= 20""")
def _(spark, d):
    return reports.top_posts(bind(spark, d, "social_posts"), bind(spark, d, "social_accounts")).select(
        "competitor_id", "platform", "id", "total_engagement", "rank")


@query("sco_28_smoothed_tail", with_("score_history") + S.SERIES + S.SMOOTHED + """ SELECT * FROM (SELECT *,
row_number() OVER (PARTITION BY competitor_id ORDER BY platform, snapshot_date DESC) AS position FROM smoothed) WHERE position <= 10""")
def _(spark, d):
    f = social.forecast_smoothed(S.history_of(spark, d))
    f = f.withColumns({c: fixed(c, 6) for c in ("smoothed_score", "forecast_7d", "forecast_30d")})
    return reports.smoothed_tail(f)


@query("sco_28_accounts", with_("social_accounts", "social_account_metrics") + """ SELECT a.id, a.competitor_id, a.platform, a.username,
CAST(m.f AS BIGINT) AS follower_count FROM social_accounts a LEFT JOIN (SELECT account_id, arg_max(follower_count, (snapshot_time, id)) AS f
FROM social_account_metrics GROUP BY account_id) m ON m.account_id = a.id""")
def _(spark, d):
    latest = social.growth(bind(spark, d, "social_account_metrics"), S.as_of()).select(
        F.col("account_id").alias("id"), F.col("follower_count").cast("bigint").alias("follower_count"))
    return bind(spark, d, "social_accounts").join(latest, "id", "left").orderBy("platform", F.desc("follower_count"), "id")


_JOBS = with_("scrape_jobs") + S.cte("jobs", """SELECT *, CASE WHEN status IN ('completed', 'failed') THEN queued_at + INTERVAL 90 SECOND END
AS finished_at, queued_at + INTERVAL 30 SECOND AS started_at FROM scrape_jobs""")


def jobs(spark, d):
    done = F.col("status").isin("completed", "failed")
    return bind(spark, d, "scrape_jobs").withColumns({
        "finished_at": F.when(done, F.col("queued_at") + F.expr("INTERVAL 90 SECONDS")),
        "started_at": F.col("queued_at") + F.expr("INTERVAL 30 SECONDS")})


@query("sco_29_jobs_page", _JOBS + " SELECT id, domain, status, CAST(priority AS INTEGER) AS priority FROM jobs WHERE status = 'failed' "
       "ORDER BY queued_at DESC, id LIMIT 50 OFFSET 50")
def _(spark, d):
    return crawl.jobs_page(jobs(spark, d), 2, 50, status="failed")[0].select("id", "domain", "status", "priority")


@query("sco_29_job_totals", _JOBS + f""" SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'inflight') AS inflight,
count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'retry_scheduled') AS retry_scheduled,
count(*) FILTER (WHERE finished_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR) AS last_hour,
count(*) FILTER (WHERE finished_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR) AS last_24h,
{R('avg(epoch_us(finished_at) / 1e6 - epoch_us(started_at) / 1e6) FILTER (WHERE finished_at IS NOT NULL)', 4)} AS avg_duration_seconds FROM jobs""")
def _(spark, d):
    return crawl.job_totals(jobs(spark, d), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("sco_29_domain_totals", _JOBS + """ SELECT domain, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
count(*) FILTER (WHERE status = 'failed') AS failed, CAST(max(finished_at) AS DATE) AS last_scraped FROM jobs GROUP BY domain
ORDER BY total DESC, domain LIMIT 50""")
def _(spark, d):
    return crawl.domain_totals(jobs(spark, d)).withColumn("last_scraped", F.col("last_scraped").cast("date"))


@query("sco_29_recent_jobs", _JOBS + " SELECT id, domain, status FROM jobs ORDER BY queued_at DESC, id DESC LIMIT 20")
def _(spark, d):
    return crawl.recent_jobs(jobs(spark, d)).select("id", "domain", "status")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in crawl.STATUSES)


@query("sco_30_frontier_stats", _JOBS + f" SELECT domain, {_COUNTS}, count(*) FILTER (WHERE status IN ('queued', 'retry_scheduled')) "
       "AS queue_depth FROM jobs GROUP BY domain")
def _(spark, d):
    return crawl.frontier_stats(jobs(spark, d))


@query("str_12_domain_inflight", _JOBS + " SELECT domain, count(*) FILTER (WHERE status = 'inflight') AS inflight FROM jobs GROUP BY domain")
def _(spark, d):
    return crawl.domain_inflight(jobs(spark, d))


@query("sco_31_report_social_posts", with_("social_posts", "social_accounts") + """ SELECT competitor_id, id, reactions, rank FROM (
SELECT a.competitor_id, p.id, CAST(like_count + comment_count AS BIGINT) AS reactions, row_number() OVER (PARTITION BY a.competitor_id
ORDER BY like_count + comment_count DESC NULLS LAST, p.id, p.publish_time) AS rank FROM social_posts p JOIN social_accounts a ON a.id = p.account_id)
WHERE rank <= 20""")
def _(spark, d):
    return reports.report_social_posts(bind(spark, d, "social_posts"), bind(spark, d, "social_accounts")).select(
        "competitor_id", "id", "reactions", "rank")


@query("sco_31_report_seo_gap", with_("page_snapshots", "page_dim", "competitors") + S.SEO + S.summary_sql("page_dim", "competitors")
       + " SELECT domain, avg_seo_score, avg_content_score, avg_technical_score FROM summary")
def _(spark, d):
    return reports.report_seo_gap(S.summary_of(spark, d))


@query("sco_31_report_platform", with_("competitors", "page_dim", "products") + """ SELECT id, domain, name,
(SELECT count(*) FROM page_dim p WHERE p.competitor_id = c.id) AS page_count,
(SELECT count(*) FROM products p WHERE p.competitor_id = c.id) AS product_count FROM competitors c WHERE id = 3""")
def _(spark, d):
    return reports.report_platform(bind(spark, d, "competitors"), bind(spark, d, "page_dim"), bind(spark, d, "products"), 3)


@query("sco_32_context_social", _ALL + f""" SELECT s.competitor_id, c.domain, s.platform, engagement_score, posts_per_month,
avg_likes_per_post AS avg_likes, avg_comments_per_post AS avg_comments FROM social s JOIN competitors c ON c.id = s.competitor_id""")
def _(spark, d):
    return reports.context_social(S.social_of(spark, d), bind(spark, d, "competitors"))


@query("sco_32_context_recent_posts", with_("social_posts", "social_accounts") + """ SELECT competitor_id, platform, id, like_count, rank FROM (
SELECT a.competitor_id, a.platform, p.id, CAST(p.like_count AS BIGINT) AS like_count, row_number() OVER (PARTITION BY a.competitor_id
ORDER BY p.publish_time DESC, p.id DESC, p.like_count DESC) AS rank FROM social_posts p JOIN social_accounts a ON a.id = p.account_id) WHERE rank <= 20""")
def _(spark, d):
    return reports.context_recent_posts(bind(spark, d, "social_posts"), bind(spark, d, "social_accounts")).select(
        "competitor_id", "platform", "id", F.col("like_count").cast("bigint").alias("like_count"), "rank")


@query("sco_32_context_categories", with_("products") + _CATS + " SELECT * FROM cats WHERE rank <= 10")
def _(spark, d):
    return reports.context_categories(bind(spark, d, "products"))


@query("sco_32_context_issues", with_("page_snapshots", "page_dim") + S.TOP_ISSUES + S.PLAN + """ SELECT competitor_id, issue, total_affected_pages,
total_priority, priority_level FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY total_priority DESC, issue) AS rank FROM plan) WHERE rank <= 5""")
def _(spark, d):
    return reports.context_issues(S.plan_of(spark, d))


@query("sco_33_analysis_series", with_("score_history") + S.SERIES + """ SELECT competitor_id, platform, count(*) AS n_rows,
CAST(min(snapshot_date) AS VARCHAR) AS first_day, CAST(max(snapshot_date) AS VARCHAR) AS last_day FROM (SELECT *, row_number() OVER
(PARTITION BY competitor_id, platform ORDER BY snapshot_date DESC) AS rn FROM series) WHERE rn <= 90 GROUP BY 1, 2""")
def _(spark, d):
    from ..operators.relational import top_n_per_group
    s = top_n_per_group(social.social_time_series(S.history_of(spark, d)), ["competitor_id", "platform"],
                        [F.desc("snapshot_date")], 90)
    return s.groupBy("competitor_id", "platform").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("snapshot_date").cast("string").alias("first_day"),
        F.max("snapshot_date").cast("string").alias("last_day"))


@query("sco_33_analysis_bundle")
def _(spark, d):
    scores = S.social_of(spark, d).withColumn("competitor_id", F.col("competitor_id").cast("bigint"))
    return reports.analysis_bundle(scores, social.social_time_series(S.history_of(spark, d)),
                                   bind(spark, d, "social_posts"), bind(spark, d, "social_accounts"))


_NEWCAT = """ SELECT lower(r_name) AS normalized_name, r_name AS category_name FROM region"""


@query("sco_34_add_category", "WITH known AS (SELECT DISTINCT lower(p_type) AS n FROM part), fresh AS (SELECT DISTINCT "
       "p_type || ' ' || p_brand AS category_name, p_type AS parent_category_name FROM part UNION SELECT DISTINCT p_type, NULL FROM part) "
       "SELECT f.category_name, lower(f.category_name) AS normalized_name, lower(f.parent_category_name) AS parent_normalized "
       "FROM fresh f WHERE lower(f.category_name) NOT IN (SELECT n FROM known)")
def _(spark, d):
    part = bind(spark, d, "part")
    known = bind(spark, d, "target_categories").withColumn("id", F.xxhash64("normalized_name"))
    fresh = part.select(F.concat_ws(" ", "p_type", "p_brand").alias("category_name"), F.col("p_type").alias("parent_category_name")).unionByName(
        part.select(F.col("p_type").alias("category_name"), F.lit(None).cast("string").alias("parent_category_name"))).distinct()
    accepted, _ = market.add_category(known, fresh)
    parents = known.select(F.col("id").alias("parent_category_id"), F.col("normalized_name").alias("parent_normalized"))
    return accepted.join(parents, "parent_category_id", "left").select("category_name", "normalized_name", "parent_normalized")


@query("sco_34_category_tree", "SELECT n.n_name AS category_name, r.r_name AS parent_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey "
       "UNION ALL SELECT r_name, NULL FROM region")
def _(spark, d):
    n, r = bind(spark, d, "nation"), bind(spark, d, "region")
    cats = n.select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent_category_id"),
                    F.col("n_name").alias("category_name")).unionByName(
        r.select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent_category_id"), F.col("r_name").alias("category_name")))
    return market.category_tree(cats).select("category_name", "parent_name")


@query("sco_35_recent_events", with_("webhook_events") + " SELECT id, source, payload FROM webhook_events WHERE source = 'click' "
       "ORDER BY received_at DESC, id DESC LIMIT 50")
def _(spark, d):
    return crawl.recent_events(bind(spark, d, "webhook_events"), "click").select("id", "source", "payload")
