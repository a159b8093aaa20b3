import datetime as dt

from pyspark.sql import functions as F

from rivalscope.catalog.bindings import bind
from rivalscope.plans.refresh import DEPENDS, refresh_all, refresh_order
from rivalscope.sinks import upserts, writers
from rivalscope.sources import policies, sitemaps
from rivalscope.sources.crawl import search_results_to_seeds


def inputs(spark, data):
    names = {"competitors": "competitors", "web_pages": "pages_perf", "page_snapshots": "page_snapshots", "products": "products",
             "target_categories": "target_categories", "social_accounts": "social_accounts",
             "social_account_metrics": "social_account_metrics", "social_posts": "social_posts", "social_post_metrics": "post_metrics"}
    out = {k: bind(spark, data, v) for k, v in names.items()}
    out["web_pages"] = out["web_pages"].join(bind(spark, data, "page_dim").select("url_hash", "page_type"), "url_hash")
    return out


def test_refresh_order():
    order = refresh_order()
    assert set(order) == set(DEPENDS)
    for name, deps in DEPENDS.items():
        assert all(order.index(d) < order.index(name) for d in deps if d in DEPENDS)


def test_refresh_all_twice(spark, data, folder):
    src = inputs(spark, data)
    as_of = F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")
    social = ["competitor_social_time_series", "forecast_regression", "forecast_momentum", "forecast_smoothed"]
    assert set(refresh_all(spark, src, folder, as_of, "2001-08-01")) == set(DEPENDS)
    hist = f"{folder}/competitor_social_score_history"
    n = spark.read.parquet(hist).count()
    refresh_all(spark, src, folder, as_of, "2001-08-02", only=social)
    refresh_all(spark, src, folder, as_of, "2001-08-02", only=social)
    assert spark.read.parquet(hist).count() == 2 * n
    assert spark.read.parquet(f"{folder}/forecast_momentum").count() == n


def test_append_and_report(spark, folder):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 2))], "id int, ts timestamp")
    writers.append(df, f"{folder}/facts", "ts")
    writers.append(df, f"{folder}/facts", "ts")
    back = spark.read.parquet(f"{folder}/facts")
    assert back.count() == 4 and back.filter("date = '2024-01-01'").count() == 2
    writers.write_report({"a": df.select("id")}, f"{folder}/report")
    assert sorted(r.value for r in spark.read.text(f"{folder}/report/a").collect()) == ['{"id":1}', '{"id":2}']


def test_upsert_keeps_old_columns(spark):
    t = spark.createDataFrame([(1, "old", 1), (2, "stay", 2)], "id int, name string, v int")
    u = spark.createDataFrame([(1, "new", 10, 1), (1, "new", 11, 2), (3, "add", 30, 1)], "id int, name string, v int, seq int")
    got = sorted(map(tuple, upserts.upsert(t, u, ["id"], ["v"], ["seq"]).collect()))
    assert got == [(1, "old", 11), (2, "stay", 2), (3, "add", 30)]


def test_history_modes(spark):
    hist = spark.createDataFrame([(1, 5.0, 1, 1), (2, None, 1, 2)], "id int, price double, ts int, n int")
    cur = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "id int, price double")
    assert [r.id for r in upserts.history_delta(cur, hist, "id", "price", "ts", "n").collect()] == [3]
    assert upserts.history_delta(cur, hist, "id", "price", "ts", "n", mode="all").count() == 3


def test_robots_and_policies(spark):
    txt = "# c\nUser-agent: a\nDisallow: /a\nUser-agent: *\nDisallow: /x\nDisallow:\nSITEMAP: https://s/1.xml\nUser-agent: b\nUser-agent: me\nDisallow: /me"
    f = spark.createDataFrame([("s", txt)], "site string, text string")
    assert [r.path for r in policies.robots_rules(f).orderBy("line").collect()] == ["/x"]
    assert [r.path for r in policies.robots_rules(f, "me").orderBy("line").collect()] == ["/x", "/me"]
    assert [r.path for r in policies.robots_rules(f, "b").orderBy("line").collect()] == ["/x"]
    assert [r.path for r in policies.robots_rules(f, "b", grouped=True).orderBy("line").collect()] == ["/x", "/me"]
    assert [r.sitemap_url for r in policies.robots_sitemaps(f).collect()] == ["https://s/1.xml"]
    p = spark.createDataFrame([("s", "Contact: me\nUser-agent: GPTBot\nAllow: /\nTraining: deny\nFoo: bar")], "site string, text string")
    g = policies.ai_policy_groups(p).collect()[0]
    assert (g.user_agent, g.allows, g.training, g.extra[0].key) == ("GPTBot", ["/"], "deny", "Foo")
    assert policies.global_directives(p).collect()[0].val == "me"
    assert policies.missing_agents(policies.ai_policy_groups(p)).count() == 9


def test_sitemaps(spark, folder):
    xml = "<urlset><url><loc> https://s/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc></loc></url><url><priority>0.5</priority></url><url><loc>https://s/2</loc><priority>0.8</priority></url></urlset>"
    f = spark.createDataFrame([("m", xml)], "sitemap_url string, xml string")
    got = sorted((r.loc, r.lastmod, r.priority) for r in sitemaps.sitemap_entries(f).collect())
    assert got == [("https://s/1", "2024-01-01", None), ("https://s/2", None, 0.8)]
    spark.createDataFrame([(xml,)], "v string").coalesce(1).write.text(f"{folder}/x")
    assert sorted(r.loc for r in sitemaps.read_sitemap_files(spark, f"{folder}/x").collect()) == ["https://s/1", "https://s/2"]
    idx = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc> b </loc></sitemap></sitemapindex>"),
                                 ("a", "<sitemapindex><sitemap><loc>i</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>")],
                                "sitemap_url string, xml string")
    edges = sitemaps.sitemap_children(idx)
    seeds = spark.createDataFrame([("i",)], "url string")
    assert sorted((r.url, r.depth) for r in sitemaps.resolve_sitemaps(seeds, edges).collect()) == [("a", 1), ("b", 1), ("i", 0)]
    assert sitemaps.resolve_sitemaps(seeds, edges, max_sitemaps=2).count() == 2


def test_search_seeds(spark):
    links = ["https://www.shop.com/a?x", "https://www.shop.com/b", "https://facebook.com/p", "https://x.fr/", "", None, "shop.tn/x"]
    got = search_results_to_seeds(spark.createDataFrame([(x,) for x in links], "link string"))
    assert sorted(r.url for r in got.collect()) == ["https://www.shop.com", "shop.tn"]
