"""Sources, sinks, projections, joins, aggregates, windows, order and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as fr
from ..functions import text as ft
from ..operators import relational as rel
from ..operators import series
from ..operators.quantiles import exact_median, exact_quantile
from ..plans import competitors as comp
from ..plans import issues, market, social
from ..sinks import upserts
from ..sources import crawl as src_crawl
from ..sources import policies, sitemaps
from . import R, bind, query, with_
from . import scores as S
from .bindings import TABLES

fixed = fr.fixed

# ---- sources -------------------------------------------------------------


@query("src_01_read_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def _(spark, d):
    return rel.union_all(*[bind(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(t).alias("table_name"), "n_rows") for t in TABLES])


@query("src_03_json_fields", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def _(spark, d):
    return bind(spark, d, "events").select("event_id", ft.json_field("props", "$.k", "bigint").alias("k"),
                                           ft.json_field("props", "$.missing", "string", "none").alias("missing"))


@query("src_05_resolve_sitemaps", """WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child
FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
walk AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS url, 0 AS depth, CAST(NULL AS VARCHAR) AS parent FROM region
UNION ALL SELECT w.root, e.child, w.depth + 1, e.parent FROM walk w JOIN edges e ON e.parent = w.url) SELECT * FROM walk
UNION ALL SELECT 'p1', 'p' || p_partkey, CAST(length(bin(p_partkey)) - 1 AS INTEGER), CASE WHEN p_partkey > 1 THEN 'p' || (p_partkey // 2) END
FROM part WHERE p_partkey >= 1""")
def _(spark, d):
    r, n, s, p = (bind(spark, d, t) for t in ("region", "nation", "supplier", "part"))
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child")).unionByName(
        s.select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child")))
    # A part's file is listed by that of half its key; every seventh lists its own parent again.
    half, own = F.concat(F.lit("p"), F.expr("p_partkey div 2")), F.concat(F.lit("p"), "p_partkey")
    p = p.where("p_partkey > 1")
    edges = edges.unionByName(p.select(half.alias("parent"), own.alias("child"))).unionByName(
        p.where("p_partkey % 7 = 0").select(own.alias("parent"), half.alias("child")))
    seeds = r.select(F.concat(F.lit("r"), "r_regionkey").alias("url")).unionByName(spark.range(1).select(F.lit("p1").alias("url")))
    return sitemaps.resolve_sitemaps(seeds, edges)


_ROBOTS_SQL = r"""WITH robots AS (SELECT doc_id AS site, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ' '),
'(?m)^[A-E][^\n]*', 'User-agent: *', 'g'), '(?m)^[F-M][^\n]*', 'User-agent: otherbot', 'g'), '(?m)^([NOQRST][^\n]*)', 'Disallow: /\1', 'g') AS text FROM documents)"""


def robots(spark, d):
    """A rules file per document: lines become agent or disallow lines by their first letter."""
    t = F.replace(F.col("text"), F.lit("\r"), F.lit(" "))
    t = F.regexp_replace(t, r"(?md)^[A-E][^\n]*", "User-agent: *")
    t = F.regexp_replace(t, r"(?md)^[F-M][^\n]*", "User-agent: otherbot")
    t = F.regexp_replace(t, r"(?md)^([NOQRST][^\n]*)", "Disallow: /$1")
    return bind(spark, d, "documents").select(F.col("doc_id").alias("site"), t.alias("text"))


_RULES = _ROBOTS_SQL + r""", lines AS (SELECT site, CAST(i AS INTEGER) AS line, trim(parts[i]) AS s
FROM (SELECT site, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM robots)),
filled AS (SELECT *, last_value(CASE WHEN lower(s) LIKE 'user-agent:%' THEN trim(substr(s, 12)) END IGNORE NULLS) OVER
(PARTITION BY site ORDER BY line) AS agent FROM lines), rules AS (SELECT site, line, trim(substr(s, 10)) AS path FROM filled
WHERE lower(s) LIKE 'disallow:%' AND agent = '*' AND trim(substr(s, 10)) <> '')"""


@query("src_07_robots_rules", _RULES + " SELECT * FROM rules")
def _(spark, d):
    return policies.robots_rules(robots(spark, d))


@query("src_06_robots_sitemaps", r"SELECT user_id AS site, 'https://' || event_type || '.example/sitemap.xml' AS sitemap_url FROM events "
       "WHERE event_type IN ('click', 'view')")
def _(spark, d):
    line = F.when(F.col("event_type") == "click", F.lit("SITEMAP: https://")).when(
        F.col("event_type") == "view", F.lit(" sitemap:https://")).otherwise(F.lit("# https://"))
    files = bind(spark, d, "events").select(F.col("user_id").alias("site"), F.concat(
        F.lit("User-agent: *\nDisallow: /x\n"), line, "event_type", F.lit(".example/sitemap.xml \n")).alias("text"))
    return policies.robots_sitemaps(files)


@query("src_10_search_seeds", r"""SELECT DISTINCT u AS url, 2 AS priority, 'homepage_sitemap_crawl' AS job_type FROM (
SELECT regexp_extract(url, '\b(((http[s]?://)?[a-z0-9]+(-[a-z0-9]+)*\.)+[a-z]{2,})\b', 1) AS u FROM pages) WHERE trim(u) <> ''
AND NOT regexp_matches(u, 'facebook\.com|fb\.com|instagram\.com|linkedin\.com|tiktok\.com|youtube\.com|pinterest\.com|snapchat\.com|whatsapp\.com|t\.me|telegram\.org|\.fr')""")
def _(spark, d):
    return src_crawl.search_results_to_seeds(bind(spark, d, "pages").select(F.col("url").alias("link")))


@query("src_09_read_pages", "SELECT page_id, url, length(html) AS html_length FROM pages")
def _(spark, d):
    return bind(spark, d, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("html_length"))


# ---- sinks ---------------------------------------------------------------

@query("snk_01_upsert", """WITH upd AS (SELECT * FROM (SELECT o_custkey AS id, o_orderstatus AS name, o_totalprice AS bal,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT coalesce(t.s_suppkey, u.id) AS id, CASE WHEN t.s_suppkey IS NULL THEN u.name ELSE t.s_name END AS name,
CASE WHEN u.id IS NULL THEN t.s_acctbal ELSE u.bal END AS bal FROM supplier t FULL JOIN upd u ON u.id = t.s_suppkey""")
def _(spark, d):
    target = bind(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    updates = bind(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("name"),
                                              F.col("o_totalprice").alias("bal"), "o_orderdate", "o_orderkey")
    return upserts.upsert(target, updates, ["id"], ["bal"], ["o_orderdate", "o_orderkey"])


def _page_updates(spark, d):
    o = bind(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("url_hash"), F.col("o_orderdate").alias("first_seen_at"),
                    F.col("o_orderdate").alias("last_seen_at"),
                    F.when(F.col("o_orderstatus") == "F", "timeout").alias("last_error"))


@query("snk_02_upsert_pages", with_("page_dim") + """, b AS (SELECT url_hash, first_seen_at AS f, last_seen_at AS l, CAST(NULL AS VARCHAR) AS e FROM page_dim
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderdate, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'timeout' END FROM orders)
SELECT url_hash, CAST(min(f) AS DATE) AS first_seen, CAST(max(l) AS DATE) AS last_seen, CAST(max(l) + INTERVAL 3 DAY AS DATE) AS next_run,
CAST(max(CASE WHEN e <> '' THEN l END) AS DATE) AS last_failure FROM b GROUP BY url_hash""")
def _(spark, d):
    target = bind(spark, d, "page_dim").select("url_hash", "first_seen_at", "last_seen_at", F.lit(None).cast("string").alias("last_error"))
    out = upserts.upsert_pages(target, _page_updates(spark, d))
    return out.select("url_hash", *[F.col(a).cast("date").alias(b) for a, b in (
        ("first_seen_at", "first_seen"), ("last_seen_at", "last_seen"), ("next_run_at", "next_run"), ("last_failure_at", "last_failure"))])


@query("snk_03_insert_new", """SELECT id, first_order FROM (SELECT o_custkey AS id, o_orderkey AS first_order, row_number() OVER
(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1 AND id NOT IN (SELECT s_suppkey FROM supplier)""")
def _(spark, d):
    target = bind(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    upd = bind(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return upserts.insert_new(target, upd, ["id"], ["o_orderdate", "first_order"]).select("id", "first_order")


@query("snk_04_snapshot_upsert", with_("score_history") + f""", hist AS (SELECT snapshot_date, competitor_id, platform, CAST(score AS DOUBLE) AS score FROM score_history)
SELECT snapshot_date, competitor_id, platform, CASE WHEN snapshot_date = DATE '{S.LAST_DAY}' THEN {R('score * 2', 4)} ELSE score END AS score FROM hist""")
def _(spark, d):
    h = S.history_of(spark, d)
    today = h.filter(F.col("snapshot_date") == F.lit(S.LAST_DAY).cast("date")).withColumn("score", fixed(F.col("score") * 2, 4))
    keys = ["snapshot_date", "competitor_id", "platform"]
    return rel.anti_join(h, today, keys).unionByName(today).select(*keys, "score")


@query("snk_06_history_delta", f"""WITH hist AS (SELECT l_partkey AS product_id, {R('l_extendedprice / l_quantity', 0)} AS price, l_shipdate AS ts,
l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag <> 'N'), cur AS (SELECT l_partkey AS product_id,
{R('min(l_extendedprice / l_quantity)', 0)} AS price FROM lineitem GROUP BY l_partkey), last AS (SELECT product_id, price FROM (SELECT *, row_number() OVER
(PARTITION BY product_id ORDER BY ts DESC, id DESC, price DESC) AS rn FROM hist) WHERE rn = 1)
SELECT c.product_id, c.price FROM cur c LEFT JOIN last USING (product_id) WHERE c.price IS DISTINCT FROM last.price""")
def _(spark, d):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    li = bind(spark, d, "lineitem")
    hist = li.filter("l_returnflag <> 'N'").select(F.col("l_partkey").alias("product_id"), fixed(unit, 0).alias("price"),
                                                   F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    hist = hist.withColumn("tie", F.struct("id", "price"))
    cur = li.groupBy(F.col("l_partkey").alias("product_id")).agg(fixed(F.min(unit), 0).alias("price"))
    return upserts.history_delta(cur, hist, "product_id", "price", "ts", "tie")


@query("snk_07_retain", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY")
def _(spark, d):
    return upserts.retain(bind(spark, d, "orders"), "o_orderdate", S.as_of()).select("o_orderkey")


@query("snk_08_purge_competitor", with_("competitors", "page_dim", "page_snapshots", "social_accounts", "social_posts") + """
SELECT 'competitors' AS table_name, count(*) AS n_rows FROM competitors WHERE id <> 3 UNION ALL
SELECT 'web_pages', count(*) FROM page_dim WHERE competitor_id <> 3 UNION ALL
SELECT 'page_snapshots', count(*) FROM page_snapshots WHERE page_url_hash NOT IN (SELECT url_hash FROM page_dim WHERE competitor_id = 3) UNION ALL
SELECT 'social_accounts', count(*) FROM social_accounts WHERE competitor_id <> 3 UNION ALL
SELECT 'social_posts', count(*) FROM social_posts WHERE account_id NOT IN (SELECT id FROM social_accounts WHERE competitor_id = 3)""")
def _(spark, d):
    t = {"competitors": bind(spark, d, "competitors"), "web_pages": bind(spark, d, "page_dim"),
         **{n: bind(spark, d, n) for n in ("page_snapshots", "social_accounts", "social_posts")}}
    left = upserts.purge_competitor(t, 3)
    return rel.union_all(*[df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in left.items()])


@query("check_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return rel.check_keys(bind(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- projections ---------------------------------------------------------

#: SQL of a text without accents, in lower case; the letters that strip_accents keeps are written out here.
_PLAIN = "lower(strip_accents({}))"
for _kept, _out in zip("ßœæøłđħıþ", ["ss", "oe", "ae", "o", "l", "d", "h", "i", "th"], strict=True):
    _PLAIN = f"replace({_PLAIN}, '{_kept}', '{_out}')"
_NATION_TEXT = "'É  ' || n_name || ' ç ŒæßØł'"


@query("prj_01_normalize_text", f"SELECT doc_id, trim(regexp_replace({_PLAIN.format('text')}, '\\s+', ' ', 'g')) AS norm FROM documents")
def _(spark, d):
    return bind(spark, d, "documents").select("doc_id", ft.normalize_text("text").alias("norm"))


@query("udf_01_normalize_text_sql", f"SELECT n_nationkey, {_PLAIN.format(_NATION_TEXT)} AS raw, "
       f"trim(regexp_replace({_PLAIN.format(_NATION_TEXT)}, '\\s+', ' ', 'g')) AS norm FROM nation")
def _(spark, d):
    ft.register_sql_functions(spark)
    df = bind(spark, d, "nation").withColumn("t", F.concat(F.lit("É  "), "n_name", F.lit(" ç ŒæßØł")))
    return df.select("n_nationkey", F.lower(ft.unaccent("t")).alias("raw"), F.expr("normalize_text(t)").alias("norm"))


@query("prj_07_parse_price", f"""SELECT l_orderkey, l_linenumber, {R('TRY_CAST(replace(replace(replace(p, chr(44), chr(46)), chr(32), chr(32)[:0]), chr(68) || chr(84), chr(32)[:0]) AS DECIMAL(10,2))', 2)} AS price
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN '1.299,00' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ',50 DT' END AS p FROM lineitem)""")
def _(spark, d):
    p = F.when(F.col("l_returnflag") == "A", "1.299,00").otherwise(F.concat(F.floor("l_extendedprice").cast("string"), F.lit(",50 DT")))
    return bind(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ft.parse_price(p).cast("double").alias("price"))


@query("prj_08_where_optional", "SELECT event_id FROM events WHERE event_type = 'click'")
def _(spark, d):
    return fr.where_optional(bind(spark, d, "events"), event_type="click", user_id=None).select("event_id")


@query("prj_09_where_in", with_("products") + " SELECT id, competitor_id FROM products WHERE competitor_id IN (1, 2, 5)")
def _(spark, d):
    return fr.where_in(bind(spark, d, "products"), "competitor_id", [1, 2, 5]).select("id", "competitor_id")


@query("prj_10_search_products", with_("products", "competitors") + """ SELECT p.id, title, category, c.domain AS competitor_domain FROM products p
JOIN competitors c ON c.id = p.competitor_id WHERE title ILIKE '%RING%' OR category ILIKE '%RING%' ORDER BY last_updated_at DESC, p.id LIMIT 20""")
def _(spark, d):
    return comp.search_products(bind(spark, d, "products"), bind(spark, d, "competitors"), "RING").select(
        "id", "title", "category", "competitor_domain")


@query("prj_11_band", "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= 1000 THEN 1.0::DOUBLE WHEN l_extendedprice <= 20000 THEN 0.7 "
       "WHEN l_extendedprice <= 60000 THEN 0.4 ELSE 0 END AS score FROM lineitem")
def _(spark, d):
    return bind(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fr.band(
        "l_extendedprice", [(1000, 1), (20000, 0.7), (60000, 0.4)], 0).alias("score"))


@query("prj_12_weighted", f"SELECT l_orderkey, l_linenumber, {R('l_quantity * 0.5 + l_discount * 0.3 + 0 * 0.2', 4)} AS score FROM lineitem")
def _(spark, d):
    df = bind(spark, d, "lineitem").withColumn("absent", F.lit(None).cast("double"))
    return df.select("l_orderkey", "l_linenumber", fr.weighted(
        {"l_quantity": 0.5, "l_discount": 0.3, "absent": 0.2}, places=4).alias("score"))


@query("prj_13_completeness", with_("products") + f" SELECT id, {S.POINTS} AS points FROM products")
def _(spark, d):
    return bind(spark, d, "products").select("id", fr.completeness().alias("points"))


@query("prj_14_issue_numbers", with_("page_snapshots", "page_dim") + S.ISSUES + r""", numbers AS (SELECT issue,
regexp_extract(issue, 'Penalty:\s*([0-9.]+)', 1) AS penalty, regexp_extract(issue, 'Score:\s*([0-9.]+)/', 1) AS score,
regexp_extract(issue, 'Score:\s*[0-9.]+/([0-9.]+)', 1) AS full_score, regexp_extract(issue, '[0-9]+') AS number FROM (SELECT DISTINCT issue FROM issues_long))
SELECT DISTINCT lower(trim(regexp_replace(regexp_replace(issue, ':\s\d+', ':', 'g'), '\(.*\)$', ''))) AS issue, TRY_CAST(penalty AS DOUBLE) AS penalty_value,
TRY_CAST(score AS DOUBLE) AS score_value, TRY_CAST(full_score AS DOUBLE) AS score_max, TRY_CAST(number AS DOUBLE) AS raw_number FROM numbers""")
def _(spark, d):
    long = issues.issues_long(bind(spark, d, "page_snapshots"), bind(spark, d, "page_dim"))
    return long.select(ft.issue_key("issue").alias("issue"), *[c.alias(n) for n, c in ft.issue_numbers("issue").items()]).distinct()


@query("prj_15_label", "SELECT event_id, CASE WHEN value > 50 THEN 'up' WHEN value < 10 THEN 'down' ELSE 'flat' END AS label FROM events")
def _(spark, d):
    return bind(spark, d, "events").select("event_id", fr.label("value", [(50, "up")], [(10, "down")], "flat").alias("label"))


@query("prj_20_engagement", with_("social_posts") + f" SELECT id, CAST({S.ENGAGED} AS BIGINT) AS total_engagement FROM social_posts")
def _(spark, d):
    return bind(spark, d, "social_posts").select("id", fr.engagement().cast("bigint").alias("total_engagement"))


@query("prj_21_page_times", """SELECT CAST(o_orderkey AS VARCHAR) AS url_hash, CAST(o_orderdate + INTERVAL 3 DAY AS DATE) AS next_run,
CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS last_failure, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS last_success FROM orders""")
def _(spark, d):
    out = _page_updates(spark, d).transform(upserts.derive_page_times)
    return out.select("url_hash", F.col("next_run_at").cast("date").alias("next_run"), F.col("last_failure_at").cast("date").alias("last_failure"),
                      F.col("last_success_at").cast("date").alias("last_success"))


@query("prj_23_lookup", "SELECT event_id, event_type FROM events WHERE event_id = 77")
def _(spark, d):
    return fr.lookup(bind(spark, d, "events"), event_id=77).select("event_id", "event_type")


# ---- joins ---------------------------------------------------------------

@query("joi_01_page_facts", with_("page_dim", "page_snapshots", "competitors") + """ SELECT s.id, p.url_hash, c.domain FROM page_snapshots s
JOIN page_dim p ON s.page_url_hash = p.url_hash JOIN competitors c ON c.id = p.competitor_id""")
def _(spark, d):
    s, p, c = bind(spark, d, "page_snapshots"), bind(spark, d, "page_dim"), bind(spark, d, "competitors")
    return (s.select("id", F.col("page_url_hash").alias("url_hash")).join(p.select("url_hash", "competitor_id"), "url_hash")
            .join(c.select(F.col("id").alias("competitor_id"), "domain"), "competitor_id").select("id", "url_hash", "domain"))


@query("joi_02_left_join_recent", f"""SELECT c_custkey, count(o_orderkey) AS recent_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
AND o_orderdate >= {S.SINCE} GROUP BY c_custkey""")
def _(spark, d):
    c = bind(spark, d, "customer").select("c_custkey")
    o = bind(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    j = rel.left_join_filtered(c, o, ["c_custkey"], F.col("o_orderdate") >= S.as_of() - F.expr("INTERVAL 3 MONTHS"))
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("recent_orders"))


@query("joi_03_join_normalized", with_("products", "target_categories") + """ SELECT p.id, t.category_name FROM products p JOIN target_categories t
ON trim(lower(p.category)) = t.normalized_name""")
def _(spark, d):
    t = bind(spark, d, "target_categories").select("category_name", "normalized_name")
    return rel.join_norm(bind(spark, d, "products"), t, ft.normalize_text("category"), F.col("normalized_name")).select("id", "category_name")


@query("joi_04_grid_totals", S._MARKET + S.MARKET + """ SELECT competitor_id, count(*) FILTER (WHERE found > 0) AS filled_cells, CAST(sum(weight * least(found, 25)) AS DOUBLE) AS capped_weight
FROM cells GROUP BY competitor_id""")
def _(spark, d):
    return market.complete_grid_totals(bind(spark, d, "competitors"), bind(spark, d, "products"), bind(spark, d, "target_categories"))


@query("joi_05_pairwise_gap", f"""WITH m AS (SELECT s_nationkey AS k, {R('avg(s_acctbal)', 2)} AS v FROM supplier GROUP BY s_nationkey)
SELECT a.k AS key_a, b.k AS key_b, {R('a.v - b.v', 2)} AS v_gap FROM m a JOIN m b ON a.k <> b.k""")
def _(spark, d):
    m = bind(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(fixed(F.avg("s_acctbal"), 2).alias("v"))
    return rel.pairwise_gap(m, "k", ["v"]).withColumn("v_gap", fixed("v_gap", 2))


@query("joi_06_issues_long", with_("page_snapshots", "page_dim") + S.ISSUES + " SELECT competitor_id, page_url_hash, issue FROM issues_long")
def _(spark, d):
    return issues.issues_long(bind(spark, d, "page_snapshots"), bind(spark, d, "page_dim"))


@query("joi_07_with_counts", """SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_lines,
(SELECT count(*) FROM customer WHERE c_custkey = s_suppkey AND c_acctbal < 0) AS n_customers FROM supplier""")
def _(spark, d):
    return rel.with_counts(bind(spark, d, "supplier").select("s_suppkey"), "s_suppkey", {
        "n_lines": (bind(spark, d, "lineitem"), "l_suppkey"), "n_customers": (bind(spark, d, "customer").filter("c_acctbal < 0"), "c_custkey")})


@query("joi_08_kpi_row", """SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n_returned,
(SELECT count(DISTINCT user_id) FROM events) AS n_users""")
def _(spark, d):
    return rel.one_row(bind(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_orders")),
                       bind(spark, d, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned")),
                       bind(spark, d, "events").agg(F.count_distinct("user_id").alias("n_users")))


@query("joi_09_latest_rows", """SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN
(SELECT o_custkey, max(o_orderdate) FROM orders GROUP BY o_custkey)""")
def _(spark, d):
    return rel.latest_rows(bind(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("joi_11_avg_over_cross", f"SELECT {R('avg(s_acctbal)', 2)} AS avg_a, {R('avg(n_regionkey)', 4)} AS avg_b FROM supplier CROSS JOIN nation")
def _(spark, d):
    r = rel.one_row(bind(spark, d, "supplier").agg(F.avg("s_acctbal").alias("a")), bind(spark, d, "nation").agg(F.avg("n_regionkey").alias("b")))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return r.select(F.when(both, fixed("a", 2)).alias("avg_a"), F.when(both, fixed("b", 4)).alias("avg_b"))


@query("joi_12_matched_products", with_("products", "target_categories") + """ SELECT id, competitor_id, category FROM products p WHERE EXISTS
(SELECT 1 FROM target_categories t WHERE t.is_active AND t.normalized_name = lower(p.category))""")
def _(spark, d):
    return market.matched_products(bind(spark, d, "products"), bind(spark, d, "target_categories")).select("id", "competitor_id", "category")


@query("joi_13_unseen", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    from ..streaming.frontier import unseen
    return unseen(bind(spark, d, "customer").select("c_custkey"), bind(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey")



@query("joi_15_missing_agents", "WITH g AS (SELECT DISTINCT user_id AS site, CASE event_type WHEN 'click' THEN 'GPTBot' WHEN 'view' THEN 'CCBot' "
       "WHEN 'error' THEN 'claudebot' ELSE 'otherbot' END AS a FROM events), w AS (SELECT unnest(["
       + ", ".join(f"'{a}'" for a in policies.RECOMMENDED_AGENTS) + "]) AS missing_agent) SELECT s.site, w.missing_agent FROM (SELECT DISTINCT site FROM g) s "
       "CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.site = s.site AND (g.a = w.missing_agent OR g.a = lower(w.missing_agent)))")
def _(spark, d):
    agent = (F.when(F.col("event_type") == "click", "GPTBot").when(F.col("event_type") == "view", "CCBot")
             .when(F.col("event_type") == "error", "claudebot").otherwise("otherbot"))
    return policies.missing_agents(bind(spark, d, "events").select(F.col("user_id").alias("site"), agent.alias("user_agent")))


@query("joi_16_regression_max_t", with_("score_history") + S.SERIES + S._TREND + f" SELECT competitor_id, platform, {R('sl', 6)} AS slope, n AS max_t FROM reg")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("competitor_id", "platform").orderBy("snapshot_date")
    t = S.history_of(spark, d).withColumn("t", F.row_number().over(w).cast("bigint"))
    return t.groupBy("competitor_id", "platform").agg(fixed(F.regr_slope("score", "t"), 6).alias("slope"), F.max("t").alias("max_t"))


@query("joi_17_using", with_("page_dim", "pages_perf") + " SELECT url_hash, page_type, p.competitor_id FROM page_dim p JOIN pages_perf f USING (url_hash)")
def _(spark, d):
    return bind(spark, d, "page_dim").join(bind(spark, d, "pages_perf").select("url_hash"), ["url_hash"]).select("url_hash", "page_type", "competitor_id")


# ---- aggregates ----------------------------------------------------------

@query("agg_01_basic", f"""SELECT l_suppkey, count(*) AS n, {R('sum(l_quantity)', 2)} AS s, {R('avg(l_extendedprice)', 2)} AS a, min(l_quantity) AS lo,
max(l_quantity) AS hi FROM lineitem GROUP BY l_suppkey""")
def _(spark, d):
    return bind(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.sum("l_quantity"), 2).alias("s"), fixed(F.avg("l_extendedprice"), 2).alias("a"),
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("agg_02_count_if", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id")
def _(spark, d):
    return bind(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"),
                                                           F.count_if(F.col("event_type") == "error").alias("errors"))


@query("agg_03_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return bind(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))


@query("agg_04_median", f"SELECT l_suppkey, {R('median(l_quantity)', 4)} AS m FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return bind(spark, d, "lineitem").groupBy("l_suppkey").agg(fixed(F.median("l_quantity"), 4).alias("m"))


_NET = "CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))"


@query("agg_04_exact_median", f"""SELECT l_returnflag, {R('median(x)', 4)} AS m, {R('quantile_cont(x, 0.9)', 4)} AS p90
FROM (SELECT l_returnflag, {_NET} AS x FROM lineitem) GROUP BY l_returnflag""")
def _(spark, d):
    rows = bind(spark, d, "lineitem").select("l_returnflag", F.expr(_NET).alias("x"))
    mid = exact_median(rows, ["l_returnflag"], "x", "m")
    high = exact_quantile(rows, ["l_returnflag"], "x", 0.9, "p90")
    return mid.join(high, "l_returnflag").select("l_returnflag", fixed("m", 4).alias("m"), fixed("p90", 4).alias("p90"))


@query("agg_05_stddev", f"SELECT l_orderkey, {R('stddev_samp(l_quantity)', 4)} AS s FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return bind(spark, d, "lineitem").groupBy("l_orderkey").agg(fixed(F.stddev_samp("l_quantity"), 4).alias("s"))


@query("agg_06_regression", f"SELECT l_suppkey, {R('regr_slope(l_extendedprice, l_quantity)', 2)} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)', 2)} AS icept FROM lineitem GROUP BY 1")
def _(spark, d):
    return bind(spark, d, "lineitem").groupBy("l_suppkey").agg(
        fixed(F.regr_slope("l_extendedprice", "l_quantity"), 2).alias("slope"),
        fixed(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("icept"))


@query("agg_07_weighted_mean", f"SELECT l_suppkey, {R('sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0)', 4)} AS w FROM lineitem GROUP BY 1")
def _(spark, d):
    return bind(spark, d, "lineitem").groupBy("l_suppkey").agg(
        fixed(fr.ratio(F.sum(F.col("l_discount") * F.col("l_quantity")), F.sum("l_quantity")), 4).alias("w"))


@query("agg_08_share_of_total", f"SELECT event_type, {R('count(*) / (SELECT count(*) FROM events)', 4)} AS share FROM events GROUP BY 1")
def _(spark, d):
    e = bind(spark, d, "events")
    total = e.agg(F.count(F.lit(1)).alias("t")).scalar()
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", fixed(fr.ratio("n", total), 4).alias("share"))


@query("agg_09_capped_count", "SELECT l_suppkey, least(count(*), 25) * 2 AS capped FROM lineitem GROUP BY 1")
def _(spark, d):
    return bind(spark, d, "lineitem").groupBy("l_suppkey").agg((F.least(F.count(F.lit(1)), F.lit(25)) * 2).alias("capped"))


@query("agg_10_distinct_matches", with_("products", "target_categories") + """ SELECT DISTINCT p.competitor_id, t.normalized_name AS category_key,
CAST(t.relevance_weight AS DOUBLE) AS weight FROM products p JOIN target_categories t ON lower(p.category) = t.normalized_name WHERE t.is_active""")
def _(spark, d):
    return market.distinct_matches(bind(spark, d, "products"), bind(spark, d, "target_categories")).select("competitor_id", "category_key", "weight")


@query("agg_11_latest_by", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM orders) WHERE rn = 1""")
def _(spark, d):
    return rel.latest_by(bind(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("agg_12_growth", with_("social_account_metrics", "social_accounts", "social_posts") + S.SOCIAL + """ SELECT account_id, followers AS follower_count,
coalesce(rate, 0) AS growth_rate, coalesce(gained, 0) AS follower_delta FROM followers""")
def _(spark, d):
    return social.growth(bind(spark, d, "social_account_metrics"), S.as_of())


@query("agg_13_avg_duration", f"SELECT o_orderstatus, {R('avg((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6)', 2)} AS avg_seconds FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    j = bind(spark, d, "orders").join(bind(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    sec = fr.seconds_between("l_shipdate", "o_orderdate")
    return j.groupBy("o_orderstatus").agg(fixed(F.avg(sec), 2).alias("avg_seconds"))


@query("agg_14_top_categories_nested", with_("products") + """, c AS (SELECT competitor_id, category, count(*) AS n, row_number() OVER
(PARTITION BY competitor_id ORDER BY count(*) DESC, category) AS rank FROM products GROUP BY 1, 2) SELECT competitor_id,
string_agg(category || '=' || n, ';' ORDER BY rank) AS top FROM c WHERE rank <= 3 GROUP BY 1""")
def _(spark, d):
    t = comp.top_categories(bind(spark, d, "products"), 3)
    return t.groupBy("competitor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category", "product_count"))),
                                          lambda x: F.concat_ws("=", x["category"], x["product_count"].cast("string"))), ";").alias("top"))


@query("agg_15_mean_available", f"""SELECT o_orderkey, {R('(coalesce(a, 0) + coalesce(b, 0) + c) / (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + 1)', 4)} AS composite
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS a, CASE WHEN o_orderpriority = '5-LOW' THEN 5.0 END AS b, 1.0 AS c FROM orders)""")
def _(spark, d):
    o = bind(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("a"),
                                        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(5.0)).alias("b"), F.lit(1.0).alias("c"))
    return o.select("o_orderkey", fr.mean_available("a", "b", "c").alias("composite"))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("agg_16_pivot_matrix", with_("products") + " SELECT competitor_id, " + ", ".join(f"count(*) FILTER (WHERE category = '{t}') AS {t.lower()}" for t in _TYPES)
       + " FROM products GROUP BY competitor_id")
def _(spark, d):
    m = rel.pivot_matrix(bind(spark, d, "products"), "competitor_id", "category", _TYPES, F.count(F.lit(1)))
    return m.withColumnsRenamed({t: t.lower() for t in _TYPES})


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("agg_17_pivot_series", "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"{R(f'coalesce(max(value) FILTER (WHERE event_type = {chr(39)}{k}{chr(39)}), 0)', 4)} AS {k}" for k in _KINDS)
       + " FROM events GROUP BY 1")
def _(spark, d):
    e = bind(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return rel.pivot_matrix(e, "day", "event_type", _KINDS, fixed(F.max("value"), 4))


@query("agg_18_totals", f"SELECT count(*) AS n, {R('sum(l_quantity)', 2)} AS q, {R('avg(l_discount)', 6)} AS dsc, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def _(spark, d):
    return bind(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("l_quantity"), 2).alias("q"),
                                          fixed(F.avg("l_discount"), 6).alias("dsc"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg_19_daily_buckets", f"SELECT user_id, CAST(ts AS DATE) AS day, {R('avg(value)', 4)} AS avg_value FROM events GROUP BY 1, 2")
def _(spark, d):
    e = bind(spark, d, "events")
    return e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(fixed(F.avg("value"), 4).alias("avg_value")).select(
        "user_id", F.col("w.start").cast("date").alias("day"), "avg_value")


# ---- windows -------------------------------------------------------------

_H = with_("score_history") + S.SERIES
_K = "snapshot_date, competitor_id, platform"


@query("win_01_lag", _H + f" SELECT {_K}, prev_score, prev_score_2 FROM series")
def _(spark, d):
    return series.lagged(S.history_of(spark, d), social.SERIES, "snapshot_date", "score").select(
        "snapshot_date", "competitor_id", "platform", "prev_score", "prev_score_2")


def _series_cols(*cols):
    def run(spark, d):
        return social.social_time_series(S.history_of(spark, d)).select("snapshot_date", "competitor_id", "platform", *cols)
    return run


for _key, _cols in {"win_02_differences": ("score_delta", "score_acceleration"), "win_03_rolling_mean": ("score_7d_avg", "score_30d_avg"),
                    "win_04_rolling_stddev": ("volatility",), "win_05_momentum": ("momentum",)}.items():
    query(_key, _H + f" SELECT {_K}, {', '.join(_cols)} FROM series")(_series_cols(*_cols))


@query("win_06_minmax_norm", f"""SELECT c_custkey, {R('coalesce((c_acctbal - min(c_acctbal) OVER w) / nullif(max(c_acctbal) OVER w - min(c_acctbal) OVER w, 0), 0)', 6)} AS norm
FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def _(spark, d):
    return series.minmax_norm(bind(spark, d, "customer"), ["c_mktsegment"], {"c_acctbal": "norm"}).select("c_custkey", fixed("norm", 6).alias("norm"))


@query("win_07_row_number", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return bind(spark, d, "supplier").select("s_suppkey", F.row_number().over(w).cast("bigint").alias("rank"))


@query("win_08_rank", "SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rank FROM lineitem")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))
    return bind(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.rank().over(w).cast("bigint").alias("rank"))


@query("win_09_lag_of_mean", _H + S.SMOOTHED + f" SELECT {_K}, smoothed_score FROM smoothed")
def _(spark, d):
    return social.forecast_smoothed(S.history_of(spark, d)).select("snapshot_date", "competitor_id", "platform", fixed("smoothed_score", 6).alias("smoothed_score"))


@query("win_10_top_n_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def _(spark, d):
    return rel.top_n_per_group(bind(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


# ---- order, limit, sets --------------------------------------------------

@query("srt_01_desc_nulls_last", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS score FROM orders ORDER BY score DESC NULLS LAST, o_orderkey LIMIT 100")
def _(spark, d):
    o = bind(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("score"))
    return rel.topk(o, [F.desc_nulls_last("score"), F.asc("o_orderkey")], 100)


@query("srt_02_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return rel.page(bind(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 50)


@query("srt_03_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def _(spark, d):
    return rel.topk(bind(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"),
                    [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 25)


@query("srt_04_mixed_order", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC")
def _(spark, d):
    return bind(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"))


@query("set_01_concat_arrays", with_("page_snapshots", "page_dim") + S.ISSUES + " SELECT page_url_hash, issue, count(*) AS n FROM issues_long GROUP BY 1, 2")
def _(spark, d):
    s = bind(spark, d, "page_snapshots").select("page_url_hash", F.explode(issues.issue_array()).alias("issue"))
    return s.groupBy("page_url_hash", "issue").agg(F.count(F.lit(1)).alias("n"))


@query("set_02_union_pages", "SELECT l_partkey AS k FROM lineitem UNION ALL SELECT p_partkey FROM part")
def _(spark, d):
    return rel.union_all(bind(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), bind(spark, d, "part").select(F.col("p_partkey").alias("k")))


@query("set_03_union_distinct", "SELECT l_suppkey AS k FROM lineitem UNION SELECT c_custkey FROM customer")
def _(spark, d):
    return rel.union_distinct(bind(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), bind(spark, d, "customer").select(F.col("c_custkey").alias("k")))
