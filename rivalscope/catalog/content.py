"""URL, text, classification, product and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import urls as fu
from ..functions.rules import fixed
from ..operators import text as tx
from ..operators import vectors as vx
from ..operators.relational import top_n_per_group
from ..plans import classify
from ..sources import crawl as src_crawl
from ..sources import policies, sitemaps
from . import SQL, R, bind, query, with_
from .relational import _RULES, robots

# ---- URLs ----------------------------------------------------------------

# One spelling of the URL shape for the SQL side.
_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''))"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_QRY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_BOTH = "b AS (SELECT id, url FROM urls UNION ALL SELECT page_id + 1000000000, url FROM pages)"


def both_urls(spark, d):
    return bind(spark, d, "urls").unionByName(bind(spark, d, "pages").select((F.col("page_id") + 1000000000).alias("id"), "url"))


@query("prj_02_normalize_domain", with_("urls") + f", {_BOTH} " + r"SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '/+$', '') AS domain FROM b")
def _(spark, d):
    return both_urls(spark, d).select("id", fu.normalize_domain("url").alias("domain"))


@query("prj_03_canonical_url", with_("urls") + f", {_BOTH}, p AS (SELECT id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, {_HOST} AS h, "
       + r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]*:(\d+)', 1) AS port, " + f"{_PATH} AS path, {_QRY} AS q FROM b) "
       "SELECT id, s || '://' || h || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END "
       "|| CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url FROM p")
def _(spark, d):
    return both_urls(spark, d).select("id", fu.canonical_url("url").alias("url"))


@query("prj_05_ids", with_("urls") + f", {_BOTH} SELECT id, sha256(url) AS url_hash, md5(url) AS text_hash FROM b")
def _(spark, d):
    return both_urls(spark, d).select("id", fu.url_hash("url").alias("url_hash"), ft.text_hash("url").alias("text_hash"))


@query("prj_05_url_id", "SELECT id, sha1(url) AS url_id FROM (" + SQL["prj_03_canonical_url"] + ")")
def _(spark, d):
    return both_urls(spark, d).select("id", fu.url_id("url").alias("url_id"))


@query("prj_06_host", with_("urls") + f", {_BOTH} SELECT id, {_HOST} AS host FROM b")
def _(spark, d):
    return both_urls(spark, d).select("id", fu.url_host("url").alias("host"))


@query("prj_17_resource_type", with_("urls") + """, x AS (SELECT id, url || CASE WHEN id % 5 = 0 THEN '.js' WHEN id % 5 = 1 THEN '.PNG' WHEN id % 5 = 2 THEN '.woff2' ELSE '' END AS u,
CASE WHEN id % 5 = 3 THEN 'text/css; charset=utf-8' ELSE 'text/html' END AS t FROM urls) SELECT id, CASE WHEN lower(u) LIKE '%.js' THEN 'javascript'
WHEN lower(u) LIKE '%.png' THEN 'image' WHEN lower(u) LIKE '%.woff2' THEN 'font' WHEN t LIKE '%css%' THEN 'css' ELSE 'other' END AS kind FROM x""")
def _(spark, d):
    m = F.col("id") % 5
    u = F.concat("url", F.when(m == 0, ".js").when(m == 1, ".PNG").when(m == 2, ".woff2").otherwise(""))
    t = F.when(m == 3, "text/css; charset=utf-8").otherwise("text/html")
    return bind(spark, d, "urls").select("id", fu.resource_type(u, t).alias("kind"))


@query("prj_19_next_page_url", r"""SELECT page_id, CASE WHEN regexp_matches(h, '/\d+/?$') THEN regexp_replace(h, '/\d+(/?)$', '/9\1') ELSE regexp_replace(h, '/$', '') || '/9/' END || t AS next_path
FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS h, regexp_extract(url, '[?#].*$') AS t FROM pages)""")
def _(spark, d):
    return bind(spark, d, "pages").select("page_id", fu.next_page_url("url", "__path__", 9).alias("next_path"))


@query("prj_19_next_page_parameter", r"""SELECT page_id, h || '?' || CASE WHEN regexp_matches(q, '(^|&)page=') THEN regexp_replace(q, '(^|&)page=[^&]*', '\1page=9')
WHEN q = '' THEN 'page=9' ELSE q || '&page=9' END || f AS next_url FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS h, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q,
regexp_extract(url, '#.*$') AS f FROM pages)""")
def _(spark, d):
    return bind(spark, d, "pages").select("page_id", fu.next_page_url("url", "page", 9).alias("next_url"))


@query("aud_09_url_friendliness", with_("urls") + f", {_BOTH}, p AS (SELECT id, url, url_decode({_PATH}) AS path FROM b) " + r"""SELECT id, length(url) > 100 AS too_long,
len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 4 AS too_deep, regexp_matches(path, '\p{Lu}') AS has_uppercase,
regexp_matches(lower(path), '\.(php|asp|aspx|jsp|html|htm)$') AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 0 AS has_extension,
length(url) <= 100 AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 4 AS is_seo_friendly_url FROM p""")
def _(spark, d):
    f = fu.url_friendliness("url")
    return both_urls(spark, d).select("id", *[f[n].alias(n) for n in ("too_long", "too_deep", "has_uppercase", "has_extension", "is_seo_friendly_url")])


@query("aud_10_slug_quality", with_("urls") + f", {_BOTH}, p AS (SELECT id, coalesce(list_filter(string_split(url_decode({_PATH}), '/'), lambda x: x <> '')[-1], '') AS slug FROM b) "
       + r"""SELECT id, slug, contains(slug, '-') AS slug_has_hyphens, regexp_matches(slug, '[^a-zA-Z0-9\-]') AS slug_has_special_chars,
contains(lower(slug), 'item') AS slug_contains_keyword, CAST(len(list_filter(regexp_extract_all(lower(slug), '[a-z0-9]+'), lambda w: list_contains([""" +
       ", ".join(f"'{w}'" for w in tx.STOPWORDS) + r"""], w))) AS INTEGER) AS slug_stopwords,
regexp_replace(regexp_replace(regexp_replace(trim(lower(slug)), '[^a-z0-9\-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS slug_normalized FROM p""")
def _(spark, d):
    q = fu.slug_quality("url", tx.STOPWORDS, "item")
    return both_urls(spark, d).select("id", *[c.alias(n) for n, c in q.items()])


# ---- classification ------------------------------------------------------

_M = r"regexp_replace(lower(strip_accents(url_decode(url))), '[^\x00-\x7F]', '', 'g')"
_DEPTH = ("CASE WHEN shop_at IS NULL OR shop_at = 0 THEN NULL WHEN len(seg) - shop_at <= 2 THEN 'category' WHEN regexp_matches(seg[-1], '^[a-z0-9][a-z0-9-]{1,}$') "
          r"AND NOT regexp_matches(seg[-1], '^\d+$') THEN 'product' END")
_CLASSED = (f"m AS (SELECT id, url, {_M} AS u FROM b), s AS (SELECT *, list_filter(string_split(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM m), "
            "t AS (SELECT *, list_position(list_transform(seg, lambda x: list_contains(['shop', 'boutique', 'cat', 'produits'], x)), true) AS shop_at FROM s), "
            "classed AS (SELECT id, url, CASE " + " ".join(f"WHEN regexp_matches(u, '{classify.family(n)}') THEN '{n}'" for n in classify.URL_PATTERNS)
            + f" ELSE coalesce({_DEPTH}, 'other') END AS url_class, {_DEPTH} AS by_depth FROM t)")


@query("cls_01_classify_url", with_("urls") + f", {_BOTH}, {_CLASSED} SELECT id, url_class FROM classed")
def _(spark, d):
    return both_urls(spark, d).select("id", classify.classify_url("url").alias("url_class"))


@query("cls_02_classify_by_depth", with_("urls") + f", {_BOTH}, {_CLASSED} SELECT id, by_depth FROM classed")
def _(spark, d):
    return both_urls(spark, d).select("id", classify.classify_by_depth(classify.matchable("url")).alias("by_depth"))


_SM = """sm AS (SELECT id, 'https://shop.example/' || CASE id % 7 WHEN 0 THEN 'product-sitemap' WHEN 1 THEN 'category-sitemap' WHEN 2 THEN 'post-sitemap'
WHEN 3 THEN 'product_cat-sitemap' WHEN 4 THEN 'product_tag-sitemap' WHEN 5 THEN 'sitemap_products_' ELSE 'sitemap' END || id || '.xml' AS src, url FROM b)"""
_SMC = ("CASE WHEN id % 7 IN (2, 4) THEN 'other' WHEN id % 7 IN (0, 5) THEN 'product' WHEN id % 7 IN (1, 3) THEN 'category' END")


def sitemap_rows(spark, d):
    m = F.col("id") % 7
    names = ["product-sitemap", "category-sitemap", "post-sitemap", "product_cat-sitemap", "product_tag-sitemap", "sitemap_products_"]
    name = F.when(m == 6, "sitemap")
    for i, n in enumerate(names):
        name = name.when(m == i, n)
    return both_urls(spark, d).select("id", F.concat(F.lit("https://shop.example/"), name, F.col("id"), F.lit(".xml")).alias("source_sitemap"),
                                      F.col("url").alias("loc"))


@query("cls_03_classify_sitemap_name", with_("urls") + f", {_BOTH}, {_SM} SELECT id, {_SMC} AS file_class FROM sm")
def _(spark, d):
    return sitemap_rows(spark, d).select("id", sitemaps.classify_sitemap_name("source_sitemap").alias("file_class"))


@query("cls_04_classify_sitemap_entries", with_("urls") + f", {_BOTH}, {_CLASSED} SELECT id, coalesce({_SMC}, url_class) AS url_class FROM classed")
def _(spark, d):
    return classify.classify_sitemap_entries(sitemap_rows(spark, d)).select("id", "url_class")


@query("cls_07_pagination_parameter", "SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=[^&#]') THEN 'page' WHEN regexp_matches(url, '[?&]p=[^&#]') THEN 'p' END AS parameter FROM pages")
def _(spark, d):
    return bind(spark, d, "pages").select("page_id", fu.pagination_parameter("url").alias("parameter"))


@query("cls_09_apply_robots", _RULES + r""", u AS (SELECT site, line AS id, '/' || s AS path FROM lines WHERE s <> '') SELECT u.site, u.id FROM u WHERE NOT EXISTS
(SELECT 1 FROM rules r WHERE r.site = u.site AND starts_with(u.path, r.path))""")
def _(spark, d):
    files = robots(spark, d)
    lines = files.select("site", F.posexplode(F.split("text", "\n")).alias("_p", "_s")).select(
        "site", (F.col("_p") + 1).alias("id"), F.trim("_s").alias("_s")).filter("_s <> ''")
    urls = lines.select("site", "id", F.concat(F.lit("/"), "_s").alias("path"))
    return policies.apply_robots(urls, policies.robots_rules(files)).select("site", "id")


@query("cls_08_discover_urls", """SELECT l_suppkey AS site, l_partkey AS url_no, 'sitemap' AS source FROM lineitem WHERE l_quantity > 49 UNION ALL
SELECT s_suppkey, s_suppkey, 'homepage' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)""")
def _(spark, d):
    e = bind(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("url_no"))
    h = bind(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_suppkey").alias("url_no"))
    return classify.discover_urls(e, h)


@query("cls_08_discover_urls_whole", """SELECT l_suppkey AS site, l_partkey AS url_no, 'sitemap' AS source FROM lineitem UNION ALL
SELECT c_custkey, c_custkey, 'homepage' FROM customer WHERE c_custkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def _(spark, d):
    e = bind(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("url_no"))
    h = bind(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.col("c_custkey").alias("url_no"))
    return classify.discover_urls(e, h)


@query("set_05_seed_union", with_("urls") + f", {_BOTH}, {_CLASSED} SELECT url, CASE WHEN url_class IN ('product', 'category') THEN 'extract_product_list' ELSE 'extract_page_content' END AS job_type, "
       "CASE WHEN url_class IN ('product', 'category') THEN 2 ELSE 4 END AS priority FROM classed WHERE url_class IN ('product', 'category', 'blog', 'news', 'other')")
def _(spark, d):
    return src_crawl.seed_union(both_urls(spark, d).select(classify.classify_url("url").alias("url_class"), "url"))


# ---- text ----------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def tokens(least: int, stop: bool = True) -> str:
    extra = f" AND NOT list_contains({_STOP}, w)" if stop else ""
    return f"list_filter({_WORDS}, lambda w: regexp_full_match(w, '[a-z0-9]+') AND length(w) >= {least}{extra})"


@query("txt_01_top_keywords", f"""WITH t AS (SELECT doc_id, unnest({tokens(4)}) AS keyword FROM documents), c AS (SELECT doc_id, keyword, count(*) AS n FROM t GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS rank FROM c) WHERE rank <= 10""")
def _(spark, d):
    return tx.top_keywords(bind(spark, d, "documents"))


@query("txt_02_keyword_density", f"""SELECT doc_id, kw AS keyword, (length(lower(text)) - length(replace(lower(text), kw, ''))) // length(kw) AS phrase_count,
{R(f"((length(lower(text)) - length(replace(lower(text), kw, ''))) // length(kw)) / greatest(len({tokens(1, False)}), 1) * 100", 2)} AS density_percent
FROM documents CROSS JOIN (SELECT unnest(['the', 'on the']) AS kw)""")
def _(spark, d):
    return tx.keyword_density(bind(spark, d, "documents"), ["the", "on the"]).drop("variants")


@query("txt_03_top_ngrams", f"""WITH t AS (SELECT doc_id, {tokens(3)} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM t WHERE len(w) > 1),
c AS (SELECT doc_id, ngram, count(*) AS n FROM g GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ngram) AS rank FROM c) WHERE rank <= 10""")
def _(spark, d):
    return tx.top_ngrams(bind(spark, d, "documents"), 2)


@query("txt_03_top_trigrams", f"""WITH t AS (SELECT doc_id, {tokens(3)} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS ngram FROM t WHERE len(w) > 2),
c AS (SELECT doc_id, ngram, count(*) AS n FROM g GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ngram) AS rank FROM c) WHERE rank <= 10""")
def _(spark, d):
    return tx.top_ngrams(bind(spark, d, "documents"), 3)


@query("txt_04_readability", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[''\-]+[\p{L}\p{N}_]+)*') AS w,
len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', '', 'g')) <> '')) AS sentences FROM documents),
s AS (SELECT doc_id, len(w) AS words, sentences, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN length(regexp_replace(lower(x), '[^a-z]', '', 'g')) <= 3 THEN 1
ELSE greatest(1, len(regexp_extract_all(CASE WHEN regexp_matches(regexp_replace(lower(x), '[^a-z]', '', 'g'), '[^l]e$') THEN regexp_replace(regexp_replace(lower(x), '[^a-z]', '', 'g'), 'e$', '')
ELSE regexp_replace(lower(x), '[^a-z]', '', 'g') END, '[aeiouy]+'))) END)), 0) AS syllables FROM w)
SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(sentences AS INTEGER) AS sentences, CAST(syllables AS INTEGER) AS syllables,
""" + f"""CASE WHEN words >= 100 AND sentences >= 3 THEN {R('206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words)', 2)} END AS flesch_reading_ease,
CASE WHEN words >= 100 AND sentences >= 3 THEN {R('0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59', 2)} END AS flesch_kincaid_grade,
CASE WHEN words >= 100 AND sentences >= 3 THEN {R('words / sentences', 2)} END AS avg_sentence_length,
CASE WHEN words >= 100 AND sentences >= 3 THEN {R('syllables / words', 2)} END AS avg_syllables_per_word FROM s""")
def _(spark, d):
    return tx.readability(bind(spark, d, "documents"))


_VOC = r"SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))) AS word FROM benchmark"


@query("txt_06_spellcheck", f"""WITH dict AS ({_VOC}), w AS (SELECT DISTINCT doc_id, unnest(list_filter({_WORDS}, lambda w: regexp_full_match(w, '[a-z]+') AND length(w) > 2)) AS word FROM documents),
u AS (SELECT * FROM w WHERE word NOT IN (SELECT word FROM dict)) SELECT d.doc_id, count(u.word) AS misspelled_count FROM documents d LEFT JOIN u USING (doc_id) GROUP BY 1""")
def _(spark, d):
    return tx.spellcheck(bind(spark, d, "documents"), tx.vocabulary(bind(spark, d, "benchmark"), "text")).select("doc_id", "misspelled_count")


@query("joi_14_misspelled_words", f"""WITH dict AS ({_VOC}), w AS (SELECT DISTINCT unnest(list_filter({_WORDS}, lambda w: regexp_full_match(w, '[a-z]+'))) AS word FROM documents)
SELECT word FROM w WHERE word NOT IN (SELECT word FROM dict)""")
def _(spark, d):
    from ..operators.relational import anti_join
    return anti_join(tx.vocabulary(bind(spark, d, "documents"), "text"), tx.vocabulary(bind(spark, d, "benchmark"), "text"), ["word"])


# Accented letters are replaced by a letter, since the word boundary of the SQL side is ASCII.
_PLAIN = "regexp_replace(lower(text), '[À-ÖØ-öø-ɏ]', 'q', 'g')"
_INTENT = {n: " + ".join(f"len(regexp_extract_all(t, '\\b({alt})\\b')) * {w}" for w, alt in s.items()) for n, s in tx.INTENT_WORDS.items()}
_T, _C, _I, _N = (f"{n}_score" for n in ("transactional", "commercial", "informational", "navigational"))


@query("txt_07_search_intent", f"WITH p AS (SELECT doc_id, {_PLAIN} AS t FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{c} AS {n}_score" for n, c in _INTENT.items())
       + f" FROM p), r AS (SELECT *, list_reverse_sort([{_T}, {_C}, {_I}, {_N}]) AS o FROM s) SELECT doc_id, {_T}, {_C}, {_I}, {_N}, CASE WHEN o[1] <= 0 THEN 'informational' WHEN {_T} = o[1] THEN 'transactional' "
       f"WHEN {_C} = o[1] THEN 'commercial' WHEN {_N} = o[1] THEN 'navigational' ELSE 'informational' END AS search_intent, CASE WHEN o[1] <= 0 THEN 0 ELSE {R('least(o[1] / 10.0, 1) * (1 - o[2] / o[1] * 0.3)', 2)} END AS intent_confidence FROM r")
def _(spark, d):
    return tx.search_intent(bind(spark, d, "documents").select("doc_id", "text")).drop("text")


@query("txt_08_structure", r"WITH p AS (SELECT doc_id, text, " + _PLAIN + r" AS t FROM documents) SELECT doc_id, " + R(
    r"len(regexp_extract_all(t, '\b(was|were|be|been|being)\b\s+\b([a-z0-9_]+ed)\b')) / greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))", 3)
    + " AS passive_ratio, regexp_matches(lower(text), '" + "|".join(tx.CTA_PHRASES) + "') AS has_cta FROM p")
def _(spark, d):
    return bind(spark, d, "documents").select("doc_id", tx.passive_ratio("text").alias("passive_ratio"), tx.has_cta("text").alias("has_cta"))


@query("txt_09_keyword_early", r"SELECT doc_id, contains(lower(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:100], ' ')), 'the') AS early FROM documents")
def _(spark, d):
    return bind(spark, d, "documents").select("doc_id", tx.keyword_early("text", "the").alias("early"))


@query("txt_11_date_markers", r"SELECT event_id, len(regexp_extract_all(t, '\b(20\d{2}|19\d{2})[-/]\d{1,2}[-/]\d{1,2}\b')) AS n FROM (SELECT event_id, 'seen ' || CAST(ts AS DATE) || ' and 1999/1/2, not 12345-1-1' AS t FROM events)")
def _(spark, d):
    t = F.concat(F.lit("seen "), F.col("ts").cast("date").cast("string"), F.lit(" and 1999/1/2, not 12345-1-1"))
    return bind(spark, d, "events").select("event_id", tx.date_markers(t).cast("bigint").alias("n"))


_H = "'<a href=\"https://www.Facebook.com/' || replace(c_name, '#', '.') || '\">f</a> instagram.com/shop https://tiktok.com/@' || lower(c_mktsegment)"


@query("txt_12_social_handles", f"""WITH h AS (SELECT c_custkey AS page_id, {_H} AS html FROM customer)
SELECT DISTINCT page_id, 'facebook' AS platform, unnest(regexp_extract_all(html, '(?i)(?:facebook|fb)\\.com/([a-zA-Z0-9._-]+)', 1)) AS username FROM h UNION
SELECT DISTINCT page_id, 'tiktok', unnest(regexp_extract_all(html, '(?i)tiktok\\.com/@([a-zA-Z0-9._-]+)', 1)) FROM h""")
def _(spark, d):
    c = bind(spark, d, "customer")
    html = F.concat(F.lit('<a href="https://www.Facebook.com/'), F.replace(F.col("c_name"), F.lit("#"), F.lit(".")),
                    F.lit('">f</a> instagram.com/shop https://tiktok.com/@'), F.lower("c_mktsegment"))
    return tx.social_handles(c.select(F.col("c_custkey").alias("page_id"), html.alias("html")))


@query("prj_22_social_account_row", """SELECT c_custkey, 'https://www.facebook.com/' || c_name AS profile_url, 'facebook_' || c_name AS external_id, CAST(floor(f / 10) AS BIGINT) AS following_count,
f > 50000 AS is_verified FROM (SELECT c_custkey, c_name, c_custkey * 100 AS f FROM customer)""")
def _(spark, d):
    c = bind(spark, d, "customer").select("c_custkey", F.lit("facebook").alias("platform"), F.col("c_name").alias("username"),
                                          (F.col("c_custkey") * 100).alias("follower_count"))
    return tx.social_account_row(c).select("c_custkey", "profile_url", "external_id", "following_count", "is_verified")


@query("txt_13_token_index", f"SELECT token, id, count(*) AS n FROM (SELECT doc_id AS id, unnest({_WORDS}) AS token FROM documents) GROUP BY 1, 2")
def _(spark, d):
    return tx.token_index(bind(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "id")


@query("aud_12_keyword_placement", f"""SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS keyword_occurrences,
contains(lower(text), 'eau') AS has_secondary FROM documents""")
def _(spark, d):
    p = tx.keyword_placement(bind(spark, d, "documents"), ["the", "eau"], "text")
    return p.select("doc_id", "keyword_occurrences", F.array_contains("secondary_found", "eau").alias("has_secondary"))


@query("aud_28_duplicate_texts", "SELECT md5(text) AS text_hash, count(*) AS n_rows, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    from ..plans.audit import duplicate_texts
    return duplicate_texts(bind(spark, d, "documents"), "doc_id", "text").withColumnRenamed("first_key", "first_doc")


@query("aud_23_minification", r"""WITH l AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '\s')) AS ws, len(string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10))) AS lines FROM documents)
SELECT doc_id, (lines = 1 AND n > 500) OR (lines > 1 AND (ws / n < 0.15 OR n / lines > 200)) AS is_minified, """ + R("ws / n", 3) + " AS whitespace_ratio, " + R("n / lines", 1) + " AS avg_line_length FROM l")
def _(spark, d):
    from ..plans.audit import minification
    m = minification("text")
    return bind(spark, d, "documents").select(
        "doc_id", *[m[n].alias(n) for n in ("is_minified", "whitespace_ratio", "avg_line_length")])


# ---- products ------------------------------------------------------------

@query("prd_03_price_from_text", r"""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN p || ',500 TND' WHEN 1 THEN '€ ' || p ELSE p || 'DT' END AS price FROM
(SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_extendedprice) + 10 AS BIGINT) AS VARCHAR) AS p FROM lineitem)""")
def _(spark, d):
    p = (F.floor("l_extendedprice") + 10).cast("string")
    m = F.col("l_linenumber") % 3
    t = F.concat(F.lit("Prix : "), F.when(m == 0, F.concat(p, F.lit(",500 TND"))).when(m == 1, F.concat(F.lit("€ "), p))
                 .otherwise(F.concat(p, F.lit("DT"))), F.lit(" en stock"))
    return bind(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ft.price_from_text(t).alias("price"))


@query("prd_04_availability", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'InStock' WHEN 'N' THEN 'OutOfStock' END AS from_text, "
       "CASE WHEN l_linestatus = 'O' THEN 'InStock' ELSE 'SoldOut' END AS from_schema FROM lineitem")
def _(spark, d):
    t = F.when(F.col("l_returnflag") == "A", "Produit EN STOCK").when(F.col("l_returnflag") == "N", "Rupture de stock").otherwise("sur commande")
    s = F.when(F.col("l_linestatus") == "O", "https://schema.org/InStock").otherwise("http://schema.org/SoldOut")
    return bind(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ft.availability_from_text(t).alias("from_text"),
                                             ft.availability_from_schema(s).alias("from_schema"))


# ---- vectors -------------------------------------------------------------

@query("vec_01_embedding_text", with_("products") + r""" SELECT id, 'Title: ' || title || ' ' || chr(10) || 'Brand: ' || brand || ' ' || chr(10) || 'Category: ' || category ||
CASE WHEN specifications = '{}' THEN '' ELSE ' ' || chr(10) || 'Specifications: size: ' || json_extract_string(specifications, '$.size') END AS text FROM products""")
def _(spark, d):
    return bind(spark, d, "products").select("id", vx.embedding_text().alias("text"))


@query("vec_02_normalize", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, i AS pos, {R('e[i] / sqrt(list_dot_product(e, e))', 6)} AS x
FROM v, (SELECT unnest(range(1, 65)) AS i)""")
def _(spark, d):
    v = vx.normalize_vectors(bind(spark, d, "embeddings"), "embedding", 64)
    return v.select("vec_id", F.posexplode("embedding").alias("_p", "_x")).select(
        "vec_id", (F.col("_p") + 1).cast("bigint").alias("pos"), fixed("_x", 6).alias("x"))


_CENT = ("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM "
         "(SELECT label, i, avg(e[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label), "
         "s AS (SELECT query_id, vec_id, label, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS dist FROM v CROSS JOIN c) ")


def centroids(spark, d):
    """One query vector per label: the mean of its rows (labels are a fixed set)."""
    return bind(spark, d, "embeddings").groupBy(F.col("label").alias("query_id")).agg(vx.centroid("embedding", 64).alias("embedding"))


@query("vec_03_knn", _CENT + f"SELECT query_id, vec_id, {R('dist', 6)} AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM s) WHERE rank <= 10")
def _(spark, d):
    return vx.knn(bind(spark, d, "embeddings"), centroids(spark, d), 10).withColumn("distance", fixed("distance", 6))


@query("vec_03_knn_all", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id,
1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS dist FROM v a CROSS JOIN v b WHERE a.vec_id <> b.vec_id)
SELECT query_id, vec_id, {R('dist', 6)} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM s QUALIFY rank <= 3""")
def _(spark, d):
    e = bind(spark, d, "embeddings").select("vec_id", "embedding")
    near = vx.knn(e, e.select(F.col("vec_id").alias("query_id"), "embedding"), 4).filter("query_id <> vec_id").drop("rank")
    return top_n_per_group(near, ["query_id"], [F.asc("distance"), F.asc("vec_id")], 3).withColumn("distance", fixed("distance", 6))


@query("vec_03_knn_signatures")
def _(spark, d):
    """Approximate form; recall is tested against the exact one."""
    e = bind(spark, d, "embeddings").select("vec_id", "embedding")
    index = vx.signature_index(e, 64)
    return vx.approximate_knn(index, e.select(F.col("vec_id").alias("query_id"), "embedding"), 10, 64)


@query("vec_02_rejected", "SELECT vec_id, 'wrong length' AS reason FROM embeddings WHERE vec_id % 10 = 3 UNION ALL SELECT vec_id, 'no length' FROM embeddings WHERE vec_id % 10 = 7 "
       "UNION ALL SELECT vec_id, 'no vector' FROM embeddings WHERE vec_id % 10 = 9")
def _(spark, d):
    last = F.col("vec_id") % 10
    v = F.when(last == 3, F.slice("embedding", 1, 10)).when(last == 7, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).when(last != 9, F.col("embedding"))
    return vx.rejected_vectors(bind(spark, d, "embeddings").withColumn("embedding", v), "embedding", 64).select("vec_id", "reason")


@query("vec_05_retrieve", _CENT + f"SELECT query_id, vec_id, {R('dist', 6)} AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM s "
       "WHERE DATE '2024-01-01' + CAST(label * 7 AS INTEGER) >= DATE '2024-02-15' - INTERVAL 30 DAY) WHERE rank <= 5")
def _(spark, d):
    e = bind(spark, d, "embeddings").withColumn("report_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("label") * 7).cast("timestamp_ntz"))
    as_of = F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")
    return vx.retrieve(e, centroids(spark, d), 5, as_of).withColumn("distance", fixed("distance", 6))


@query("vec_04_chunks_stride", """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, md5(substr(text, i * 400 + 1, 500)) AS chunk_hash FROM (SELECT doc_id, text,
unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 400) AS BIGINT)))) AS i FROM documents)""")
def _(spark, d):
    c = vx.chunk_stride(bind(spark, d, "documents").select("doc_id", "text"), "text")
    return c.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_hash"))


@query("vec_04_chunks_recursive")
def _(spark, d):
    return vx.chunk_documents(bind(spark, d, "documents").select("doc_id", "lang", "text"), "text")


@query("vec_06_validate_reports", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND (source || ' ' || lang) LIKE '%' AND lang IN ('en', 'fr') AND doc_id IS NOT NULL")
def _(spark, d):
    r = bind(spark, d, "documents").select("doc_id", F.col("text").alias("markdown"), F.when(F.col("lang") == "en", "social_media").when(
        F.col("lang") == "fr", "the platform report").otherwise("platforms").alias("report_type"), F.col("doc_id").alias("competitor_id"))
    return vx.validate_reports(r)[0].select("doc_id")
