"""Pages built from table rows, of several kinds each, so that expected values differ from page to page.

One SELECT per corpus means the same in Spark and in SQL: the engine parses its HTML, the SQL side
computes the outcome from the columns the HTML was made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import page_features as pf
from ..plans import page_types, products
from ..plans.classify import classify_url
from ..sources.tables import read_table
from . import bind, query, with_
from .bindings import BINDINGS

#: Part pages of six kinds: JSON-LD with one offer, a graph with a price specification, a list of objects,
#: meta tags, item properties, and plain text.
SHOP = """SELECT p_partkey AS page_id, p_partkey % 6 AS kind, 'https://shop.example/misc/' || cast(p_partkey AS string) AS url,
'<html><head><title>Shop</title>' || CASE p_partkey % 6
WHEN 0 THEN '<script type="application/ld+json">{"@type": "Product", "name": "' || p_name || '", "sku": "S' || cast(p_partkey AS string) || '", "url": "/p/' || cast(p_partkey AS string) || '", "brand": {"name": "' || p_brand || '"}, "offers": {"price": "' || cast(p_size AS string) || '.50", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}}</script></head><body>'
WHEN 1 THEN '<script type="application/ld+json">{"@graph": [{"@type": "WebSite", "name": "x"}, {"@type": "Product", "name": "' || p_name || '", "mpn": "M' || cast(p_partkey AS string) || '", "brand": "' || p_brand || '", "offers": [{"url": "/o/' || cast(p_partkey AS string) || '", "priceSpecification": {"price": ' || cast(p_size AS string) || ', "priceCurrency": "USD"}, "availability": ["http://schema.org/OutOfStock"]}]}]}</script></head><body>'
WHEN 2 THEN '<script type="application/ld+json">[{"@type": "ItemList", "itemListElement": [{"url": "/i/' || cast(p_partkey AS string) || '"}, {"item": {"url": "/j/' || cast(p_size AS string) || '"}}]}, {"@type": "Product", "name": "' || p_name || '"}]</script></head><body>'
WHEN 3 THEN '<meta property="og:title" content="' || p_name || '"><meta property="product:price:amount" content="' || cast(p_size AS string) || '"><meta property="product:price:currency" content="DKK"></head><body>'
WHEN 4 THEN '</head><body><h1> ' || p_name || ' </h1><b itemprop="price" content="' || cast(p_size AS string) || '">p</b><i itemprop="brand">' || p_brand || '</i><i itemprop="sku" data-sku="D' || cast(p_partkey AS string) || '"></i>'
ELSE '</head><body><h1>' || p_name || '</h1><p>now ' || cast(p_size AS string) || ' TND</p>' END
|| CASE p_partkey % 5 WHEN 0 THEN '<h2>Description</h2><p>made for ' || p_brand || '</p><script>x()</script><h3>More</h3>'
WHEN 1 THEN '<h3>Fiche technique</h3><p>size</p><b>' || cast(p_size AS string) || '</b>'
WHEN 2 THEN '<h2>Our DETAILS</h2><h2>Next</h2>' WHEN 3 THEN '<h4>Reviews</h4><p>none</p>' ELSE '<p>rupture</p>' END
|| '</body></html>' AS html, p_name, p_brand, p_size FROM part"""

#: List, product, content and side pages.
KINDS = """SELECT p_partkey AS page_id, p_partkey % 7 AS kind,
'https://shop.example/' || CASE p_partkey % 7 WHEN 0 THEN 'contact-us' WHEN 1 THEN '' ELSE 'misc/' || cast(p_partkey AS string) END || CASE p_partkey % 7 WHEN 4 THEN '?page=2' ELSE '' END AS url,
'<html><head><title>Page</title></head><body>' || CASE p_partkey % 7
WHEN 2 THEN '<div itemscope itemtype="https://schema.org/Product"><i itemprop="name">' || p_name || '</i></div>'
WHEN 3 THEN '<form id="productsSortForm"></form>'
WHEN 4 THEN '<ul class="grid display"><li id="grid">g</li></ul>'
WHEN 5 THEN '<p>Trier par</p><div class="box"><ul class="pagination"><li><a href="#">1</a></li><li><a href="/misc/' || cast(p_size AS string) || '/">2</a></li></ul></div>'
WHEN 6 THEN '<ul><li id="grid">' || p_name || '</li></ul><a rel="next" href="/n">on</a>'
ELSE '<p>' || p_name || '</p>' END || '</body></html>' AS html FROM part"""

#: Items within items: the number of levels and the properties differ by part.
ITEMS = """SELECT p_partkey AS page_id, 'https://shop.example/i' AS url, p_size, p_partkey, p_brand, p_name,
'<html><body><div itemscope itemtype="Product"><b itemprop="name">' || p_name || '</b>' || CASE WHEN p_size % 3 = 0
THEN '<div itemprop="brand" itemscope itemtype="Brand"><i itemprop="name">' || p_brand || '</i><p itemscope><u itemprop="deep">x</u></p></div>' ELSE '' END
|| '<meta itemprop="sku" content="' || cast(p_partkey AS string) || '"></div>' || CASE WHEN p_size % 2 = 0 THEN '<p itemscope><a itemprop="link" href="/p">y</a></p>' ELSE '' END
|| CASE WHEN p_size % 5 = 0 THEN '<div itemscope></div><i itemprop="stray">z</i>' ELSE '' END || '</body></html>' AS html FROM part"""

#: Whole document texts, markup taken out, in two containers beside navigation and a noisy block.
_CLEAN = "trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 .,]+', ' ', 'g'))"
_NOTE = "trim(repeat('note ', cast(doc_id % 400 AS int)))"
CONTENT_SQL = f"SELECT doc_id, {_CLEAN} AS a, {_NOTE} AS b FROM documents"


def _content(spark, d):
    docs = read_table(spark, "documents", d)
    a = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9 .,]+", " "))
    b = F.trim(F.repeat(F.lit("note "), (F.col("doc_id") % 400).cast("int")))
    html = F.concat(F.lit("<html lang='en'><head><title>"), F.col("doc_id").cast("string"), F.lit("</title></head><body><nav>menu of the site</nav><main><p>"), a,
                    F.lit("</p><div class='page-footer'>"), a, a, F.lit("</div></main><article><header>"), b, F.lit("</header><form>"), a, F.lit("</form></article></body></html>"))
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("https://shop.example/c").alias("url"), html.alias("html"))


BINDINGS.update(shop_pages=SHOP, kind_pages=KINDS, item_pages=ITEMS)


def parts(spark, d, name):
    return pf.page_parts(bind(spark, d, name))


_FROM_TEXT = "CASE WHEN page_id % 5 = 4 THEN 'OutOfStock' END"
_SIZE = "CAST(p_size AS VARCHAR)"


@query("prd_01_product_kinds", with_("shop_pages") + f""" SELECT page_id, p_name AS title,
CASE kind WHEN 0 THEN {_SIZE} || '.50' WHEN 2 THEN NULL WHEN 5 THEN {_SIZE} || ' TND' ELSE {_SIZE} END AS price,
CASE kind WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 3 THEN 'DKK' ELSE 'TND' END AS currency,
CASE kind WHEN 0 THEN 'InStock' WHEN 1 THEN 'OutOfStock' ELSE {_FROM_TEXT} END AS availability,
CASE WHEN kind IN (0, 1, 4) THEN p_brand END AS brand,
CASE kind WHEN 0 THEN 'S' || page_id WHEN 1 THEN 'M' || page_id WHEN 4 THEN 'D' || page_id END AS sku FROM shop_pages""")
def _(spark, d):
    return products.extract_products(parts(spark, d, "shop_pages")).select("page_id", "title", "price", "currency", "availability", "brand", "sku")


@query("prd_05_product_link_kinds", with_("shop_pages") + f""" SELECT page_id, '/p/' || page_id AS link FROM shop_pages WHERE kind = 0
UNION ALL SELECT page_id, '/i/' || page_id FROM shop_pages WHERE kind = 2 UNION ALL SELECT page_id, '/j/' || {_SIZE} FROM shop_pages WHERE kind = 2""")
def _(spark, d):
    found = pf.pick(parts(spark, d, "shop_pages"), {"found": products.product_links(pf.json_ld_texts())})
    return found.select("page_id", F.explode("found").alias("link"))


@query("prd_06_section_kinds", with_("shop_pages") + f""" SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'description' WHEN 1 THEN 'fiche technique' ELSE 'our details' END AS heading,
CASE page_id % 5 WHEN 0 THEN 'made for ' || p_brand WHEN 1 THEN 'size ' || {_SIZE} ELSE '' END AS body FROM shop_pages WHERE page_id % 5 < 3""")
def _(spark, d):
    found = pf.pick(parts(spark, d, "shop_pages"), {"found": products.product_sections()})
    return found.select("page_id", F.explode("found").alias("heading", "body"))


@query("cls_06_page_kinds", with_("kind_pages") + """ SELECT page_id, CASE kind WHEN 0 THEN 'other' WHEN 1 THEN 'general' WHEN 2 THEN 'product_detail' WHEN 3 THEN 'product_list'
WHEN 6 THEN 'content_list' ELSE 'product_list_paginated' END AS page_type, CASE WHEN kind IN (4, 5) THEN 'url' WHEN kind = 6 THEN 'next_button' ELSE 'not_found' END AS pagination_type,
CASE kind WHEN 4 THEN 'page' WHEN 5 THEN '__path__' END AS pagination_pattern FROM kind_pages""")
def _(spark, d):
    known = F.when(F.col("url") == "https://shop.example/", "home").otherwise(classify_url("url"))
    return page_types.classify_pages(parts(spark, d, "kind_pages"), known).select("page_id", "page_type", "pagination_type", "pagination_pattern")


@query("aud_17_nested_items", with_("item_pages") + """ SELECT page_id, 'Product(name=' || p_name || ';' || CASE WHEN p_size % 3 = 0 THEN 'brand=Brand;' ELSE '' END || 'sku=' || p_partkey || ')'
|| CASE WHEN p_size % 2 = 0 THEN '|UnknownType(link=/p)' ELSE '' END AS items FROM item_pages""")
def _(spark, d):
    item = lambda i: F.concat(i["type"], F.lit("("), F.array_join(F.transform(i["properties"], lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";"), F.lit(")"))
    found = pf.pick(parts(spark, d, "item_pages"), {"found": pf.microdata()})
    return found.select("page_id", F.array_join(F.transform("found", item), "|").alias("items"))


@query("txt_10_longest_container", f"WITH made AS ({CONTENT_SQL}) SELECT doc_id AS page_id, CAST(doc_id AS VARCHAR) AS title, CASE WHEN length(b) > length(a) THEN b ELSE a END AS text, 'en' AS language FROM made")
def _(spark, d):
    return page_types.main_content(pf.page_parts(_content(spark, d))).select("page_id", "title", "text", "language")


#: Homepages of suppliers: links in navigation, header, main and list items count, others don't.
HOMES = """SELECT s_suppkey AS page_id, 'https://site' || cast(s_suppkey AS string) || '.example/' AS url, s_suppkey, s_nationkey,
'<html><body><nav><a href="/c/' || cast(s_nationkey AS string) || '">c</a><a href="/LOGIN?x">l</a></nav><header><a href="mailto:a@b.example">m</a><a href="h/' || cast(s_suppkey AS string) || '#top">h</a></header>'
|| '<div><a href="/outside/' || cast(s_suppkey AS string) || '">o</a><ul><li><p><a href="https://site' || cast(s_suppkey AS string) || '.example/li">i</a></p></li></ul></div><main><a href="https://other.example/x">x</a><a href="/c/'
|| cast(s_nationkey AS string) || '">again</a>' || CASE WHEN s_suppkey % 2 = 0 THEN '<a href="../m/' || cast(s_suppkey % 10 AS string) || '">even</a>' ELSE '<a href="">none</a>' END || '</main></body></html>' AS html FROM supplier"""
BINDINGS["home_pages"] = HOMES


@query("cls_05_home_links", with_("home_pages") + """ SELECT page_id, url || path AS link FROM (SELECT page_id, url, 'c/' || s_nationkey AS path FROM home_pages
UNION ALL SELECT page_id, url, 'li' FROM home_pages UNION ALL SELECT page_id, url, 'm/' || (s_suppkey % 10) FROM home_pages WHERE s_suppkey % 2 = 0)""")
def _(spark, d):
    return page_types.discover_links(parts(spark, d, "home_pages")).select("page_id", "link")
