from pyspark.sql import functions as F

from rivalscope.plans import audit, page_features as pf, page_types, products
from rivalscope.sources.html import BITS, page_elements

HTML = """<!DOCTYPE html><html lang="FR"><head><title> Best drill | Shop - now now </title>
<meta name="Description" content="Buy now the drill"><meta property="og:title" content="T1"><meta property="og:title" content="T2">
<link rel="canonical" href="/c?x=1#f"><link rel="shortcut icon" href="fav.ico"><meta name="viewport" content="w">
<script type="application/ld+json">{"@graph": [{"@type": "BreadcrumbList"}, {"@type": "Product", "name": "D", "image": ["/i.png"],
"offers": {"priceSpecification": {"price": 12.5, "priceCurrency": "EUR"}, "availability": "https://schema.org/OutOfStock"}}]}</script>
<style>@media x{}</style></head><body style="width: 500px"><nav><a href="/a">A</a><a href="/cart">no</a></nav>
<h1>One</h1><h3>Three drill</h3><img src="img-01.png"><picture><img src="big-photo.webp" alt=" drill "></picture>
<a href="http://other.x/y" target=_blank>click here</a><a href="../up#z" rel="nofollow">up</a>
<p>Lorem ipsum <b>bold<br><p>second 2024-01-02</p>
<table><tr><td><table></table></td></tr></table>
<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">X</span>
<div itemprop="offers" itemscope itemtype="Offer"><span itemprop="price">3</span></div></div>
<h2>Description</h2><p>Strong.</p><h2>Other</h2><center>x</center><!-- c --><footer>foot</footer></body></html>"""


def pages(spark, html=HTML, url="https://shop.x/d/e?q=1"):
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


def test_nodes_keep_order_and_nesting(spark):
    rows = page_elements(pages(spark)).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    assert rows[0].tag == "#doctype"
    by_seq = {r.seq: r for r in rows}
    for r in rows:
        assert r.end >= r.seq
        if r.parent >= 0:
            p = by_seq[r.parent]
            assert p.seq < r.seq and p.end >= r.end and r.above & p.above == p.above and r.above & BITS.get(p.tag, 0) == BITS.get(p.tag, 0)


def test_features(spark):
    r = pf.audit_features(pages(spark), "drill").collect()[0]
    want = dict(
        title="Best drill | Shop - now now", title_duplicate_words=1, title_has_brand=True, title_power_words=True,
        title_keyword_near_start=True, meta_description="Buy now the drill", description_has_cta=True, h1_count=1, h3_count=1,
        heading_hierarchy_valid=True, images=2, images_without_alt=1, images_not_responsive=1, image_poor_names=["img-01.png"],
        internal_links=["https://shop.x/a", "https://shop.x/cart", "https://shop.x/up#z"], external_links=["http://other.x/y"],
        internal_nofollow_count=1, generic_anchors=1, unsafe_cross_origin_links=1, lorem_ipsum=True, inline_styles=1,
        open_graph={"og:title": "T1"}, favicon="https://shop.x/d/fav.ico", has_nested_tables=True,
        deprecated_tags={"center": 1}, language="fr", canonical_url="https://shop.x/c?x=1", has_json_ld=True, has_schema=True,
        uses_webp=True, is_mobile_friendly=False, has_media_queries=True, has_doctype=True, has_charset=False)
    assert {k: r[k] for k in want} == want
    md = r.microdata
    assert len(md) == 1 and [(p.name, p.value) for p in md[0].properties] == [("name", "X"), ("offers", "Offer")]
    assert "foot" not in r.visible_text and r.visible_text.startswith("Best drill")


def test_scores_by_hand(spark):
    r = audit.score_pages(pf.audit_features(pages(spark), "drill"), keywords=["drill"]).collect()[0]
    # Points x weight: title 15, meta 2.88, headings 12, alt 3.5, responsive 3.2, broken 15, open graph 2.1, url 5,
    # inline style 1.45, flash 5, frameset 5, unsafe 2.8 of 102.
    assert r.on_page_score_percent == round((15 + 2.88 + 12 + 3.5 + 3.2 + 15 + 2.1 + 5 + 1.45 + 5 + 5 + 2.8) / 102 * 100, 1)
    assert "Deprecated Html: Deprecated HTML tags found. (Penalty: 5.0/5.0)" in r.on_page_issues
    assert "Title: Title present and well-sized. (Score: 10.0/10.0)" in r.on_page_successes
    assert r.overall_seo_score_percent == round((r.technical_score_percent * 0.35 + r.content_score_percent * 0.25) / 0.6 + 1e-9, 1)


def test_weight_override(spark):
    base = audit.score_pages(pf.audit_features(pages(spark))).collect()[0]
    less = audit.score_pages(pf.audit_features(pages(spark)), weights={"title": {"weight": 0}}).collect()[0]
    assert less.on_page_score_percent < base.on_page_score_percent
    assert less.technical_score_percent == base.technical_score_percent


def test_page_without_text(spark):
    r = audit.score_pages(pf.audit_features(pages(spark, "<html></html>"))).collect()[0]
    assert r.content_score_percent == 0.0
    assert r.content_issues == ["Content: Analysis module did not run or found no content."]


def test_product_and_page_type(spark):
    parts = pf.page_parts(pages(spark))
    p = products.extract_products(parts).collect()[0]
    assert (p.title, p.price, p.currency, p.availability) == ("D", "12.5", "EUR", "OutOfStock")
    assert p.images == ["https://shop.x/i.png"] and p.details == {"description": "Strong."}
    t = page_types.classify_pages(parts).collect()[0]
    assert t.page_type == "product_detail"
    links = {r.link for r in page_types.discover_links(parts).collect()}
    assert links == {"https://shop.x/a"}
    c = page_types.main_content(parts).collect()[0]
    assert "Lorem ipsum" in c.text and "foot" not in c.text


def test_list_and_pagination(spark):
    html = "<body><select id='nb_item'></select><ul class='pagination'><a href='/list?p=2'>2</a></ul></body>"
    t = page_types.classify_pages(pf.page_parts(pages(spark, html, "https://s.x/misc"))).collect()[0]
    assert (t.page_type, t.pagination_type, t.pagination_pattern) == ("product_list_paginated", "url", "p")


def test_product_links(spark):
    ld = '{"@type": "ItemList", "itemListElement": [{"url": "/1"}, {"item": {"url": "/2"}}]}'
    html = f"<script type='application/ld+json'>{ld}</script>"
    row = pf.page_parts(pages(spark, html)).select(products.product_links(pf.json_ld_texts()).alias("l")).collect()[0]
    assert row.l == ["/1", "/2"]


def test_meta_fallback_product(spark):
    html = ("<meta property='product:price:amount' content='9'><h1>Name</h1><span itemprop='sku' content='S1'></span>"
            "<p>en stock</p>")
    p = products.extract_products(pf.page_parts(pages(spark, html))).collect()[0]
    assert (p.title, p.price, p.sku, p.availability, p.currency) == ("Name", "9", "S1", "InStock", "TND")


def test_asset_caching_limit(spark):
    rows = [(1, "css", f"u{i}", 200, {"ETag": "x"}) for i in range(15)]
    a = spark.createDataFrame(rows, "page_id int, resource_type string, url string, status_code int, headers map<string,string>")
    assert audit.asset_caching(a, 10).count() == 10
    assert audit.asset_caching(a).filter(F.col("has_etag")).count() == 15


def test_deep_nesting_stays_linear(spark):
    """10,000 elements inside each other: places of nodes take constant space, features come from look-ups."""
    deep = 10_000
    html = ("<html><body>" + "<div class='content'>" * deep + "<span itemscope><b itemprop='name'>x</b></span><a href='/p/2'>2</a>"
            + "</div>" * deep + "<ul class='pagination'><li><a href='?page=2'>2</a></li></ul></body></html>")
    rows = page_elements(pages(spark, html)).select("seq", "end", "depth", "above", "scope", "tag").collect()
    assert max(r.depth for r in rows) == deep + 4 and all(r.end < len(rows) for r in rows)
    assert [r.scope >= 0 for r in rows if r.tag == "b"] == [True]
    parts = pf.page_parts(pages(spark, html))
    got = parts.select(F.size(pf.microdata()).alias("n"), page_types.pagination_type()["pagination_pattern"].alias("p")).collect()[0]
    assert (got.n, got.p) == (1, "page")
    assert page_types.main_content(parts).collect()[0].text == "x 2"


def test_main_content_is_the_longest_container(spark):
    html = ("<body><div id='content'>abc<nav>menu</nav></div><main>ab<div class='my-footer'>a very long line left out</div>"
            "<p class='x copyright'>left</p><p>cd</p></main><article><header>kept</header></article><section class='article'>12345</section></body>")
    assert page_types.main_content(pf.page_parts(pages(spark, html))).collect()[0].text == "ab cd"
    tie = "<body><main>abcd</main><article>wxyz</article></body>"
    assert page_types.main_content(pf.page_parts(pages(spark, tie))).collect()[0].text == "abcd"
    assert page_types.main_content(pf.page_parts(pages(spark, "<body><p>only <i>this</i></p></body>"))).collect()[0].text == "only this"
    assert page_types.main_content(pf.page_parts(pages(spark, ""))).collect()[0].text == ""


def test_microdata_of_nested_items(spark):
    html = ("<div itemscope itemtype=A><i itemprop=n>1</i><div itemprop=o itemscope itemtype=B><i itemprop=m>2</i></div><i itemprop=k>3</i></div>"
            "<div itemscope><i itemprop=z>4</i></div><i itemprop=stray>5</i><div itemscope></div>")
    got = pf.page_parts(pages(spark, html)).select(pf.microdata().alias("m")).collect()[0].m
    assert [(i.type, [(p.name, p.value) for p in i.properties]) for i in got] == [
        ("A", [("n", "1"), ("o", "B"), ("k", "3")]), ("UnknownType", [("z", "4")])]


def test_open_references(spark):
    """By the standard ``&amp`` counts without its semicolon; with ``closed_only`` it stays as written, scripts too."""
    html = "<title>a&amp;&amp</title><a href='/x?b=1&amp;c&amp'>t &#65;&#66 R&D &am</a><script>if (a&&b) '&amp;&amp'</script>\ue000"
    std = pf.page_parts(pages(spark, html)).collect()[0]
    own = pf.page_parts(pages(spark, html), closed_only=True).collect()[0]
    assert [n.text for n in std.nodes if n.tag == "#text"] == ["a&&", "t AB R&D &am", "if (a&&b) '&amp;&amp'", "\ue000"]
    assert [n.text for n in own.nodes if n.tag == "#text"] == ["a&&amp", "t A&#66 R&D &am", "if (a&&b) '&amp;&amp'", "\ue000"]
    assert std.anchors[0].attrs["href"] == "/x?b=1&c&" and own.anchors[0].attrs["href"] == "/x?b=1&c&amp"
    title = pf.pick(pf.page_parts(pages(spark, html), closed_only=True), pf.title_features()).collect()[0]
    assert (title.title, title.title_length) == ("a&&amp", 6)
