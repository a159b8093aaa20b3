import pytest
from pyspark.sql import functions as F

from rivalscope.functions import urls
from rivalscope.plans.classify import classify_url
from rivalscope.sources.sitemaps import classify_sitemap_name

CLASSES = [
    ("https://a.example/produit/perceuse-18v", "product"),
    ("https://a.example/product/90210", "product"),
    ("https://a.example/item/table-basse", "product"),
    ("https://b.example/p/kettle", "product"),
    ("https://b.example/steel-kettle-77.html", "product"),
    ("https://b.example/view?pid=31", "product"),
    ("https://c.example/categories/tools", "category"),
    ("https://c.example/categorie/produit/scie-4", "category"),
    ("https://c.example/7-garden-chairs", "category"),
    ("https://c.example/collections/winter", "category"),
    ("https://c.example/nos-marques", "category"),
    ("https://d.example/About_the_team", "about"),
    ("https://d.example/qui-sommes-nous", "about"),
    ("https://d.example/%C3%A0_propos", "about"),
    ("https://d.example/à-propos-de-nous", "about"),
    ("https://e.example/contactez-nous", "contact"),
    ("https://e.example/evenements-2024", "event"),
    ("https://e.example/articles/choix", "blog"),
    ("https://e.example/wiki/drill-bits", "blog"),
    ("https://e.example/actualités/soldes", "news"),
    ("https://e.example/offres/ete", "promo"),
    ("https://f.example/login?next=1", "auth"),
    ("https://f.example/tickets/9", "support"),
    ("https://f.example/politique-retours", "rules"),
    ("https://f.example/author/mia", "other"),
    ("https://f.example/page/14", "other"),
    ("https://g.example/boutique/maison/salon", "category"),
    ("https://g.example/boutique/maison/salon/lampe", "product"),
    ("https://g.example/boutique/maison/salon/4711", "other"),
    ("https://h.example/", "other"),
]


def values(spark, rows, expr):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, u string")
    return [r[0] for r in df.orderBy("i").select(expr("u")).collect()]


def test_url_classes(spark):
    assert values(spark, [u for u, _ in CLASSES], classify_url) == [c for _, c in CLASSES]


def test_path_only_ignores_host(spark):
    u = ["https://blog.shop.example/x"]
    assert values(spark, u, classify_url) == ["blog"]
    assert values(spark, u, lambda c: classify_url(c, path_only=True)) == ["other"]


def test_sitemap_names(spark):
    names = {"product-sitemap1.xml": "product", "produit-sitemap.xml": "product", "category-sitemap.xml": "category",
             "product_cat-sitemap.xml": "category", "post-sitemap.xml": "other", "product_tag-sitemap.xml": "other",
             "sitemap.xml": None}
    got = values(spark, ["https://s.example/" + n for n in names], classify_sitemap_name)
    assert got == list(names.values())


@pytest.mark.parametrize("url,want", [
    ("HTTP://Example.COM:80", "http://example.com/"),
    ("https://example.com:443/a?b=2&a=1&c=#frag", "https://example.com/a?a=1&b=2&c="),
    ("https://example.com:8443/a", "https://example.com:8443/a"),
    ("https://u:p@example.com/a?a-b=1&a=2", "https://example.com/a?a=2&a-b=1"),
    ("https://example.com/?q=a%20b", "https://example.com/?q=a+b"),
    ("not a url", None),
])
def test_canonical(spark, url, want):
    assert values(spark, [url], urls.canonical_url) == [want]


def test_resolve(spark):
    base = "https://s.example/a/b?q=1#f"
    cases = {"c": "https://s.example/a/c", "/c?x=1#y": "https://s.example/c?x=1", "../d": "https://s.example/d",
             "//o.example/e": "https://o.example/e", "http://o.example/f": "http://o.example/f", "?z=2": "https://s.example/a/b?z=2",
             "#": None, "": None, "javascript:x()": None, "./g/../h": "https://s.example/a/h"}
    got = values(spark, list(cases), lambda c: urls.resolve_url(c, F.lit(base)))
    assert got == list(cases.values())


def test_next_page(spark):
    assert values(spark, ["https://s.example/list/2/"], lambda c: urls.next_page_url(c, "__path__", 3)) == ["https://s.example/list/3/"]
    assert values(spark, ["https://s.example/list"], lambda c: urls.next_page_url(c, "__path__", 2)) == ["https://s.example/list/2/"]
    assert values(spark, ["https://s.example/l?a=1&page=2"], lambda c: urls.next_page_url(c, "page", 3)) == ["https://s.example/l?a=1&page=3"]
