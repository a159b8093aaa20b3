"""Page types, link discovery, homepage metadata and main content from page parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import BASE, pagination_parameter, resolve_url, url_part
from ..operators.text import bind_once
from ..sources.html import NOISE, attr, first, inside, subtext, tagged
from .classify import classify_url, page_type
from .page_features import json_ld_texts, rel_has
from .products import _clean, _meta, json_ld_nodes

# Parts of links that are not followed from a homepage.
EXCLUDED_LINK_PARTS = ["#", "javascript:", "mailto:", "tel:", "login", "signup", "register", "account", "cart", "checkout",
                       "wishlist", "compare", "privacy", "terms", "cookie", "search", "tracking", "returns", "compte",
                       "connexion", "wish", "panier"]
# Texts of list controls and of related-product headings.
FILTER_TEXT = (r"(?iU)\b(tri|sort|trier\s*par|prix\s*croissant|prix\s*décroissant|tarif\s*croissant|tarif\s*décroissant|"
               r"Affichage de [0-9]+\-[0-9]+|Sous-categories|Il y a \d+ produits)\b")
RELATED_TEXT = (r"(?iU)produits similaires|produits connexes|aussi aimer|vous aimerez aussi|produits associés|autres produits|"
                r"voir aussi|produits recommandés|Produits dans la même|\w+ ont également apprécié|\w+ vous recommande|"
                r"\w+ dans la même catégorie|related|similar|you may also like|products you may like|produits associes|"
                r"produits liés|cross-sell|upsell")


def _class_is(e: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attr(e, "class"), F.lit("")), r"\s+"), name)


def discover_links(parts: DataFrame) -> DataFrame:
    """Distinct same-host links in navigation, header, main and list items, with their class."""
    used = F.filter("anchors", lambda a: inside(a, ["nav", "header", "main", "li"]) & (F.coalesce(attr(a, "href"), F.lit("")) != ""))
    hrefs = F.filter(F.transform(used, lambda a: attr(a, "href")), lambda h: ~F.exists(
        F.array(*[F.lit(p) for p in EXCLUDED_LINK_PARTS]), lambda p: F.contains(F.lower(h), p))
        & ~h.rlike(r"^https?://[www\.]?[a-zA-Z0-9-]+\.[a-zA-Z]{2,}/?$"))
    urls = F.array_distinct(F.array_compact(F.transform(hrefs, lambda h: resolve_url(h, BASE))))
    same = F.filter(urls, lambda u: url_part(u, "authority") == F.col("base.authority"))
    return (parts.select("page_id", F.explode(same).alias("link"))
            .withColumn("url_class", classify_url("link")))


def has_schema_product() -> Column:
    types = F.exists(json_ld_texts(), lambda t: t.rlike(r'(?i)"@type"\s*:\s*("[^"]*product|\[[^\]]*product)'))
    og = F.exists("metas", lambda m: (attr(m, "property") == "og:type") & F.lower(F.coalesce(attr(m, "content"), F.lit(""))).contains("product"))
    items = F.size(F.filter("els", lambda e: F.coalesce(attr(e, "itemtype"), F.lit("")).contains("schema.org/Product")))
    return types | F.coalesce(og, F.lit(False)) | (items == 1)


def has_filter_controls() -> Column:
    def control(e: Column) -> Column:
        i = F.coalesce(attr(e, "id"), F.lit(""))
        form = (e["tag"] == "form") & ((i == "productsSortForm") | _class_is(e, "productsSortForm")
                                       | _class_is(e, "wd-product-filters") | _class_is(e, "nbrItemPage"))
        select = (e["tag"] == "select") & i.isin("selectProductSort", "nb_item")
        return form | select
    shown = F.exists("els", lambda e: (e["tag"] == "li") & inside(e, ["#switch"]) & F.coalesce(attr(e, "id").isin("grid", "list"), F.lit(False)))
    text = F.exists("nodes", lambda n: (n["tag"] == "#text") & inside(n, ["body"]) & n["text"].rlike(FILTER_TEXT))
    return F.exists("els", control) | shown | text


def pagination_type() -> dict[str, Column]:
    """Static pagination: URL parameter, numbered links, or a next link."""
    hrefs = F.array_compact(F.transform(F.filter("anchors", lambda a: inside(a, ["#pager"])), lambda a: attr(a, "href")))
    hrefs = F.filter(hrefs, lambda h: ~h.isin("", "#", "javascript:void(0)"))
    linked = first(F.array_compact(F.transform(hrefs, lambda h: F.when(h.rlike(r"[?&]page=[^&#]"), "page").when(
        h.rlike(r"[?&]p=[^&#]"), "p").when(h.rlike(r"/\d+/?$"), "__path__"))))
    pattern = F.coalesce(pagination_parameter("url"), linked)
    following = (F.exists("anchors", lambda a: rel_has(a, "next") | F.coalesce(attr(a, "class").contains("next"), F.lit(False)))
                 | F.exists("els", lambda e: F.coalesce(attr(e, "aria-label").rlike("ext|uivant"), F.lit(False))))
    return {"pagination_type": F.when(pattern.isNotNull(), "url").when(following, "next_button").otherwise("not_found"),
            "pagination_pattern": pattern}


def main_heading() -> Column:
    """The only h1, or without h1 the only h2; related-product headings do not count."""
    def texts(tag: str) -> Column:
        return F.filter(F.transform(tagged(F.col("heads"), tag), lambda h: subtext(F.col("nodes"), h)), lambda t: ~t.rlike(RELATED_TEXT))
    return bind_once(texts("h1"), lambda h1: F.when(F.size(h1) == 1, first(h1)).when(
        (F.size(h1) == 0) & (F.size(texts("h2")) == 1), first(texts("h2"))))


def classify_pages(parts: DataFrame, url_class: Column | None = None) -> DataFrame:
    """Page type, URL class and pagination of each page.

    ``url_class`` is the class of the URL where it is known beforehand, such as ``home``; else it is found from the URL.
    """
    squeezed = F.lower(F.replace(main_heading(), F.lit(" "), F.lit("")))
    title = subtext(F.col("nodes"), first(tagged(F.col("nodes"), "title")))
    objs = F.filter(json_ld_nodes(json_ld_texts()), lambda o: F.lower(F.get_json_object(o, "$['@type']")) == "product")
    named = (squeezed == F.get_json_object(first(objs), "$.name")) | (squeezed == F.lower(F.replace(title, F.lit(" "), F.lit(""))))
    base = parts.withColumns({
        "url_class": classify_url("url") if url_class is None else url_class, "schema_product": has_schema_product(),
        "single_product_named": (F.size(objs) == 1) & F.coalesce(named, F.lit(False)),
        "filters": has_filter_controls(), **pagination_type()})
    kind = page_type(F.col("url_class"), {
        "schema_product": F.col("schema_product"), "single_product_named": F.col("single_product_named"),
        "filters": F.col("filters"), "paginated": F.col("pagination_type") != "not_found"})
    return base.select("page_id", "url", "url_class", kind.alias("page_type"), "pagination_type", "pagination_pattern",
                       "schema_product", "single_product_named", "filters")


def homepage_metadata(parts: DataFrame) -> DataFrame:
    """Title, description and the usual meta fields; missing ones are empty texts."""
    def named(name: str) -> Column:
        return attr(first(F.filter("metas", lambda m: attr(m, "name") == name)), "content")

    def prop(name: str) -> Column:
        return attr(first(F.filter("metas", lambda m: attr(m, "property") == name)), "content")

    fields = {
        "title": subtext(F.col("nodes"), first(tagged(F.col("nodes"), "title"))),
        **{n: named(n) for n in ("description", "keywords", "author", "robots")},
        "canonical": attr(first(F.filter("links", lambda e: rel_has(e, "canonical"))), "href"),
        "favicon": attr(first(F.filter("links", lambda e: rel_has(e, "icon"))), "href"),
        "logo": attr(first(F.filter("imgs", lambda i: attr(i, "alt") == "logo")), "src"),
        "site_name": prop("og:site_name"), "locale": prop("og:locale"), "page_type": prop("og:type"),
        "updated_time": prop("og:updated_time"), "published_time": prop("article:published_time"),
        "modified_time": prop("article:modified_time"), "image": prop("og:image"), "image_alt": prop("og:image:alt"),
        "image_width": prop("og:image:width"), "image_height": prop("og:image:height"), "image_type": prop("og:image:type"),
        "image_secure_url": prop("og:image:secure_url"), "twitter_card": named("twitter:card"),
        "twitter_title": named("twitter:title"), "twitter_description": named("twitter:description"),
        **{f"twitter_{k}": named(f"twitter:{k}") for k in ("label1", "data1", "label2", "data2")}}
    return parts.select("page_id", "url", *[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()])


def main_content(parts: DataFrame) -> DataFrame:
    """Readable text of the longest content container, else of the body; title and language.

    Lengths come from the running text length of the nodes, so containers are compared by two
    look-ups each, and only the text of the longest (the first of equal ones) is put together.
    """
    # Content containers.
    boxes = F.filter("els", lambda e: e["tag"].isin("article", "main") | (e["tag"].isin("section", "div") & (
        (F.coalesce(attr(e, "id"), F.lit("")) == "content"))) | ((e["tag"] == "div") & _class_is(e, "content"))
        | ((e["tag"] == "section") & _class_is(e, "article")))
    sized = F.transform(bind_once(boxes, lambda b: F.when(F.size(b) > 0, b).otherwise(tagged(F.col("els"), "body"))), lambda e: F.struct(
        (F.get(F.col("nodes"), e["end"])["shown"] - e["shown"]).alias("shown"), (-e["seq"]).alias("before"), e["seq"].alias("seq"), e["end"].alias("end")))
    staged = parts.withColumn("_box", F.array_max(sized))
    inner = F.slice(F.col("nodes"), F.col("_box.seq") + 2, F.col("_box.end") - F.col("_box.seq"))
    texts = F.filter(inner, lambda n: (n["tag"] == "#text") & ~inside(n, [*NOISE, "#clutter"]))
    best = F.coalesce(F.array_join(F.transform(texts, lambda n: n["text"]), " "), F.lit(""))
    heading = _clean(subtext(F.col("nodes"), first(tagged(F.col("heads"), "h1")), " "))
    title = _clean(subtext(F.col("nodes"), first(tagged(F.col("nodes"), "title")), " "))
    return staged.select(
        "page_id", "url", F.coalesce(_meta("og:title", "twitter:title", "title"), heading, title).alias("title"),
        best.alias("text"), _clean(attr(first(tagged(F.col("nodes"), "html")), "lang")).alias("language"))


def has_search_input() -> Column:
    def search(e: Column) -> Column:
        name = F.lower(F.coalesce(attr(e, "name"), F.lit("")))
        return (e["tag"] == "input") & ((F.coalesce(attr(e, "type"), F.lit("")) == "search") | name.isin("q", "s", "search", "query")
                                        | F.lower(F.coalesce(attr(e, "placeholder"), F.lit(""))).contains("search"))
    return F.exists("els", search)

