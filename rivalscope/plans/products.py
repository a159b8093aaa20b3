"""Product fields from JSON-LD, meta tags and item properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_col
from ..functions.text import availability_from_schema, availability_from_text, price_from_text
from ..functions.urls import BASE, resolve_url
from ..operators.text import bind_once
from ..sources.html import attr, first, has_attr, subtext, tagged
from .page_features import json_ld_texts

_TYPE = "$['@type']"


def _clean(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def json_ld_nodes(texts: Column) -> Column:
    """JSON-LD objects of a page as texts: list members and graph members are objects of their own."""
    def members(t: Column) -> Column:
        graph = F.from_json(F.get_json_object(t, "$['@graph']"), "array<string>")
        listed = F.when(F.trim(t).startswith("["), F.from_json(t, "array<string>"))
        return F.coalesce(listed, F.concat(F.array(t), F.coalesce(graph, F.array().cast("array<string>"))))
    return F.flatten(F.transform(texts, members))


def product_node(nodes: Column) -> Column:
    """First object whose type is Product."""
    return first(F.filter(nodes, lambda n: F.lower(F.get_json_object(n, _TYPE)).rlike(r'^(product|\[.*"product".*\])$')))


def fields_from_jsonld(p: Column) -> dict[str, Column]:
    """Fields of a product object; offers, image and brand may be an object, a list or a text."""
    def at(path: str) -> Column:
        return F.get_json_object(p, path)

    offers = at("$.offers")
    offer = F.when(offers.startswith("["), at("$.offers[0]")).otherwise(offers)

    def of(path: str) -> Column:
        return F.nullif(F.get_json_object(offer, path), F.lit(""))

    image = at("$.image")
    images = (F.when(image.startswith("["), F.from_json(image, "array<string>"))
              .when(image.startswith("{"), F.array_compact(F.array(at("$.image.url"))))
              .when(image.isNotNull(), F.array(image)))
    brand = at("$.brand")
    stock = of("$.availability")
    return {
        "title": _clean(at("$.name")), "description": _clean(at("$.description")),
        "price": _clean(F.coalesce(of("$.price"), of("$.priceSpecification.price"))),
        "currency": _clean(F.coalesce(of("$.priceCurrency"), of("$.priceSpecification.priceCurrency"))),
        "availability": _clean(F.when(stock.startswith("["), F.get_json_object(stock, "$[0]")).otherwise(stock)),
        "offer_url": _clean(of("$.url")), "images": images,
        "brand": _clean(F.when(brand.startswith("{"), at("$.brand.name")).otherwise(brand)),
        "sku": _clean(F.coalesce(F.nullif(at("$.sku"), F.lit("")), at("$.mpn")))}


def products_from_jsonld(df: DataFrame, json: str = "jsonld") -> DataFrame:
    """Product columns from a column with one product object per row."""
    return df.withColumns(fields_from_jsonld(F.col(json)))


def _meta(*keys: str) -> Column:
    """Content of the first filled meta tag, keys tried in order, by property then by name."""
    return F.coalesce(*[_meta_one(a, k) for k in keys for a in ("property", "name")])


def _meta_one(attribute: str, key: str) -> Column:
    hit = first(F.filter("metas", lambda m: attr(m, attribute) == key))
    return F.nullif(F.trim(attr(hit, "content")), F.lit(""))


def _prop(name: str, *sources: str) -> Column:
    """Value of the first element with an item property or data attribute."""
    hit = first(F.filter("els", lambda e: (attr(e, "itemprop") == name) | has_attr(e, f"data-{name}")))
    tries = [F.nullif(attr(hit, s), F.lit("")) for s in sources] + [F.nullif(subtext(F.col("nodes"), hit, " "), F.lit(""))]
    return _clean(F.coalesce(*tries))


def fields_from_page() -> dict[str, Column]:
    """Fallback fields of a page from meta tags, item properties, heading and title."""
    heading = _clean(subtext(F.col("nodes"), first(tagged(F.col("heads"), "h1")), " "))
    title = _clean(subtext(F.col("nodes"), first(tagged(F.col("nodes"), "title")), " "))
    item_image = first(F.filter("els", lambda e: attr(e, "itemprop") == "image"))
    image = F.coalesce(_meta("og:image", "twitter:image"), F.nullif(attr(item_image, "src"), F.lit("")))
    return {
        "title": F.coalesce(_meta("og:title", "twitter:title", "title"), heading, title),
        "description": F.coalesce(_meta("og:description", "description"), _prop("description")),
        "price": F.coalesce(_meta("product:price:amount", "og:price:amount", "product:price"), _prop("price", "content")),
        "currency": F.coalesce(_meta("product:price:currency", "og:price:currency"), _prop("priceCurrency", "content")),
        "images": F.array_compact(F.array(image)), "sku": _prop("sku", "content", "data-sku"),
        "brand": _prop("brand", "content", "data-brand")}


def products_from_meta(parts: DataFrame) -> DataFrame:
    """Fallback fields of page parts (see ``page_features.page_parts``)."""
    return parts.select("page_id", "url", *[c.alias(n) for n, c in fields_from_page().items()])


def product_sections(nodes: str = "nodes", heads: str = "heads") -> Column:
    """Texts under description and specification headings, by lower-case heading."""
    # Heading words.
    wanted = r"(desc|détail|detail|en savoir plus|fiche technique|specification|spécification)"
    h = F.col(heads)
    named = F.filter(F.transform(h, lambda e: F.struct(
        e["end"].alias("end"), F.lower(subtext(F.col(nodes), e, " ")).alias("name"))), lambda x: x["name"].rlike(wanted))

    def body(x: Column) -> Column:
        later = F.filter(h, lambda e: e["seq"] > x["end"])
        stop = F.coalesce(F.array_min(F.transform(later, lambda e: e["seq"])), F.size(nodes))
        span = F.slice(F.col(nodes), x["end"] + 2, stop - x["end"] - 1)
        texts = F.filter(span, lambda n: (n["tag"] == "#text") & ~F.coalesce(F.get(F.col(nodes), n["parent"])["tag"].rlike(r"(script|style)$"), F.lit(False)))
        return F.array_join(F.transform(texts, lambda n: n["text"]), " ")

    names = F.array_distinct(F.transform(named, lambda x: x["name"]))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(
        k.alias("key"), bind_once(first(F.filter(named, lambda x: x["name"] == k)), body).alias("value"))))


def extract_products(parts: DataFrame) -> DataFrame:
    """Product row of each page: JSON-LD first, then page fallbacks, then texts."""
    p = parts.withColumn("_p", product_node(json_ld_nodes(json_ld_texts())))
    ld = fields_from_jsonld(F.col("_p"))
    page = fields_from_page()

    def both(name: str) -> Column:
        return F.coalesce(ld[name], page[name]) if name in page else ld[name]

    images = F.when(F.size(F.coalesce(ld["images"], F.array().cast("array<string>"))) > 0, ld["images"]).otherwise(page["images"])
    return p.select(
        "page_id", "url", both("title").alias("title"), both("description").alias("description"),
        F.coalesce(both("price"), price_from_text("visible_text")).alias("price"),
        F.coalesce(both("currency"), F.lit("TND")).alias("currency"),
        F.coalesce(availability_from_schema(ld["availability"]), availability_from_text("visible_text")).alias("availability"),
        F.transform(images, lambda i: F.coalesce(resolve_url(i, BASE), i)).alias("images"),
        both("brand").alias("brand"), both("sku").alias("sku"), product_sections().alias("details"))


def product_links(texts: Column | str) -> Column:
    """Product URLs of a page's JSON-LD: the items of the first list, else the products' own URLs."""
    def items(o: Column) -> Column:
        raw = F.from_json(F.get_json_object(o, "$.itemListElement"), "array<string>")
        return F.array_compact(F.transform(raw, lambda e: F.coalesce(
            F.nullif(F.get_json_object(e, "$.url"), F.lit("")), F.get_json_object(e, "$.item.url"))))

    def links(objs: Column) -> Column:
        lists = F.filter(objs, lambda o: F.get_json_object(o, _TYPE) == "ItemList")
        filled = F.filter(F.transform(lists, items), lambda x: F.size(x) > 0)
        own = F.array_compact(F.transform(F.filter(objs, lambda o: F.get_json_object(o, _TYPE) == "Product"), lambda o: F.coalesce(
            F.nullif(F.get_json_object(o, "$.url"), F.lit("")), F.get_json_object(o, "$.offers.url"))))
        return F.coalesce(first(filled), own)

    return bind_once(json_ld_nodes(as_col(texts)), links)
