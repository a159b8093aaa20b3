"""Audit features of a page: array expressions over its nodes, one row per page, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import fixed
from ..functions.text import occurrences, word_count
from ..functions.urls import BASE, base_parts, resolve_url, url_friendliness, url_host, url_part
from ..operators.text import CTA_PHRASES, bind_once, date_markers, top_counts, words
from ..sources.html import (attr, elements, first, has_attr, inside, subtext, tagged, visible_text, with_nodes)

# Word lists and limits of the page checks.
POWER_WORDS = ["ultimate", "proven", "best", "top", "essential", "secret", "exclusive", "easy", "quick", "simple",
               "step-by-step", "definitive", "complete", "powerful", "effective", "free", "instant", "guaranteed",
               "new", "now", "today"]
GENERIC_ANCHORS = ["click here", "read more", "learn more", "more", "here", "this link", "link", "see more", "details",
                   "view more", "check this", "visit"]
DEPRECATED_TAGS = ["applet", "acronym", "bgsound", "dir", "frame", "frameset", "noframes", "isindex", "listing", "xmp",
                   "nextid", "plaintext", "rb", "rtc", "strike", "basefont", "big", "blink", "center", "font", "marquee",
                   "multicol", "nobr", "spacer", "tt"]
SHARE_PARTS = ["facebook.com/sharer", "twitter.com/intent", "linkedin.com/share", "wa.me/", "api.whatsapp.com", "t.me/share"]
# Letters by width in pixels; every other letter is 9 wide.
LETTER_WIDTHS = {3: " ", 4: "il", 5: "j", 6: "tfrI", 7: "J1szace", 8: "oukvxy", 10: "BCDGHKNOPQRUVXY", 12: "MW"}
ANALYTICS = {
    "ga_object": r"window\.ga\s*=\s*window\.ga\s*\|\|\s*function\(\)",
    "ga_create": r"ga\s*\(\s*['\"]create['\"]\s*,",
    "gtag_config": r"gtag\s*\(\s*['\"]config['\"]\s*,\s*['\"](G|UA|AW)-",
    "gtag_js": r"https://www.googletagmanager.com/gtag/js\?id=(G|UA|AW)-",
}
MIXED_ATTRS = {"img": "src", "script": "src", "link": "href", "iframe": "src", "video": "src", "audio": "src", "source": "src"}


def page_parts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", closed_only: bool = False) -> DataFrame:
    """Page rows with nodes, visible text and the element groups the features read."""
    base = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    n = with_nodes(base, closed_only=closed_only)
    return n.select(
        "page_id", "url", "html", "nodes", base_parts("url").alias("base"), visible_text(F.col("nodes")).alias("visible_text"),
        elements(F.col("nodes")).alias("els"), tagged(F.col("nodes"), "meta").alias("metas"),
        tagged(F.col("nodes"), "link").alias("links"), tagged(F.col("nodes"), "a").alias("anchors"),
        tagged(F.col("nodes"), "img").alias("imgs"),
        tagged(F.col("nodes"), "h1", "h2", "h3", "h4", "h5", "h6").alias("heads"))


def count_tag(*tags: str) -> Column:
    return F.size(tagged(F.col("els"), *tags))


def pixel_width(c: Column) -> Column:
    """Estimated width of a text in a result list."""
    width = F.length(c) * 9
    for w, letters in LETTER_WIDTHS.items():
        width = width + F.regexp_count(c, F.lit(f"[{letters}]")) * (w - 9)
    return width


def _contains(c: Column, keyword: str | None) -> Column:
    return F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False)) if keyword else F.lit(False)


def _any_of(c: Column, parts: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(low, p))


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def meta_content(*names: str, attribute: str = "name", pattern: bool = False) -> Column:
    """Content of the first meta tag with one of the names."""
    def test(m: Column) -> Column:
        v = attr(m, attribute)
        return v.rlike(names[0]) if pattern else v.isin(*names)
    return attr(first(F.filter("metas", test)), "content")


def rel_has(link: Column, value: str) -> Column:
    return F.array_contains(F.split(F.lower(F.coalesce(attr(link, "rel"), F.lit(""))), r"\s+"), value)


def title_features(keyword: str | None = None, least: int = 20, most: int = 70) -> dict[str, Column]:
    titles = tagged(F.col("nodes"), "title")
    text = _blank_to_null(subtext(F.col("nodes"), first(titles)))
    has = text.isNotNull()
    n = F.coalesce(F.length(text), F.lit(0))
    pixels = F.coalesce(pixel_width(text), F.lit(0))
    twice = F.filter(top_counts(F.filter(words(F.coalesce(text, F.lit(""))), lambda w: F.length(w) > 2)),
                     lambda t: t["neg"] < -1)
    at = F.locate(keyword.lower(), F.lower(text)) if keyword else F.lit(0)
    return {
        "title": text, "title_length": n, "title_pixels": pixels, "title_within_pixels": has & (pixels <= 600),
        "title_good_length": has & n.between(least, most), "title_duplicate_words": F.size(twice),
        "title_tags": F.size(titles),
        "title_has_brand": F.coalesce(text.contains("|") | text.contains(" - "), F.lit(False)),
        "title_power_words": _any_of(text, POWER_WORDS), "title_has_keyword": _contains(text, keyword),
        "title_keyword_near_start": F.coalesce((at > 0) & (at <= 21), F.lit(False))}


def meta_description_features(keyword: str | None = None, least: int = 70, most: int = 160) -> dict[str, Column]:
    found = F.filter("metas", lambda m: attr(m, "name").rlike("(?i)^description$"))
    text = _blank_to_null(attr(first(found), "content"))
    has = text.isNotNull()
    n = F.coalesce(F.length(text), F.lit(0))
    pixels = F.coalesce(pixel_width(text), F.lit(0))
    return {
        "meta_description": text, "description_length": n, "description_good_length": has & n.between(least, most),
        "description_pixels": pixels, "description_within_pixels": has & (pixels <= 680),
        "description_tags": F.size(found), "description_has_cta": _any_of(text, CTA_PHRASES),
        "description_has_keyword": _contains(text, keyword)}


def heading_features(keyword: str | None = None) -> dict[str, Column]:
    def texts(level: int) -> Column:
        return F.transform(tagged(F.col("heads"), f"h{level}"), lambda h: subtext(F.col("nodes"), h))
    levels = F.array_sort(F.array_distinct(F.transform("heads", lambda h: F.substring(h["tag"], 2, 1).cast("int"))))
    steps = bind_once(levels, lambda s: F.forall(F.transform(s, lambda x, i: x - F.coalesce(F.get(s, i - 1), x - 1)),
                                                 lambda gap: gap <= 1))
    out = {f"h{i}_count": F.size(tagged(F.col("heads"), f"h{i}")) for i in range(1, 7)}
    h1 = texts(1)
    sub = F.flatten(F.array(*[texts(i) for i in range(2, 7)]))
    kw = (keyword or "").lower()
    return {
        "h1": h1, **out, "single_h1": out["h1_count"] == 1,
        "h1_has_keyword": F.exists(h1, lambda t: F.contains(F.lower(t), F.lit(kw))) if keyword else F.lit(False),
        "subheading_keyword_hits": F.size(F.filter(sub, lambda t: F.contains(F.lower(t), F.lit(kw)))) if keyword else F.lit(0),
        "heading_hierarchy_valid": steps}


def image_features(keyword: str | None = None) -> dict[str, Column]:
    def src(i: Column) -> Column:
        return F.coalesce(attr(i, "src"), F.lit(""))

    def inline(i: Column) -> Column:
        return src(i).startswith("data:") | src(i).startswith("blob:")

    def no_alt(i: Column) -> Column:
        return (F.trim(F.coalesce(attr(i, "alt"), F.lit(""))) == "") & ~inline(i)

    def fixed_size(i: Column) -> Column:
        style = F.lower(F.coalesce(attr(i, "style"), F.lit("")))
        return ~(has_attr(i, "srcset") | inside(i, ["picture"])) & ~style.rlike("max-width|width: 100%|height: auto")

    def poor_name(i: Column) -> Column:
        name = F.regexp_replace(F.element_at(F.split(src(i), "/"), -1), r"\?.*$", "")
        base = F.lower(F.regexp_replace(name, r"\.[a-zA-Z0-9]+$", ""))
        return (src(i) != "") & ~inline(i) & (base.rlike(r"^(img|image|photo|pic|dsc)[-_]?\d{2,}$") | (F.length(base) <= 3))

    return {
        "images": F.size("imgs"), "images_without_alt": F.size(F.filter("imgs", no_alt)),
        "images_not_responsive": F.size(F.filter("imgs", fixed_size)),
        "images_with_keyword_alt": F.size(F.filter("imgs", lambda i: _contains(attr(i, "alt"), keyword))),
        "image_poor_names": F.transform(F.filter("imgs", poor_name), src)}


def _links() -> Column:
    """Anchors that lead somewhere, with absolute URL, text and rel words."""
    used = F.filter("anchors", lambda a: (F.coalesce(attr(a, "href"), F.lit("")) != "")
                    & ~attr(a, "href").rlike("^(#|mailto:|tel:|javascript:)"))
    host = F.lower(F.col("base.authority"))
    return F.transform(used, lambda a: bind_once(resolve_url(attr(a, "href"), BASE, keep_fragment=True), lambda u: F.struct(
        u.alias("u"), (F.lower(url_part(u, "authority")) == host).alias("internal"),
        subtext(F.col("nodes"), a).alias("text"), F.split(F.coalesce(attr(a, "rel"), F.lit("")), r"\s+").alias("rel"),
        attr(a, "target").alias("target"))))


def link_features(least: int = 5) -> dict[str, Column]:
    """Reads column ``page_links`` (see :func:`with_links`)."""
    ls = F.col("page_links")

    def distinct(test) -> Column:
        return F.array_distinct(F.transform(F.filter(ls, test), lambda x: x["u"]))

    internal, external = distinct(lambda x: x["internal"]), distinct(lambda x: ~x["internal"])
    named = F.filter(ls, lambda x: x["text"] != "")
    generic = F.size(F.filter(named, lambda x: F.lower(x["text"]).isin(GENERIC_ANCHORS)))
    share = F.coalesce(F.try_divide(generic.cast("double"), F.size(named)), F.lit(0.0))
    length = F.aggregate(named, F.lit(0), lambda s, x: s + F.length(x["text"]))
    unsafe = F.filter(ls, lambda x: ~x["internal"] & (x["target"] == "_blank")
                      & ~F.arrays_overlap(x["rel"], F.array(F.lit("noopener"), F.lit("noreferrer"))))
    return {
        "internal_links": internal, "external_links": external,
        "internal_link_count": F.size(internal), "external_link_count": F.size(external),
        "enough_links": F.size(internal) + F.size(external) >= least,
        "internal_nofollow_count": F.size(distinct(lambda x: x["internal"] & F.array_contains(x["rel"], "nofollow"))),
        "anchor_mean_length": fixed(F.coalesce(F.try_divide(length.cast("double"), F.size(named)), F.lit(0.0)), 2),
        "generic_anchors": generic, "generic_anchor_ratio": fixed(share, 3),
        "unsafe_cross_origin_links": F.size(unsafe)}


def with_links(parts: DataFrame) -> DataFrame:
    return parts.withColumn("page_links", _links())


def content_stats(least: int = 300) -> dict[str, Column]:
    n = word_count("visible_text")
    return {"word_count": n, "enough_words": n >= least, "paragraphs": count_tag("p"),
            "lorem_ipsum": F.lower("visible_text").contains("lorem ipsum")}


def element_counts() -> dict[str, Column]:
    return {
        "iframes": count_tag("iframe"),
        "script_files": F.size(F.filter("els", lambda e: (e["tag"] == "script") & has_attr(e, "src"))),
        "style_files": F.size(F.filter("links", lambda e: rel_has(e, "stylesheet") & has_attr(e, "href"))),
        "strong_tags": count_tag("strong", "b"),
        "inline_styles": F.size(F.filter("els", lambda e: has_attr(e, "style"))),
        "forms": count_tag("form"),
        "form_fields": F.size(F.filter("els", lambda e: e["tag"].isin("input", "select", "textarea") & inside(e, ["form"]))),
        "bullet_lists": count_tag("ul"), "number_lists": count_tag("ol"), "dom_size": F.size("els")}


def tag_map(attribute: str, prefix: str) -> Column:
    """Meta tags of one namespace as a map; the first of a name wins."""
    kept = F.filter("metas", lambda m: attr(m, attribute).rlike(f"(?i)^{prefix}")
                    & (F.coalesce(attr(m, "content"), F.lit("")) != ""))
    pairs = F.transform(kept, lambda m: F.struct(attr(m, attribute).alias("key"), attr(m, "content").alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(names, lambda k: first(F.filter(pairs, lambda p: p["key"] == k))))


def icon_url(value: str) -> Column:
    found = F.filter("links", lambda e: F.lower(F.coalesce(attr(e, "rel"), F.lit(""))).contains(value) & has_attr(e, "href"))
    return resolve_url(attr(first(found), "href"), BASE)


def social_meta() -> dict[str, Column]:
    og, tw = tag_map("property", "og:"), tag_map("name", "twitter:")
    default = F.filter("links", lambda e: attr(e, "href") == "/favicon.ico")
    icon = F.coalesce(icon_url("icon"), resolve_url(attr(first(default), "href"), BASE))
    return {"open_graph": og, "has_open_graph": F.size(og) > 0, "twitter_card": tw, "has_twitter_card": F.size(tw) > 0,
            "product_meta": tag_map("property", "product:"), "apple_touch_icon": icon_url("apple-touch-icon"),
            "favicon": icon, "has_favicon": icon.isNotNull()}


def legacy_html() -> dict[str, Column]:
    old = F.filter("els", lambda e: e["tag"].isin(DEPRECATED_TAGS))
    counts = top_counts(F.transform(old, lambda e: e["tag"]))
    flash = F.exists("els", lambda e: (
        e["tag"].isin("object", "embed") & F.coalesce(attr(e, "type").rlike("(?i)application/x-shockwave-flash"), F.lit(False)))
        | ((e["tag"] == "object") & F.coalesce(attr(e, "classid").rlike("(?i)clsid:D27CDB6E-AE6D-11cf-96B8-444553540000"), F.lit(False))))
    return {
        "deprecated_tags": F.map_from_entries(F.transform(counts, lambda t: F.struct(t["token"], (-t["neg"]).alias("n")))),
        "has_deprecated": F.size(old) > 0, "has_flash": flash,
        "has_nested_tables": F.exists("els", lambda e: (e["tag"] == "table") & inside(e, ["table"])),
        "has_frameset": count_tag("frameset", "frame") > 0}


def page_signals() -> dict[str, Column]:
    def cls(e: Column) -> Column:
        return F.lower(F.coalesce(attr(e, "class"), F.lit("")))

    def stamp(tag: str, attribute: str, pattern: str, value: str) -> Column:
        hit = F.filter("els", lambda e: (e["tag"] == tag) & F.coalesce(attr(e, attribute).rlike(pattern), F.lit(False)))
        vals = F.transform(hit, lambda e: F.coalesce(F.nullif(attr(e, value), F.lit("")), _blank_to_null(subtext(F.col("nodes"), e))))
        return first(F.array_compact(vals))

    return {
        "has_breadcrumbs": F.exists("els", lambda e: cls(e).contains("breadcrumb") | F.coalesce(
            attr(e, "itemtype").rlike("(?i)schema.org/BreadcrumbList"), F.lit(False))),
        "has_share_buttons": F.exists("anchors", lambda a: _any_of(attr(a, "href"), SHARE_PARTS))
        | F.exists("els", lambda e: cls(e).contains("share")),
        "published_date": F.coalesce(stamp("meta", "property", "^article:published_time$", "content"),
                                     stamp("time", "itemprop", "(?i)datePublished|dateCreated", "datetime")),
        "modified_date": F.coalesce(stamp("meta", "property", "^article:modified_time$", "content"),
                                    stamp("time", "itemprop", "(?i)dateModified", "datetime")),
        "time_markers": F.size(tagged(F.col("els"), "time"))
        + F.size(F.filter("metas", lambda m: F.coalesce(attr(m, "property").rlike("(?i)article:"), F.lit(False))
                          & (F.coalesce(attr(m, "content"), F.lit("")) != "")))
        + date_markers(F.array_join(F.transform(tagged(F.col("nodes"), "#text"), lambda t: t["text"]), " "))}


def doc_basics() -> dict[str, Column]:
    charset = attr(first(F.filter("metas", lambda m: has_attr(m, "charset"))), "charset")
    old = attr(first(F.filter("metas", lambda m: F.coalesce(attr(m, "http-equiv").rlike("(?i)content-type"), F.lit(False)))), "content")
    page = first(tagged(F.col("nodes"), "html"))
    amp = first(F.filter("links", lambda e: rel_has(e, "amphtml") & has_attr(e, "href")))
    value = F.coalesce(charset, F.trim(F.nullif(F.regexp_extract(old, r"(?i)charset=(.*)$", 1), F.lit(""))))
    return {
        "has_doctype": F.exists("nodes", lambda n: (n["tag"] == "#doctype") & (n["depth"] == 0)),
        "charset": value, "has_charset": value.isNotNull(),
        "viewport": meta_content("viewport"),
        "has_viewport": F.exists("metas", lambda m: attr(m, "name") == "viewport"),
        "is_amp": F.coalesce(amp.isNotNull() | has_attr(page, "amp") | has_attr(page, "⚡"), F.lit(False))}


def index_directives() -> dict[str, Column]:
    alternates = F.filter("links", lambda e: rel_has(e, "alternate") & has_attr(e, "hreflang") & has_attr(e, "href"))
    canonical = first(F.filter("links", lambda e: rel_has(e, "canonical") & has_attr(e, "href")))
    robots = F.lower(meta_content("(?i)robots", pattern=True))
    return {
        "language": F.lower(F.nullif(attr(first(tagged(F.col("nodes"), "html")), "lang"), F.lit(""))),
        "hreflang": F.transform(alternates, lambda e: F.struct(
            attr(e, "hreflang").alias("lang_code"), resolve_url(attr(e, "href"), BASE).alias("url"))),
        "canonical_url": resolve_url(attr(canonical, "href"), BASE), "has_canonical": canonical.isNotNull(),
        "meta_robots": robots, "has_noindex": F.coalesce(robots.contains("noindex"), F.lit(False)),
        "has_nofollow": F.coalesce(robots.contains("nofollow"), F.lit(False))}


def json_ld_texts() -> Column:
    """Texts of JSON-LD scripts that parse."""
    scripts = F.filter("els", lambda e: (e["tag"] == "script") & (attr(e, "type") == "application/ld+json"))
    return F.filter(F.transform(scripts, lambda e: subtext(F.col("nodes"), e)), lambda t: F.try_parse_json(t).isNotNull())


def microdata() -> Column:
    """Top-level items with their own properties.

    Every node knows its nearest item, so an item reads its own nodes once, and top-level
    items don't overlap: the work is linear in the page however items are nested.
    """
    scopes = F.filter("els", lambda e: has_attr(e, "itemscope"))

    def value(p: Column) -> Column:
        text = subtext(F.col("nodes"), p)
        return (F.when(has_attr(p, "itemscope"), F.coalesce(attr(p, "itemtype"), F.lit("UnknownNestedType")))
                .when(p["tag"] == "meta", attr(p, "content")).when(p["tag"].isin("a", "link"), attr(p, "href"))
                .when(p["tag"].isin("img", "audio", "video", "embed", "iframe", "source", "track"), attr(p, "src"))
                .when(p["tag"] == "time", F.coalesce(F.nullif(attr(p, "datetime"), F.lit("")), text))
                .when(p["tag"] == "data", F.coalesce(F.nullif(attr(p, "value"), F.lit("")), text))
                .when(p["tag"] == "object", attr(p, "data")).otherwise(text))

    def properties(item: Column) -> Column:
        inner = F.slice(F.col("nodes"), item["seq"] + 2, item["end"] - item["seq"])
        own = F.filter(inner, lambda p: (p["scope"] == item["seq"]) & has_attr(p, "itemprop"))
        pairs = F.transform(own, lambda p: F.struct(attr(p, "itemprop").alias("name"), value(p).alias("value")))
        return F.filter(pairs, lambda x: (x["name"] != "") & x["value"].isNotNull())

    top = F.filter(scopes, lambda e: e["scope"] < 0)
    items = F.transform(top, lambda e: F.struct(
        F.coalesce(attr(e, "itemtype"), F.lit("UnknownType")).alias("type"), properties(e).alias("properties")))
    return F.filter(items, lambda i: F.size(i["properties"]) > 0)


def structured_data() -> dict[str, Column]:
    ld, md = json_ld_texts(), microdata()
    typed = F.exists("els", lambda e: F.lower(F.coalesce(attr(e, "itemtype"), F.lit(""))).contains("schema.org"))
    return {"json_ld": ld, "has_json_ld": F.size(ld) > 0, "microdata": md, "has_microdata": F.size(md) > 0,
            "has_schema": typed | (F.size(ld) > 0)}


def tag_scan() -> dict[str, Column]:
    hits = {n: F.col("html").rlike(p) for n, p in ANALYTICS.items()}
    any_hit = F.lit(False)
    for c in hits.values():
        any_hit = any_hit | c
    found = F.regexp_extract_all("html", F.lit(r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"), 1)
    mails = F.array_distinct(F.filter(
        F.when(F.col("html").contains("@"), found).otherwise(F.array().cast("array<string>")),
        lambda m: ~F.lower(m).rlike(r"\.(png|jpg|gif|svg|css|js)")))
    refresh = first(F.filter("metas", lambda m: F.coalesce(attr(m, "http-equiv").rlike("(?i)refresh"), F.lit(False))))

    def modern(kind: str) -> Column:
        return (F.exists("els", lambda e: (e["tag"] == "source") & inside(e, ["picture"]) & (attr(e, "type") == f"image/{kind}"))
                | F.exists("imgs", lambda i: F.lower(F.coalesce(attr(i, "src"), F.lit(""))).contains(f".{kind}")))

    return {**hits, "has_analytics": any_hit, "plain_emails": F.array_sort(mails), "has_plain_emails": F.size(mails) > 0,
            "has_meta_refresh": refresh.isNotNull(), "uses_webp": F.coalesce(modern("webp"), F.lit(False)),
            "uses_avif": F.coalesce(modern("avif"), F.lit(False))}


def mobile_features() -> dict[str, Column]:
    wide = F.exists("els", lambda e: e["tag"].isin("body", "div", "main", "article", "section", "table") & F.coalesce(
        F.regexp_extract(attr(e, "style"), r"width\s*:\s*(\d{3,})px", 1).try_cast("bigint") > 380, F.lit(False)))
    viewport = F.exists("metas", lambda m: attr(m, "name") == "viewport")
    return {"has_fixed_width": wide, "is_mobile_friendly": viewport & ~wide,
            "has_media_queries": F.exists("nodes", lambda n: (n["tag"] == "#text") & inside(n, ["style"]) & n["text"].contains("@media"))}


def mixed_content() -> dict[str, Column]:
    def bad(e: Column) -> Column:
        test = F.lit(False)
        for tag, attribute in MIXED_ATTRS.items():
            test = test | ((e["tag"] == tag) & F.coalesce(attr(e, attribute).rlike("(?i)^http://"), F.lit(False)))
        return test
    items = F.filter("els", bad)
    https = F.lower(url_part("url", "scheme")) == "https"
    return {"is_https": https, "mixed_items": F.when(https, F.size(items)).otherwise(0),
            "has_mixed_content": https & (F.size(items) > 0)}


def structure_features() -> dict[str, Column]:
    sizes = F.transform(tagged(F.col("els"), "p"), lambda p: F.size(F.filter(
        F.split(subtext(F.col("nodes"), p), r"(?U)\s+"), lambda w: w != "")))
    total = F.aggregate(sizes, F.lit(0), lambda s, x: s + x)
    return {"avg_paragraph_words": fixed(F.coalesce(F.try_divide(total.cast("double"), F.size(sizes)), F.lit(0.0)), 2),
            "first_paragraph": subtext(F.col("nodes"), first(tagged(F.col("els"), "p")))}


def keyword_features(keyword: str) -> dict[str, Column]:
    return {"keyword_occurrences": occurrences("visible_text", keyword)}


def pick(parts: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """Page id, URL and the features of the given groups."""
    cols = {n: c for g in groups for n, c in g.items()}
    return parts.select("page_id", "url", *[c.alias(n) for n, c in cols.items()])


def audit_features(pages: DataFrame, keyword: str | None = None, **names) -> DataFrame:
    """All page features as one wide row per page; ``names``: see :func:`page_parts`."""
    parts = with_links(page_parts(pages, **names))
    url = url_friendliness("url")
    wide = pick(parts, title_features(keyword), meta_description_features(keyword), heading_features(keyword),
                image_features(keyword), link_features(), content_stats(), element_counts(), social_meta(), legacy_html(),
                page_signals(), doc_basics(), index_directives(), structured_data(), tag_scan(), mobile_features(),
                mixed_content(), structure_features(),
                {"is_seo_friendly_url": url["is_seo_friendly_url"], "visible_text": F.col("visible_text"),
                 "html_size": F.length("html"), "host": url_host("url")})
    return wide


