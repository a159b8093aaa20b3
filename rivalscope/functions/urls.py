"""URL parts, canonical form, ids, resolution and URL-based features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import as_col

_SHAPE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(c: Column | str, part: str) -> Column:
    """scheme, authority, path or query of an absolute URL ('' when absent)."""
    index = {"scheme": 1, "authority": 2, "path": 3, "query": 4}[part]
    return F.regexp_extract(F.trim(as_col(c)), _SHAPE, index)


def url_host(c: Column | str) -> Column:
    """Lower-case host without user info and port; NULL when there is none."""
    authority = F.regexp_replace(url_part(c, "authority"), r"^.*@", "")
    return F.nullif(F.lower(F.regexp_replace(authority, r":\d*$", "")), F.lit(""))


def unquote(c: Column | str) -> Column:
    """Percent-decoding in which a plus sign stays a plus sign."""
    text = as_col(c)
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _requote(c: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(c), c)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_query(query: Column) -> Column:
    """Query pairs sorted by key and value, blank values kept."""
    parts = F.filter(F.split(query, "&"), lambda s: s != "")
    pairs = F.array_sort(F.transform(parts, lambda s: F.struct(
        _requote(F.regexp_extract(s, r"^([^=]*)", 1)).alias("k"),
        _requote(F.regexp_extract(s, r"^[^=]*=(.*)$", 1)).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def canonical_url(c: Column | str) -> Column:
    """One spelling per resource; NULL when scheme or host is missing."""
    scheme = F.lower(url_part(c, "scheme"))
    port = F.regexp_extract(url_part(c, "authority"), r":(\d+)$", 1)
    path = url_part(c, "path")
    query = canonical_query(url_part(c, "query"))
    keep_port = ((port != "") & ~((scheme == "http") & (port == "80"))
                 & ~((scheme == "https") & (port == "443")))
    return F.when(
        (scheme != "") & url_host(c).isNotNull(),
        F.concat(scheme, F.lit("://"), url_host(c),
                 F.when(keep_port, F.concat(F.lit(":"), port)).otherwise(""),
                 F.when(path == "", "/").otherwise(path),
                 F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def url_id(c: Column | str) -> Column:
    """SHA-1 of the canonical URL."""
    return F.sha1(canonical_url(c))


def url_hash(c: Column | str) -> Column:
    """SHA-256 of the URL as given."""
    return F.sha2(as_col(c), 256)


def normalize_domain(c: Column | str) -> Column:
    """Domain without scheme, www. and trailing slashes."""
    d = F.lower(F.trim(as_col(c)))
    d = F.regexp_replace(d, r"^https?://", "")
    d = F.regexp_replace(d, r"^www\.", "")
    return F.regexp_replace(d, r"/+$", "")


def _squash(path: Column) -> Column:
    """Path with '.' and '..' segments applied."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.array_append(acc, s)))
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), tail)


def base_parts(base: Column | str) -> Column:
    """What link resolution needs of a base URL, as one struct."""
    b = as_col(base)
    path = F.when(url_part(b, "path") == "", "/").otherwise(url_part(b, "path"))
    bare = F.regexp_replace(b, r"#.*$", "")
    return F.struct(url_part(b, "scheme").alias("scheme"), url_part(b, "authority").alias("authority"),
                    F.regexp_replace(path, r"[^/]*$", "").alias("folder"), bare.alias("bare"))


def resolve_url(href: Column | str, base: Column | str, keep_fragment: bool = False) -> Column:
    """Absolute form of a link; NULL for empty, '#' and javascript links.

    ``base`` is a URL or a :func:`base_parts` struct column named ``base``.
    """
    parts = base_parts(base) if base is not BASE else F.col("base")
    plain = _resolved(as_col(href), parts)
    if not keep_fragment:
        return plain
    return F.concat(plain, F.regexp_extract(as_col(href), r"(#.*)$", 1))


#: Marks that the base parts are already in column ``base``.
BASE = object()


def _resolved(href: Column, b: Column) -> Column:
    h = F.trim(href)
    bare = F.when(h.contains("#"), F.regexp_replace(h, r"#.*$", "")).otherwise(h)
    path = F.when(bare.contains("?"), F.regexp_replace(bare, r"\?.*$", "")).otherwise(bare)
    query = F.when(bare.contains("?"), F.regexp_extract(bare, r"(\?.*)$", 1)).otherwise("")
    root = F.concat(b["scheme"], F.lit("://"), b["authority"])

    def tidy(p: Column) -> Column:
        return F.when(p.contains("/."), _squash(p)).otherwise(p)

    return (F.when(h.isNull() | (h == "") | (h == "#") | h.startswith("javascript:"), F.lit(None).cast("string"))
            .when(bare.startswith("//"), F.concat(b["scheme"], F.lit(":"), bare))
            .when(bare.startswith("/"), F.concat(root, tidy(path), query))
            .when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), bare)
            .when(bare == "", b["bare"])
            .when(bare.startswith("?"), F.concat(F.regexp_replace(b["bare"], r"\?.*$", ""), bare))
            .otherwise(F.concat(root, tidy(F.concat(b["folder"], path)), query)))


def resource_type(url: Column | str, content_type: Column | str) -> Column:
    """javascript, css, image, font or other, from the suffix, else from the content type."""
    u, t = F.lower(as_col(url)), F.lower(F.coalesce(as_col(content_type), F.lit("")))
    # Suffixes and content types.
    return (F.when(u.rlike(r"\.(js|mjs)$"), "javascript")
            .when(u.rlike(r"\.css$"), "css")
            .when(u.rlike(r"\.(jpg|jpeg|png|gif|webp|svg)$"), "image")
            .when(u.rlike(r"\.(woff|woff2|ttf|eot)$"), "font")
            .when(t.contains("javascript"), "javascript")
            .when(t.contains("css"), "css")
            .when(t.contains("image"), "image")
            .when(t.contains("font"), "font")
            .otherwise("other"))


def next_page_url(url: Column | str, pattern: str, number: Column | int) -> Column:
    """URL of another list page: ``pattern`` is a parameter name or ``__path__``."""
    u = as_col(url)
    n = (number if isinstance(number, Column) else F.lit(number)).cast("string")
    head = F.regexp_extract(u, r"^([^?#]*)", 1)
    query = url_part(u, "query")
    fragment = F.regexp_extract(u, r"(#.*)$", 1)
    tail = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    if pattern == "__path__":
        swapped = F.concat(F.regexp_extract(head, r"^(.*/)\d+/?$", 1), n, F.regexp_extract(head, r"(/?)$", 1))
        added = F.concat(F.regexp_replace(head, r"/$", ""), F.lit("/"), n, F.lit("/"))
        return F.concat(F.when(head.rlike(r"/\d+/?$"), swapped).otherwise(added), tail, fragment)
    parts = F.filter(F.split(query, "&"), lambda s: s.rlike(r"^[^=]+=.+"))
    has = F.exists(parts, lambda s: F.startswith(s, F.lit(pattern + "=")))
    pair = F.concat(F.lit(pattern + "="), n)
    replaced = F.transform(parts, lambda s: F.when(F.startswith(s, F.lit(pattern + "=")), pair).otherwise(s))
    return F.concat(head, F.lit("?"),
                    F.array_join(F.when(has, F.array_distinct(replaced)).otherwise(F.array_append(parts, pair)), "&"),
                    fragment)


def pagination_parameter(url: Column | str) -> Column:
    """``page`` or ``p`` when the query has it, else NULL."""
    q = url_part(url, "query")
    return (F.when(q.rlike(r"(^|&)page=[^&]"), "page").when(q.rlike(r"(^|&)p=[^&]"), "p"))


def path_segments(c: Column | str) -> Column:
    return F.filter(F.split(unquote(url_part(c, "path")), "/"), lambda s: s != "")


def url_friendliness(c: Column | str, max_length: int = 100, max_depth: int = 4) -> dict[str, Column]:
    """Length, depth, upper case and file extension checks."""
    u = as_col(c)
    path = unquote(url_part(u, "path"))
    depth = F.size(path_segments(u))
    return {
        "url_length": F.length(u),
        "url_depth": depth,
        "too_long": F.length(u) > max_length,
        "too_deep": depth > max_depth,
        "has_uppercase": path.rlike(r"\p{Lu}"),
        "has_extension": F.lower(path).rlike(r"\.(php|asp|aspx|jsp|html|htm)$") & (depth > 0),
        "is_seo_friendly_url": (F.length(u) <= max_length) & (depth <= max_depth),
    }


def slug_quality(c: Column | str, stopwords: list[str], keyword: str | None = None) -> dict[str, Column]:
    """Last path segment: hyphens, special characters, keyword, stopwords, clean form."""
    segments = path_segments(c)
    slug = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    low = F.lower(slug)
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), 1)
    clean = F.regexp_replace(F.regexp_replace(F.trim(low), r"[^a-z0-9\-]+", "-"), r"-{2,}", "-")
    stop = F.array(*[F.lit(w) for w in stopwords])
    return {
        "slug": slug,
        "slug_has_hyphens": slug.contains("-"),
        "slug_has_special_chars": slug.rlike(r"[^a-zA-Z0-9\-]"),
        "slug_contains_keyword": low.contains(keyword.lower()) if keyword else F.lit(False),
        "slug_stopwords": F.size(F.filter(words, lambda w: F.array_contains(stop, w))),
        "slug_normalized": F.regexp_replace(clean, r"^-+|-+$", ""),
    }


#: Header signs of content delivery networks.
CDN_NAMES = ["Cloudflare", "Akamai", "CloudFront", "Fastly", "Google"]


def lower_keys(headers: Column | str) -> Column:
    """Header map with lower-case keys (last one wins on a clash)."""
    h = as_col(headers)
    entries = F.map_entries(h)
    keys = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(
        k.alias("key"),
        F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"].alias("value"))))


def cdn_flags(headers: Column | str) -> Column:
    """Names of the delivery networks a lower-case header map points to."""
    h = as_col(headers)

    def val(name: str) -> Column:
        return F.coalesce(F.try_element_at(h, F.lit(name)), F.lit(""))

    server = F.lower(val("server"))
    tests = {
        "Cloudflare": F.map_contains_key(h, "cf-ray") | server.contains("cloudflare"),
        "Akamai": F.exists(F.map_keys(h), lambda k: F.startswith(k, F.lit("x-akamai"))) | server.contains("akamaighost"),
        "CloudFront": (val("via").contains("cloudfront") | val("x-amz-cf-id").contains("cloudfront")
                       | server.contains("cloudfront")),
        "Fastly": val("x-served-by").contains("fastly") | server.contains("fastly"),
        "Google": server.contains("gws") | server.contains("google"),
    }
    return F.array_compact(F.array(*[F.when(tests[n], F.lit(n)) for n in CDN_NAMES]))
