"""Audit scores, issue messages, response and asset features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_col, fixed
from ..functions.text import occurrences, text_hash
from ..functions.urls import cdn_flags, lower_keys, url_hash
from ..operators.relational import top_n_per_group
from ..operators.text import keyword_tokens, text_html_ratio, top_counts, with_readability
from .page_features import audit_features

# Rule, most points, weight. A name in PENALTIES loses points.
RULES: dict[str, dict[str, tuple[float, float]]] = {
    "on_page": {
        "title": (10, 1.5), "meta_description": (8, 1.2), "headings": (10, 1.2), "image_alt_text": (7, 1),
        "responsive_image": (5, 0.8), "content_length": (8, 1), "internal_links": (5, 0.7), "broken_links": (10, 1.5),
        "open_graph": (3, 0.7), "twitter_card": (3, 0.7), "seo_friendly_url": (5, 1), "inline_css": (3, 0.5),
        "deprecated_html": (5, 0.8), "flash_content": (5, 1), "frameset": (5, 1), "unsafe_cross_origin_links": (4, 0.8)},
    "technical": {
        "https": (10, 1.5), "canonical_tag": (7, 1.2), "mobile_responsive": (10, 1.5), "structured_data": (8, 1),
        "meta_robots": (5, 1), "http_version": (3, 0.7), "hsts": (4, 0.8), "mixed_content": (8, 1.2),
        "html_page_size": (5, 0.8), "dom_size": (5, 0.8), "html_compression": (4, 1), "page_cache": (5, 0.7),
        "favicon": (2, 0.5), "charset": (2, 0.8), "doctype": (2, 1)},
    "content": {"readability": (10, 1), "keyword_usage": (10, 1.2), "most_common_keywords": (5, 0.8),
                "text_html_ratio": (5, 0.7), "spell_check": (5, 0.8)},
}
PENALTIES = {"broken_links", "inline_css", "deprecated_html", "flash_content", "frameset", "unsafe_cross_origin_links",
             "mixed_content", "spell_check"}
CATEGORY_WEIGHTS = {"on_page": 0.40, "technical": 0.35, "content": 0.25}
# Issue and success message of each rule; braces name a feature column.
MESSAGES: dict[str, tuple[str, str]] = {
    "title": ("Title length suboptimal.", "Title present and well-sized."),
    "meta_description": ("Meta description length suboptimal.", "Meta description present and well-sized."),
    "headings": ("Heading structure (H1/H2) needs improvement.", "Good H1/H2 usage."),
    "image_alt_text": ("{images_without_alt} images missing alt text.", "Good alt text coverage."),
    "responsive_image": ("{images_not_responsive} images may be non-responsive.", "Responsive images in use."),
    "content_length": ("Content length appears thin.", "Content length is sufficient."),
    "internal_links": ("Too few links.", "Healthy link count."),
    "broken_links": ("{broken_links} broken links detected.", "No broken links."),
    "open_graph": ("Open Graph tags missing.", "Open Graph tags present."),
    "twitter_card": ("Twitter card tags missing.", "Twitter card tags present."),
    "seo_friendly_url": ("URL may not be SEO friendly.", "SEO friendly URL."),
    "inline_css": ("Inline CSS detected.", "No inline CSS issues."),
    "deprecated_html": ("Deprecated HTML tags found.", "No deprecated HTML tags."),
    "flash_content": ("Flash content found.", "No Flash content."),
    "frameset": ("Framesets detected.", "No framesets."),
    "unsafe_cross_origin_links": ("Unsafe rel on target=_blank links.", "Cross-origin links use rel noopener."),
    "https": ("HTTPS not detected.", "HTTPS detected."),
    "canonical_tag": ("Canonical tag missing.", "Canonical tag present."),
    "mobile_responsive": ("Mobile-friendliness issues detected.", "Mobile responsive layout."),
    "structured_data": ("No structured data detected.", "Structured data detected."),
    "meta_robots": ("Meta robots missing.", "Meta robots tag present."),
    "http_version": ("Not using HTTP/2.", "Uses HTTP/2."),
    "hsts": ("HSTS header missing.", "HSTS header present."),
    "mixed_content": ("Mixed content found.", "No mixed content."),
    "html_page_size": ("HTML page size is large ({html_kb}KB).", "HTML page size is good ({html_kb}KB)."),
    "dom_size": ("DOM size is large ({dom_size} elements).", "DOM size is good ({dom_size} elements)."),
    "html_compression": ("HTML compression not detected.", "HTML compression enabled."),
    "page_cache": ("No caching headers found.", "Caching headers detected."),
    "favicon": ("Favicon missing.", "Favicon present."),
    "charset": ("Charset declaration missing.", "Charset declared."),
    "doctype": ("Doctype missing.", "Doctype declared."),
    "readability": ("Readability could be improved (Flesch: {flesch_reading_ease}).", "Good readability (Flesch: {flesch_reading_ease})."),
    "keyword_usage": ("{keywords_missing} target keywords missing or low presence.", "Target keywords effectively used."),
    "most_common_keywords": ("Could not identify common keywords.", "Common keywords identified."),
    "text_html_ratio": ("Text-to-HTML ratio low ({text_html_ratio}%).", "Text-to-HTML ratio is {text_html_ratio}%."),
    "spell_check": ("{misspelled_count} potential spelling errors found.", "No significant spelling errors."),
}
# Messages of single cases, in the order they are tried before the rule's own two; conditions are on feature columns.
CASES: dict[str, list[tuple[str, str]]] = {
    "title": [("title IS NULL", "Title missing.")],
    "meta_description": [("meta_description IS NULL", "Meta description missing.")],
    "image_alt_text": [("images = 0", "No images detected.")],
    "html_page_size": [("html_size > 200 * 1024 AND html_size <= 500 * 1024", "HTML page size is moderate ({html_kb}KB).")],
    "dom_size": [("dom_size > 1500", "DOM size is very large ({dom_size} elements).")],
    "readability": [("flesch_reading_ease IS NULL", "Readability score N/A."),
                    ("flesch_reading_ease < 30", "Very difficult to read (Flesch: {flesch_reading_ease}).")],
    "keyword_usage": [("keywords_targeted = 0", "No specific keywords targeted for usage analysis.")],
    "text_html_ratio": [("text_html_status IS NULL", "Text-to-HTML ratio N/A.")],
}
# Inputs that come from other tables; each has a value for when it is absent.
_OPTIONAL = {"headers": "cast(null as map<string,string>)", "http_version": "cast(null as string)",
             "broken_links": "0", "misspelled_count": "0"}


def score_inputs(features: DataFrame, keywords: Sequence[str] = ()) -> DataFrame:
    """Features with the content measures and defaults for inputs of other tables."""
    out = features
    for name, expr in _OPTIONAL.items():
        if name not in out.columns:
            out = out.withColumn(name, F.expr(expr))
    found = sum((F.when(occurrences("visible_text", k) > 0, 1).otherwise(0) for k in keywords), F.lit(0))
    return with_readability(out, "visible_text").withColumns({
        **text_html_ratio(F.length("visible_text"), F.col("html_size")),
        "keywords_missing": F.lit(len(keywords)) - found,
        "common_keywords": F.transform(top_counts(keyword_tokens("visible_text", 4), 10), lambda t: t["token"]),
        "html_kb": F.round(F.col("html_size") / 1024).cast("int"),
    })


def _if(flag: str | Column) -> Column:
    return F.when(F.coalesce(as_col(flag), F.lit(False)), 1.0).otherwise(0.0)


def _steps(c: str, half: int, none: int) -> Column:
    return F.when(F.col(c) > none, 0.0).when(F.col(c) > half, 0.5).otherwise(1.0)


def _header(*names: str) -> Column:
    hit = F.lit(False)
    for n in names:
        hit = hit | F.coalesce(F.length(F.try_element_at("headers", F.lit(n))) > 0, F.lit(False))
    return hit


def _shares(n_keywords: int) -> dict[str, Column]:
    """Share of the points a page earns, or for a penalty loses points for (before the maximum is applied)."""
    ease = F.col("flesch_reading_ease")
    graded = F.when(F.col("title").isNotNull(), 0.3).otherwise(0.0)
    return {
        "title": F.when(F.col("title_good_length"), 1.0).otherwise(graded),
        "meta_description": F.when(F.col("description_good_length"), 1.0).when(
            F.col("meta_description").isNotNull(), 0.3).otherwise(0.0),
        "headings": F.when(F.col("h1_count") == 1, 0.6).when(F.col("h1_count") > 1, 0.3).otherwise(0.0)
        + F.when(F.col("h2_count") > 0, 0.4).otherwise(0.0),
        "image_alt_text": F.coalesce(F.try_divide((F.col("images") - F.col("images_without_alt")).cast("double"),
                                                  F.col("images")), F.lit(0.5)),
        "content_length": _if("enough_words"), "internal_links": _if("enough_links"),
        "open_graph": _if("has_open_graph"), "twitter_card": _if("has_twitter_card"),
        "seo_friendly_url": _if("is_seo_friendly_url"), "deprecated_html": _if("has_deprecated"),
        "flash_content": _if("has_flash"), "frameset": _if("has_frameset"),
        "https": _if("is_https"), "canonical_tag": _if("has_canonical"), "mobile_responsive": _if("is_mobile_friendly"),
        "structured_data": _if(F.col("has_schema") | F.col("has_json_ld") | F.col("has_microdata")),
        "meta_robots": _if(F.col("meta_robots").isNotNull()),
        "http_version": _if(F.col("http_version").isin("HTTP/2.0", "HTTP/3")),
        "hsts": _if(_header("strict-transport-security")), "mixed_content": _if("has_mixed_content"),
        "html_page_size": _steps("html_size", 200 * 1024, 500 * 1024), "dom_size": _steps("dom_size", 800, 1500),
        "html_compression": _if(F.lower(F.try_element_at("headers", F.lit("content-encoding"))).rlike("gzip|br")),
        "page_cache": _if(_header("cache-control", "expires", "etag")),
        "favicon": _if("has_favicon"), "charset": _if("has_charset"), "doctype": _if("has_doctype"),
        "readability": F.when(ease >= 60, 1.0).when(ease >= 30, 0.5).when(ease.isNotNull(), 0.1).otherwise(0.0),
        "keyword_usage": F.lit(1.0) if not n_keywords else 1.0 - F.col("keywords_missing") / F.lit(float(n_keywords)),
        "most_common_keywords": _if(F.size("common_keywords") > 0),
        "text_html_ratio": F.when(F.col("text_html_status") == "low_ratio", 0.2).when(
            F.col("text_html_status").isNotNull(), 1.0).otherwise(0.0),
    }


def _counted(most: Mapping[str, float]) -> dict[str, Column]:
    """Points of rules that count things: earned points, or points lost for a penalty."""
    def capped(name: str, c: str, each: float) -> Column:
        return F.least(F.lit(float(most[name])), F.col(c) * F.lit(each))
    return {
        "responsive_image": F.greatest(F.lit(0.0), F.lit(float(most["responsive_image"])) - F.col("images_not_responsive")),
        "broken_links": capped("broken_links", "broken_links", 1.0), "inline_css": capped("inline_css", "inline_styles", 0.1),
        "unsafe_cross_origin_links": capped("unsafe_cross_origin_links", "unsafe_cross_origin_links", 0.5),
        "spell_check": capped("spell_check", "misspelled_count", 0.5)}


def _message(template: str) -> Column:
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if piece:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("N/A")) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def _wording(rule: str, bad: Column) -> Column:
    """A rule's message: that of the first case that holds, else its issue or its success."""
    issue, success = (_message(t) for t in MESSAGES[rule])
    text = F.when(bad, issue).otherwise(success)
    for condition, template in reversed(CASES.get(rule, [])):
        text = F.when(F.expr(condition), _message(template)).otherwise(text)
    return text


def rule_table(weights: Mapping[str, Mapping[str, float]] | None = None) -> list[tuple[str, str, float, float]]:
    """(category, rule, most points, weight) with the user's changes applied."""
    changes = weights or {}
    out = []
    for category, rules in RULES.items():
        for rule, (most, weight) in rules.items():
            c = changes.get(rule, {})
            out.append((category, rule, float(c.get("max_points", most)), float(c.get("weight", weight))))
    return out


def with_rule_rows(inputs: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None,
                   n_keywords: int = 0) -> DataFrame:
    """Adds ``rule_rows``: one struct per rule with points, message and verdict, inside the page row."""
    table = rule_table(weights)
    shares, counted = _shares(n_keywords), _counted({r: m for _, r, m, _ in table})
    rows = []
    for category, rule, most, weight in table:
        points = (counted[rule] if rule in counted else shares[rule] * F.lit(most)).cast("double")
        lost = rule in PENALTIES
        bad = points > 0 if lost else points < most * 0.8
        shown = F.when(bad, points).otherwise(F.lit(most)) if lost else points
        text = F.concat(F.lit(rule.replace("_", " ").title() + ": "), _wording(rule, bad),
                        F.when(bad, " (Penalty: " if lost else " (Score: ").otherwise(" (Score: "),
                        F.format_string("%.1f/%.1f)", shown, F.lit(most)))
        rows.append(F.struct(
            F.lit(category).alias("category"), F.lit(rule).alias("rule"), F.lit(most).alias("max_points"),
            F.lit(weight).alias("weight"), (F.lit(most) - points if lost else points).alias("earned"),
            bad.alias("is_issue"), text.alias("message")))
    has_text = F.trim("visible_text") != ""
    # The number of keywords asked for is a column while the rules are written out, as their cases name it.
    counted_in = inputs.withColumn("keywords_targeted", F.lit(n_keywords))
    return counted_in.withColumn("rule_rows", F.filter(F.array(*rows), lambda r: has_text | (r["category"] != "content"))).drop("keywords_targeted")


def _category(name: str) -> dict[str, Column]:
    mine = F.filter("rule_rows", lambda r: r["category"] == name)

    def total(c: str) -> Column:
        return F.aggregate(mine, F.lit(0.0), lambda s, r: s + r[c] * r["weight"])

    percent = F.coalesce(F.try_divide(total("earned"), total("max_points")) * 100, F.lit(0.0))
    issues = F.transform(F.filter(mine, lambda r: r["is_issue"]), lambda r: r["message"])
    if name == "on_page":
        issues = F.concat(F.when(F.col("h1_count") == 0, F.array(F.lit("Headings: H1 tag missing."))).otherwise(
            F.array().cast("array<string>")), issues)
    if name == "content":
        issues = F.when(F.trim("visible_text") == "", F.array(
            F.lit("Content: Analysis module did not run or found no content."))).otherwise(issues)
    return {f"{name}_score_percent": fixed(F.greatest(F.lit(0.0), F.least(percent, F.lit(100.0))), 1),
            f"{name}_issues": issues,
            f"{name}_successes": F.transform(F.filter(mine, lambda r: ~r["is_issue"]), lambda r: r["message"])}


def overall_seo(weights: Mapping[str, float] | None = None, compat: bool = True) -> Column:
    """Weighted mean of the category percents; ``compat`` leaves the on-page part out, as the stored reports do."""
    w = {**CATEGORY_WEIGHTS, **(weights or {})}
    used = {k: v for k, v in w.items() if not (compat and k == "on_page")}
    total = sum((F.col(f"{k}_score_percent") * v for k, v in used.items()), F.lit(0.0))
    return fixed(total / sum(used.values()), 1)


def score_pages(features: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None,
                category_weights: Mapping[str, float] | None = None, keywords: Sequence[str] = (),
                compat: bool = True) -> DataFrame:
    """Category percents, issue and success messages and the overall percent of each page."""
    rows = with_rule_rows(score_inputs(features, keywords), weights, len(keywords))
    parts: dict[str, Column] = {}
    for c in RULES:
        parts.update(_category(c))
    scored = rows.withColumns(parts)
    return scored.withColumn("overall_seo_score_percent", overall_seo(category_weights, compat))


def rule_rows_long(features: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None,
                   keywords: Sequence[str] = ()) -> DataFrame:
    """One row per page and rule."""
    rows = with_rule_rows(score_inputs(features, keywords), weights, len(keywords))
    # The outer form keeps the optimizer from evaluating the array a second time in a filter.
    return rows.select("page_id", F.inline_outer("rule_rows"))


def category_percents(rows: DataFrame) -> DataFrame:
    """Percents from long rule rows (page_id, category, earned, max_points, weight)."""
    return rows.groupBy("page_id", "category").agg(fixed(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(
        F.try_divide(F.sum(F.col("earned") * F.col("weight")), F.sum(F.col("max_points") * F.col("weight"))) * 100,
        F.lit(0.0)))), 1).alias("score_percent"))


def snapshots_from_audit(scored: DataFrame, created_at: Column) -> DataFrame:
    """Snapshot rows of an audit run, with the scores stored where the score views read them."""
    names = [f"{c}_{k}" for c in RULES for k in ("score_percent", "issues")] + ["overall_seo_score_percent"]
    return scored.select(
        F.xxhash64("url").alias("id"), url_hash("url").alias("page_url_hash"), "title", "meta_description", "language",
        text_hash("visible_text").alias("text_hash"), "has_breadcrumbs",
        F.col("bullet_lists").alias("bullet_list_count"), F.col("number_lists").alias("number_list_count"),
        F.col("avg_paragraph_words").alias("avg_paragraph_word_count"),
        F.col("internal_link_count").alias("internal_links_count"), F.col("external_link_count").alias("external_links_count"),
        F.to_json(F.struct(F.struct(*names).alias("scores"))).alias("seo_flags"), created_at.alias("created_at"))


def audit_pages(pages: DataFrame, created_at: Column, keywords: Sequence[str] = (), **names: str) -> DataFrame:
    """Pages to snapshot rows in one pass without a shuffle."""
    features = audit_features(pages, keywords[0] if keywords else None, **names)
    return snapshots_from_audit(score_pages(features, keywords=keywords), created_at)


# ---- responses and assets ------------------------------------------------

def header_features(responses: DataFrame, headers: str = "headers") -> DataFrame:
    """Encoding, security, cache and delivery headers. Header names are lower-cased first."""
    h = responses.withColumn("_h", lower_keys(headers))

    def val(name: str) -> Column:
        return F.try_element_at("_h", F.lit(name))

    return h.withColumns({
        "content_encoding": F.lower(val("content-encoding")), "x_robots_tag": val("x-robots-tag"),
        "hsts": val("strict-transport-security"), "server": val("server"),
        "cache_control": val("cache-control"), "expires": val("expires"), "pragma": val("pragma"), "etag": val("etag"),
        "last_modified": val("last-modified"), "cdns": cdn_flags("_h"), "uses_cdn": F.size(cdn_flags("_h")) > 0}).drop("_h")


def asset_caching(assets: DataFrame, most: int | None = None, key: str = "page_id", headers: str = "headers") -> DataFrame:
    """Cache headers of the assets of each page; with ``most``, of the first so many of each type."""
    a = assets if most is None else top_n_per_group(assets, [key, "resource_type"], [F.asc("url")], most).drop("rank")
    h = lower_keys(headers)

    def has(name: str) -> Column:
        return F.coalesce(F.length(F.try_element_at(h, F.lit(name))) > 0, F.lit(False))

    return a.select(key, "resource_type", "url", "status_code", has("cache-control").alias("has_cache_control"),
                    has("expires").alias("has_expires"), has("etag").alias("has_etag"))


def minification(content: Column | str, max_space: float = 0.15, long_mean: int = 200, long_single: int = 500) -> dict[str, Column]:
    """Whether a script or style looks minified: few blanks, long lines, or one long line."""
    text = as_col(content)
    chars = F.length(text)
    body = F.regexp_replace(text, r"(\r\n|\n|\r)\z", "")
    lines = F.when(chars > 0, F.size(F.split(body, r"\r\n|\n|\r"))).otherwise(0)
    space = F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"\s")).cast("double"), chars), F.lit(0.0))
    mean = F.coalesce(F.try_divide(chars.cast("double"), lines), F.lit(0.0))
    return {
        "is_minified": ((lines == 1) & (chars > long_single)) | ((lines > 1) & ((space < max_space) | (mean > long_mean))),
        "whitespace_ratio": fixed(space, 3), "avg_line_length": fixed(mean, 1), "line_count": lines, "char_count": chars}


def asset_minification(assets: DataFrame, content: str = "text") -> DataFrame:
    """Minification measures of script and style assets."""
    m = minification(content)
    return assets.filter(F.col("resource_type").isin("javascript", "css")).select(
        "page_id", "resource_type", "url", *[c.alias(n) for n, c in m.items()])


_NAV = "struct<{}>".format(",".join(f"{n}:double" for n in (
    "requestStart", "responseStart", "domInteractive", "domComplete", "loadEventEnd", "firstPaint",
    "firstContentfulPaint", "resources")))


def perf_metrics(df: DataFrame, nav: str = "nav") -> DataFrame:
    """Speed metrics in milliseconds from a navigation timing JSON."""
    n = F.from_json(nav, _NAV)
    start = n["requestStart"]
    return df.withColumns({
        "ttfb": n["responseStart"] - start, "dom_interactive": n["domInteractive"] - start,
        "dom_complete": n["domComplete"] - start, "load_time": n["loadEventEnd"] - start,
        "first_paint": n["firstPaint"], "first_contentful_paint": n["firstContentfulPaint"],
        "resource_count": n["resources"].cast("int")})


def psi_flatten(df: DataFrame, body: str = "body") -> DataFrame:
    """Lighthouse and field data JSON to columns; category scores as whole percents."""
    # Category and audit names.
    categories = {"performance": "performance_score", "accessibility": "accessibility_score",
                  "best-practices": "best_practices_score", "seo": "seo_score", "pwa": "pwa_score"}
    audits = ["first-contentful-paint", "largest-contentful-paint", "total-blocking-time", "cumulative-layout-shift", "speed-index"]

    def at(path: str) -> Column:
        return F.get_json_object(body, path)

    out = {alias: F.round(at(f"$.lighthouseResult.categories['{n}'].score").try_cast("double") * 100).cast("int")
           for n, alias in categories.items()}
    for a in audits:
        base = f"$.lighthouseResult.audits['{a}']"
        out[a.replace("-", "_")] = F.coalesce(at(base + ".displayValue"), at(base + ".numericValue"))
    out["crux_category"] = at("$.loadingExperience.overall_category")
    out["crux_metrics"] = at("$.loadingExperience.metrics")
    out["crux_origin_category"] = at("$.originLoadingExperience.overall_category")
    return df.withColumns(out)


def duplicate_texts(df: DataFrame, key: str, text: str, sample: int | None = None) -> DataFrame:
    """Texts that occur more than once, by hash (of the whole text unless a sample length is given)."""
    return (df.select(key, text_hash(text, sample).alias("text_hash")).groupBy("text_hash")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key")).filter(F.col("n_rows") > 1))
