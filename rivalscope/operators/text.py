"""Text features. Each is computed inside its own row: no text is shuffled to be counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_col, fixed
from ..functions.text import occurrences

# English stopwords.
STOPWORDS = sorted(set("""
a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was
will with i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
its itself them theirs themselves what which who whom those am were been being have has had having do does did doing
because until while about against between through during before after above below from up down out off over under again
further once here when where why how all any both each few more most other some nor only own same so than too very s t
can just don should now
""".split()))

# Phrases that call to action.
CTA_PHRASES = ["buy now", "shop now", "get started", "try now", "sign up", "contact us", "book now", "download",
               "discover", "find out", "see how", "start now", "join now", "request a quote", "subscribe",
               "learn more", "read more"]

# Words of each search intent by strength.
INTENT_WORDS = {
    "transactional": {
        3: "buy|purchase|order|checkout|cart|payment|book|booking|reserve|subscription|price|pricing|cost|quote|estimate|"
           "download|install|get|acquire|trial|demo|signup|sign up|register|hire|employ|engage|contract",
        2: "deal|offer|discount|coupon|sale|free|cheap|affordable|budget|shop|store|market|vendor",
        1: "get started|begin|start|contact|call|phone"},
    "commercial": {
        3: "best|top|leading|premier|vs|versus|compare|comparison|review|reviews|rating|ratings|alternative|alternatives|options",
        2: "features|benefits|advantages|pros|cons|disadvantages|recommendation|recommend|evaluation|assess|analysis",
        1: "quality|performance|reliability|popular|trending|latest"},
    "informational": {
        3: "how|what|why|when|where|which|guide|tutorial|instruction|manual|learn|study|understand|explain|definition|meaning|concept",
        2: "tips|advice|help|assistance|examples|samples|instances|strategy|method|approach|technique|steps|process|procedure",
        1: "information|info|details|facts|overview|introduction|basics|faq|questions|answers"},
    "navigational": {
        3: "login|log in|sign in|signin|dashboard|account|profile|homepage|home|main page|contact|about|support",
        2: "help center|customer service|terms|privacy|policy|location|address|directions|career|jobs|employment",
        1: "site|website|portal|platform|official|main|primary"},
}
# URL parts of each search intent by weight.
INTENT_URL_PARTS = {
    "transactional": {4: ["/pricing", "/plans", "/buy", "/order", "/checkout", "/cart", "/purchase"],
                      2: ["/trial", "/demo", "/signup", "/register", "/subscribe"], 1: ["/contact", "/quote", "/estimate"]},
    "commercial": {4: ["/compare", "/vs", "/versus", "/reviews", "/alternatives"],
                   2: ["/features", "/benefits", "/pricing-comparison"], 1: ["/products", "/services", "/solutions"]},
    "informational": {4: ["/blog", "/guide", "/tutorial", "/how-to", "/learn"],
                      2: ["/help", "/support", "/faq", "/documentation"], 1: ["/news", "/articles", "/resources"]},
    "navigational": {4: ["/login", "/signin", "/dashboard", "/account", "/profile"],
                     2: ["/about", "/contact", "/home", "/index"], 1: ["/sitemap", "/directory"]},
}
# Order in which equal scores are taken.
INTENT_ORDER = ["transactional", "commercial", "navigational", "informational"]


def bind_once(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(c: Column | str) -> Column:
    """Runs of Unicode letters, digits and underscore, lower case."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"(?U)(\w+)"), 1)


def keyword_tokens(c: Column | str, min_length: int, stop: bool = True, unicode: bool = False) -> Column:
    """Words of a-z and 0-9 in order (any letters with ``unicode``), without stopwords and short words."""
    def keep(w: Column) -> Column:
        ok = F.length(w) >= min_length
        if not unicode:
            ok = ok & w.rlike("^[a-z0-9]+$")
        return ok & ~w.isin(list(STOPWORDS)) if stop else ok

    return F.filter(words(c), keep)


def _steps(n: Column) -> Column:
    empty = F.array().cast("array<int>")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(empty)


def top_counts(tokens: Column, n: int | None = None) -> Column:
    """The n most frequent values of an array (all without n) as (neg, token), most frequent first, ties by value.

    The array is sorted and the lengths of its runs are read off, so the cost is
    that of one sort per row and no shuffle takes place.
    """
    def runs(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(_steps(size), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bind_once(starts, lambda b: F.transform(b, lambda start, j: F.struct(
            (start - F.coalesce(F.get(b, j + 1), size)).alias("neg"), F.get(s, start).alias("token"))))

    counts = F.array_sort(bind_once(F.array_sort(tokens), runs))
    return counts if n is None else F.slice(counts, 1, n)


def _ranked(df: DataFrame, key: str, top: Column, name: str) -> DataFrame:
    return (df.select(key, F.posexplode(top).alias("_p", "_t"))
            .select(key, F.col("_t.token").alias(name), (-F.col("_t.neg")).cast("bigint").alias("n"),
                    (F.col("_p") + 1).cast("bigint").alias("rank")))


def top_keywords(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 10, min_length: int = 4,
                 unicode: bool = False) -> DataFrame:
    """Most frequent words of each document."""
    return _ranked(df, key, top_counts(keyword_tokens(text, min_length, unicode=unicode), n), "keyword")


def ngrams(tokens: Column, k: int) -> Column:
    return bind_once(tokens, lambda t: F.transform(
        _steps(F.size(t) - (k - 1)), lambda i: F.array_join(F.slice(t, i + 1, k), " ")))


def top_ngrams(df: DataFrame, k: int, key: str = "doc_id", text: str = "text", n: int = 10) -> DataFrame:
    """Most frequent word sequences of length k after stopwords are removed."""
    return _ranked(df, key, top_counts(ngrams(keyword_tokens(text, 3), k), n), "ngram")


def light_stem(c: Column) -> Column:
    """Word without one of a few English endings (first that fits)."""
    w = F.lower(c)
    out = None
    # Endings in the order they are tried.
    for suffix in ["ing", "edly", "ed", "ly", "s", "es"]:
        fits = w.endswith(suffix) & (F.length(w) > len(suffix) + 2)
        cut = F.left(w, F.length(w) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(w)


def keyword_density(df: DataFrame, keywords: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count, density and stem variants of each target keyword per document."""
    total = F.greatest(F.size(keyword_tokens(text, 1, stop=False)), F.lit(1))
    rows = []
    for kw in keywords:
        stem = light_stem(F.lit(kw.lower().split()[0]))
        variants = F.array_sort(F.array_distinct(F.filter(
            keyword_tokens(text, 4), lambda w: (light_stem(w) == stem) & (w != kw.lower()))))
        rows.append(F.struct(F.lit(kw).alias("keyword"), occurrences(text, kw).alias("phrase_count"),
                             F.slice(variants, 1, 8).alias("variants")))
    out = df.select(key, total.alias("_total"), F.explode(F.array(*rows)).alias("_k")).select(key, "_total", "_k.*")
    return out.withColumn("density_percent", fixed(F.col("phrase_count") / F.col("_total") * 100, 2)).drop("_total")


def syllables(word: Column) -> Column:
    """Vowel groups of a word, silent final e dropped; at least one."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    bare = F.regexp_replace(w, "(?<!l)e$", "")
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]+"))))


def with_readability(df: DataFrame, text: str = "text") -> DataFrame:
    """Flesch reading ease and grade as columns; NULL below 100 words or 3 sentences."""
    w = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\w+(?:['\-]+\w+)*)"), 1)
    sentences = F.filter(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != "")
    base = df.withColumns({"_w": w, "sentences": F.size(sentences)})
    base = base.withColumns({"words": F.size("_w"), "syllables": F.aggregate("_w", F.lit(0), lambda acc, x: acc + syllables(x))})
    enough = (F.col("words") >= 100) & (F.col("sentences") >= 3)
    asl = F.try_divide(F.col("words").cast("double"), F.col("sentences"))
    asw = F.try_divide(F.col("syllables").cast("double"), F.col("words"))
    return base.withColumns({
        "flesch_reading_ease": F.when(enough, fixed(206.835 - 1.015 * asl - 84.6 * asw, 2)),
        "flesch_kincaid_grade": F.when(enough, fixed(0.39 * asl + 11.8 * asw - 15.59, 2)),
        "avg_sentence_length": F.when(enough, fixed(asl, 2)),
        "avg_syllables_per_word": F.when(enough, fixed(asw, 2))}).drop("_w")


def readability(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return with_readability(df.select(key, text), text).drop(text)


def reading_label(score: Column | str) -> Column:
    s = as_col(score)
    return (F.when(s >= 90, "Very easy to read.").when(s >= 70, "Easy to read.").when(s >= 60, "Plain English.")
            .when(s >= 50, "Fairly difficult to read.").when(s >= 30, "Difficult to read.")
            .when(s.isNotNull(), "Very difficult to read."))


def text_html_ratio(text_length: Column, html_length: Column) -> dict[str, Column]:
    """Share of visible text in the page source, with a band."""
    share = F.coalesce(F.try_divide(text_length.cast("double"), html_length), F.lit(0.0))
    percent = fixed(share * 100, 2)
    return {"text_html_ratio": percent,
            "text_html_status": F.when(percent < 15, "low_ratio").when(percent > 70, "high_ratio").otherwise("calculated")}


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Distinct lower-case ASCII words of a table, as a dictionary."""
    ascii_words = F.filter(words(text), lambda w: w.rlike("^[a-z]+$"))
    return df.select(F.explode(F.array_distinct(ascii_words)).alias("word")).distinct()


def spellcheck(df: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", samples: int = 20) -> DataFrame:
    """Distinct words over two letters that a dictionary lacks: count and samples per document.

    The whole text is checked. Words are made distinct inside each row before
    they meet the dictionary.
    """
    own = F.array_distinct(F.filter(words(text), lambda w: w.rlike("^[a-z]+$") & (F.length(w) > 2)))
    unknown = (df.select(key, F.explode(own).alias("word")).join(dictionary.select("word"), "word", "left_anti"))
    found = unknown.groupBy(key).agg(F.count(F.lit(1)).alias("misspelled_count"),
                                     F.slice(F.array_sort(F.collect_list("word")), 1, samples).alias("samples"))
    return df.select(key).join(found, key, "left").select(
        key, F.coalesce("misspelled_count", F.lit(0)).alias("misspelled_count"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def _hits_in(group: Sequence[str]) -> Column:
    return F.size(F.filter("_hits", lambda w: w.isin(*group)))


def search_intent(df: DataFrame, text: str = "text", url: str | None = None) -> DataFrame:
    """Intent scores, the leading intent and its confidence.

    The text is cut into words once and only words of some class are kept; each
    class then counts in that short list. The few phrases of two words are
    counted by pattern where the text has them.
    """
    low = F.lower(F.col(text))
    address = None
    if url is not None:
        bare = F.regexp_replace(F.lower(F.col(url)), r"#.*$", "")
        address = F.concat_ws(" ", F.regexp_extract(bare, r"^(?:[a-z][a-z0-9+.\-]*:)?(?://[^/?]*)?([^?]*)", 1),
                              F.regexp_extract(bare, r"\?(.*)$", 1))
    single = sorted({w for s in INTENT_WORDS.values() for alt in s.values() for w in alt.split("|") if " " not in w})
    df = df.withColumn("_hits", F.filter(words(text), lambda w: w.isin(single)))
    scores = {}
    for name, strengths in INTENT_WORDS.items():
        total = F.lit(0)
        for w, alt in strengths.items():
            plain = [x for x in alt.split("|") if " " not in x]
            total = total + _hits_in(plain) * w
            for phrase in (x for x in alt.split("|") if " " in x):
                total = total + F.when(low.contains(phrase), F.regexp_count(low, F.lit(rf"(?U)\b{phrase}\b"))).otherwise(0) * w
        if address is not None:
            for w, parts in INTENT_URL_PARTS[name].items():
                total = total + sum((F.when(address.contains(p), w).otherwise(0) for p in parts), F.lit(0))
        scores[name] = F.when(F.trim(F.col(text)) == "", 0).otherwise(total).cast("bigint")
    out = df.withColumns({f"{n}_score": c for n, c in scores.items()})
    ordered = F.sort_array(F.array(*[F.col(f"{n}_score") for n in scores]), asc=False)
    best, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    intent = None
    for n in INTENT_ORDER:
        hit = F.col(f"{n}_score") == best
        intent = F.when(best <= 0, "informational").when(hit, n) if intent is None else intent.when(hit, n)
    confidence = F.when(best <= 0, F.lit(0.0)).otherwise(
        fixed(F.least(best / F.lit(10.0), F.lit(1.0)) * (1 - F.try_divide(second, best) * 0.3), 2))
    return out.withColumns({"search_intent": intent, "intent_confidence": confidence}).drop("_hits")


def passive_ratio(c: Column | str) -> Column:
    """Share of words that start a rough passive form."""
    low = F.lower(as_col(c))
    hits = F.regexp_count(low, F.lit(r"(?U)\b(was|were|be|been|being)\b\s+\b(\w+ed)\b"))
    n = F.size(F.filter(F.split(as_col(c), r"(?U)\s+"), lambda w: w != ""))
    return fixed(hits / F.greatest(F.lit(1), n), 3)


def has_cta(c: Column | str) -> Column:
    return F.lower(as_col(c)).rlike("|".join(CTA_PHRASES))


def keyword_early(c: Column | str, keyword: str, first: int = 100) -> Column:
    """Whether a keyword is among the first words."""
    head = F.slice(F.filter(F.split(as_col(c), r"(?U)\s+"), lambda w: w != ""), 1, first)
    return F.lower(F.array_join(head, " ")).contains(keyword.lower())


def date_markers(c: Column | str) -> Column:
    return F.regexp_count(as_col(c), F.lit(r"(?U)\b(20\d{2}|19\d{2})[-/]\d{1,2}[-/]\d{1,2}\b"))


# Profile address patterns and names that are no profile.
SOCIAL_PATTERNS = {"facebook": r"(?i)(?:facebook|fb)\.com/([a-zA-Z0-9._-]+)",
                   "instagram": r"(?i)instagram\.com/([a-zA-Z0-9._-]+)",
                   "tiktok": r"(?i)tiktok\.com/@([a-zA-Z0-9._-]+)"}
GENERIC_NAMES = ["home", "login", "register", "shop", "blog", "news"]


def social_handles(df: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """Distinct profile names per page and platform, found in the page source."""
    def of(name: str, pattern: str) -> Column:
        users = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 1))
        return F.transform(users, lambda u: F.struct(F.lit(name).alias("platform"), u.alias("username")))

    found = F.flatten(F.array(*[of(name, p) for name, p in SOCIAL_PATTERNS.items()]))
    return (df.select(key, F.explode(found).alias("_h")).select(key, "_h.*")
            .filter((F.length("username") >= 2) & ~F.col("username").isin(GENERIC_NAMES)))


def social_account_row(df: DataFrame, followers: str = "follower_count") -> DataFrame:
    """Account row of a found profile."""
    f = F.col(followers)
    return df.select("*", F.concat(F.lit("https://www."), "platform", F.lit(".com/"), "username").alias("profile_url"),
                     F.concat_ws("_", "platform", "username").alias("external_id"),
                     F.floor(f / 10).cast("bigint").alias("following_count"), (f > 50000).alias("is_verified"),
                     F.lit(True).alias("is_business"))


def token_index(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per document and distinct word with its count; nothing is grouped by word."""
    return (df.select(key, F.explode(top_counts(words(text), 2147483647)).alias("_t"))
            .select(F.col("_t.token").alias("token"), key, (-F.col("_t.neg")).cast("bigint").alias("n")))


def keyword_placement(df: DataFrame, keywords: Sequence[str], text: str, first_paragraph: str | None = None,
                      n: int = 20) -> DataFrame:
    """Primary keyword counts, secondary keywords found and related words."""
    primary, rest = keywords[0].strip(), list(keywords[1:])
    low = F.lower(F.col(text))
    ignore = F.array(*[F.lit(k.lower()) for k in keywords])
    related = top_counts(F.filter(keyword_tokens(text, 4), lambda w: ~F.array_contains(ignore, w)), n)
    first = F.col(first_paragraph) if first_paragraph else F.lit(None).cast("string")
    return df.withColumns({
        "keyword_occurrences": occurrences(text, primary),
        "keyword_in_first_paragraph": F.coalesce(F.lower(first).contains(primary.lower()), F.lit(False)),
        "secondary_found": F.array_compact(F.array(*[F.when(low.contains(k.lower()), F.lit(k)) for k in rest]))
        if rest else F.array().cast("array<string>"),
        "related_words": F.transform(related, lambda t: t["token"])})


