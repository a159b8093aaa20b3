"""Quality rules by distribution divergence, in native column functions only.

Each document gives two histograms: its character classes, and how often the
common words of its language occur (all other words together are one bin). They
are compared with the histograms of all documents of that language by
Jensen-Shannon distance (base 2, 0 to 1). A document is rejected when a distance
passes its limit. The limit falls with length, ``limit + slack / sqrt(words)``,
as short texts scatter more; below the minimum length nothing is compared.

Words are counted within the row; the only shuffle is one small row of numbers a
document, to meet its language's reference.

Defined cases: null or empty text has no words and fails the base rule; a null
or unlisted language has no common words and is compared by character classes
alone, against the documents of the same (null) language; a language with less than
``least_reference`` words has no reference and rejects nothing; repeated rows
are judged alike; extra columns don't take part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, stash

# Frequent words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "as", "with", "be", "by", "are", "this", "at", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
N_COMMON = 20
N_CLASSES = 6
SYMBOLS = r"[#*$%&|<>]"


def repeat_words(words: Column) -> Column:
    """Words lying in a window of three words that occurs twice or more, the first occurrence included."""
    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            hits = F.filter(F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda p: p.isNotNull())
            return F.sort_array(hits)

        def length(p: Column) -> Column:
            gaps = F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
        return let(let(order, starts), length)

    def count(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n < 3, F.lit(0)).otherwise(let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))
    return let(words, count).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def common_counts(words: Column, lang: Column) -> Column:
    """Occurrences of each common word of the language, lower case or capitalised; null where none are listed."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    forms = [*every, *(w.capitalize() for w in every if w.capitalize() != w)]
    listed = F.create_map(*[x for k, ws in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    own = F.element_at(listed, F.coalesce(lang, F.lit("")))
    found = F.lower(F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w.isin(forms)), "  "), F.lit(" ")))
    return let(found, lambda s: F.transform(own, lambda w: (
        (F.length(s) - F.length(F.replace(s, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("long")))


def measures(docs: DataFrame) -> DataFrame:
    """One row of counts a document: base measures, character classes, common words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    row = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        common_counts(w, F.col("lang")).alias("common")))
    return docs.select(
        "doc_id", "lang", row.alias("w"), F.length(text).cast("long").alias("n_chars"),
        counted(SYMBOLS).alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"),
        counted(r"\p{Lu}").alias("n_upper"), counted(r"[0-9]").alias("n_digits"),
        counted(r"[.,;:!?'\"()\-]").alias("n_marks"),
    ).select("doc_id", "lang", "w.*", "n_symbols", "n_dup_lines", F.array(
        F.col("n_chars") - F.col("word_chars"), "n_upper", "n_digits", "n_marks", "n_symbols",
        F.col("word_chars") - F.col("n_upper") - F.col("n_digits") - F.col("n_marks") - F.col("n_symbols")).alias("classes"))


def language_references(rows: DataFrame, least_reference: int) -> DataFrame:
    """Histograms of each language over all its documents."""
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"k{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"c{i}") for i in range(N_COMMON)]
    ref = rows.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), *sums)
    return ref.where(F.col("ref_words") >= least_reference).select(
        F.col("lang").alias("ref_lang"), "ref_words", F.array(*[f"k{i}" for i in range(N_CLASSES)]).alias("ref_classes"),
        F.array(*[f"c{i}" for i in range(N_COMMON)]).alias("ref_common"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either has no mass."""
    mass = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    both = F.struct(mass(a).alias("a"), mass(b).alias("b"))
    total = let(both, lambda m: F.when((m["a"] > 0) & (m["b"] > 0), F.aggregate(
        F.zip_with(a, b, lambda x, y: part(x / m["a"], y / m["b"]) + part(y / m["b"], x / m["a"])), F.lit(0.0), lambda s, v: s + v)))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def with_rest(counts: Column, n_words: Column) -> Column:
    """Counts of the common words and, last, of all other words."""
    return F.concat(counts, F.array(n_words - F.aggregate(counts, F.lit(0).cast("long"), lambda s, v: s + v)))


def quality_rules(docs: DataFrame, class_limit: float = 0.15, word_limit: float = 0.20, slack: float = 1.0,
                  least_words: int = 50, least_reference: int = 1000) -> DataFrame:
    """Measures, distances and verdict of each document of ``docs`` (doc_id, text, lang)."""
    rows = stash(measures(docs), "measures")
    refs = language_references(rows, least_reference)
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    room = slack / F.sqrt(F.greatest(n, F.lit(1)))
    far = (F.coalesce(F.col("class_distance") > class_limit + room, F.lit(False))
           | F.coalesce(F.col("word_distance") > word_limit + room, F.lit(False)))
    joined = rows.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").withColumns({
        "class_distance": js_distance(F.col("classes"), F.col("ref_classes")),
        "word_distance": F.when(F.col("common").isNotNull(), js_distance(
            with_rest(F.col("common"), n), with_rest(F.col("ref_common"), F.col("ref_words"))))})
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), (~base & ~((n >= least_words) & far)).alias("kept"),
                         "class_distance", "word_distance")
