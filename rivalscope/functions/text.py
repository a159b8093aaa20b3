"""Text keys, prices, JSON fields and issue texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import as_col


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter (rule, not a list)."""
    src, dst = [], []
    for point in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            src.append(chr(point))
            dst.append(plain)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()
# Letters without decomposition and their plain form.
STROKED = {"Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i"}
LIGATURES = {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "ß": "ss", "ẞ": "SS", "Þ": "TH", "þ": "th"}
_FROM, _TO = ACCENTED + "".join(STROKED), PLAIN + "".join(STROKED.values())


def unaccent(c: Column | str) -> Column:
    """Accented and stroked letters made plain, ligatures written out."""
    out = as_col(c)
    for letter, plain in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.translate(out, _FROM, _TO)


def ascii_fold(c: Column | str) -> Column:
    """Accents removed, other non-ASCII characters dropped."""
    return F.regexp_replace(F.translate(as_col(c), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def normalize_text(c: Column | str, accents: bool = True) -> Column:
    """Key of a name: no accents, lower case, single spaces, trimmed."""
    base = unaccent(c) if accents else as_col(c)
    return F.trim(F.regexp_replace(F.lower(base), r"\s+", " "))


_WRITTEN_OUT = "input"
for _letter, _plain in LIGATURES.items():
    _WRITTEN_OUT = f"replace({_WRITTEN_OUT}, '{_letter}', '{_plain}')"
#: Body of the same rule as a SQL function, inlined by Catalyst.
NORMALIZE_TEXT_SQL = (
    "CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(input STRING) RETURNS STRING RETURN "
    f"trim(regexp_replace(lower(translate({_WRITTEN_OUT}, '{_FROM}', '{_TO}')), '\\\\s+', ' '))"
)


def register_sql_functions(spark) -> None:
    """Make ``normalize_text`` callable from SQL text."""
    spark.sql(NORMALIZE_TEXT_SQL)


def parse_price(c: Column | str) -> Column:
    """Price text to a decimal: comma to dot, blanks and DT removed, NULL when it does not parse."""
    cleaned = F.trim(F.replace(F.replace(F.replace(as_col(c), F.lit(","), F.lit(".")), F.lit(" "), F.lit("")),
                               F.lit("DT"), F.lit("")))
    return cleaned.try_cast("decimal(10,2)")


def json_field(c: Column | str, path: str, kind: str = "string", default: object | None = None) -> Column:
    """Typed field of a JSON text with a default."""
    value = F.get_json_object(as_col(c), path)
    if kind != "string":
        value = value.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def issue_numbers(c: Column | str) -> dict[str, Column]:
    """Penalty, score, maximum and first number named in an issue text."""
    text = as_col(c)

    def grab(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")

    return {
        "penalty_value": grab(r"Penalty:\s*([0-9.]+)"),
        "score_value": grab(r"Score:\s*([0-9.]+)/"),
        "score_max": grab(r"Score:\s*[0-9.]+/([0-9.]+)"),
        "raw_number": grab(r"([0-9]+)"),
    }


def issue_key(c: Column | str) -> Column:
    """Issue text without counts after a colon and without a trailing bracket."""
    return F.lower(F.trim(F.regexp_replace(as_col(c), r"(?<=:)\s\d+|\(.*\)$", "")))


def text_hash(c: Column | str, sample: int | None = None) -> Column:
    """MD5 of a text. ``sample`` hashes only that many leading characters."""
    text = as_col(c)
    return F.md5(text if sample is None else F.substring(text, 1, sample))


def word_count(c: Column | str) -> Column:
    """Words by Unicode letters, digits and underscore."""
    return F.regexp_count(as_col(c), F.lit(r"(?U)\w+"))


def occurrences(text: Column | str, phrase: str) -> Column:
    """Non-overlapping, case-insensitive occurrences of a phrase."""
    low = F.lower(as_col(text))
    removed = F.length(low) - F.length(F.replace(low, F.lit(phrase.lower()), F.lit("")))
    return (removed / F.lit(len(phrase))).cast("bigint")


def price_from_text(c: Column | str) -> Column:
    """First price in a text by three patterns in order, or NULL."""
    # Price patterns.
    patterns = [
        r"(?i)\d+[,]?\d[\d\s]*[.,]\d*\s*(?:DT|TND|\$|د.ت)",
        r"(?i)(?:DT|TND|€|\$|د.ت)\s*\d[\d\s]*[.,]?\d+[.,]?\d*",
        r"(?i)\d+[.,]?\d*\s*(?:DT|TND|€|\$|د.ت)",
    ]
    text = as_col(c)
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 0)), F.lit("")) for p in patterns])


def availability_from_text(c: Column | str) -> Column:
    """InStock or OutOfStock from stock words, else NULL."""
    low = F.lower(as_col(c))
    # Stock words.
    return (F.when(low.rlike(r"((en|in) stock|disponible)"), "InStock")
            .when(low.rlike(r"(épuisé|epuisé|rupture|out of stock)"), "OutOfStock"))


def availability_from_schema(c: Column | str) -> Column:
    """Last path part of a schema.org availability URL."""
    return F.element_at(F.split(as_col(c), "/"), -1)
