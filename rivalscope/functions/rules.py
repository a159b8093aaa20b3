"""Rounding, bands, weighted sums and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: Column | str, places: int) -> Column:
    """Round half up through a decimal, then back to double."""
    return F.round(as_col(c).cast("decimal(38,10)"), places).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division that yields NULL for a zero or NULL denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def seconds_between(end: Column | str, start: Column | str) -> Column:
    """Seconds between two timestamps of the same type, whatever the session time zone."""
    gap = as_col(end) - as_col(start)
    parts = {"DAY": 86400.0, "HOUR": 3600.0, "MINUTE": 60.0, "SECOND": 1.0}
    return sum((F.date_part(F.lit(p), gap).cast("double") * w for p, w in parts.items()), F.lit(0.0))


def band(c: Column | str, bands: Sequence[tuple[float, float]], otherwise: float,
         missing: float | None = None) -> Column:
    """Score of the first band whose upper bound holds the value.

    ``missing`` is a marker value that gives NULL. A NULL value falls to
    ``otherwise``.
    """
    value = as_col(c)
    out = None
    if missing is not None:
        out = F.when(value == F.lit(missing), F.lit(None).cast("double"))
    for upper, score in bands:
        test = value <= F.lit(upper)
        out = F.when(test, F.lit(float(score))) if out is None else out.when(test, F.lit(float(score)))
    return out.otherwise(F.lit(float(otherwise)))


def weighted(weights: Mapping[str, float] | Sequence[tuple[Column, float]], default: float = 0.0,
             places: int | None = None) -> Column:
    """Weighted sum in which a NULL term counts as ``default``."""
    pairs = [(as_col(k), w) for k, w in weights.items()] if isinstance(weights, Mapping) else list(weights)
    total = None
    for c, w in pairs:
        term = F.coalesce(c, F.lit(default)) * F.lit(w)
        total = term if total is None else total + term
    return total if places is None else fixed(total, places)


def label(c: Column | str, above: Sequence[tuple[float, str]] = (), below: Sequence[tuple[float, str]] = (),
          otherwise: str = "") -> Column:
    """Name of the first threshold the value passes."""
    value = as_col(c)
    out = None
    for limit, name in above:
        out = F.when(value > limit, name) if out is None else out.when(value > limit, name)
    for limit, name in below:
        out = F.when(value < limit, name) if out is None else out.when(value < limit, name)
    return out.otherwise(otherwise)


def where_optional(df: DataFrame, **equal: object) -> DataFrame:
    """Keep rows equal to each argument that is not None."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def where_in(df: DataFrame, column: str, ids: Sequence[int], least: int = 1, most: int | None = None) -> DataFrame:
    """Keep rows of chosen ids; a caller may ask for a least and a greatest number of them."""
    if len(ids) < least or (most is not None and len(ids) > most):
        raise ValueError(f"provide {least} to {most} ids, got {len(ids)}")
    return df.filter(F.col(column).isin(list(ids)))


def lookup(df: DataFrame, **key: object) -> DataFrame:
    """Rows with the given key."""
    return where_optional(df, **key)


def engagement(like: str = "like_count", comment: str = "comment_count", share: str = "share_count") -> Column:
    """Likes, comments and shares with NULL as zero."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in (comment, share)), F.coalesce(F.col(like), F.lit(0)))


def completeness(title: str = "title", brand: str = "brand", price: str = "current_price",
                 specs: str = "specifications") -> Column:
    """Points for a filled product record: title 20, brand 15, price 20, specifications 45."""
    def filled(c: str) -> Column:
        return F.length(F.trim(F.col(c))) > 0
    flat = F.regexp_replace(F.col(specs), r"\s", "")
    return (
        F.when(filled(title), 20).otherwise(0)
        + F.when(filled(brand), 15).otherwise(0)
        + F.when(F.col(price).isNotNull(), 20).otherwise(0)
        + F.when(flat.isNotNull() & ~flat.isin("{}", "[]"), 45).otherwise(0)
    )


def mean_available(*cols: str, places: int = 4, skip_zero: bool = False) -> Column:
    """Mean of the scores that are present."""
    present = F.filter(
        F.array(*[F.col(c).cast("double") for c in cols]),
        lambda x: x.isNotNull() & ((x != 0.0) if skip_zero else F.lit(True)),
    )
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return fixed(F.try_divide(total, F.size(present)), places)
