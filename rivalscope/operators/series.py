"""Ordered windows over one short series per key, and normalisation per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import fixed


def series_window(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def lagged(df: DataFrame, keys: Sequence[str], order: str, col: str, steps: Sequence[int] = (1, 2)) -> DataFrame:
    w = series_window(keys, order)
    names = {1: "prev_" + col, 2: "prev_" + col + "_2"}
    return df.withColumns({names.get(s, f"prev_{col}_{s}"): F.lag(col, s).over(w) for s in steps})


def rolling(df: DataFrame, keys: Sequence[str], order: str, col: str | Column, rows: int, how: str, name: str,
            places: int | None = 4) -> DataFrame:
    """Mean or sample standard deviation over the last ``rows`` rows."""
    w = series_window(keys, order).rowsBetween(-(rows - 1), 0)
    fn = {"avg": F.avg, "stddev": F.stddev_samp}[how]
    value = fn(col).over(w)
    return df.withColumn(name, value if places is None else fixed(value, places))


def minmax_norm(df: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Scale columns to 0..1 within a group; zero where the group is flat.

    Bounds come from an aggregate joined back, not from a whole-partition
    window, so a group is never held in one task.
    """
    bounds = df.groupBy(*keys).agg(*[f(c).alias(f"_{p}_{c}") for c in cols for p, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(bounds, list(keys), "inner")
    for src, dst in cols.items():
        lo, hi = F.col(f"_lo_{src}"), F.col(f"_hi_{src}")
        out = out.withColumn(dst, F.coalesce(F.try_divide(F.col(src) - lo, hi - lo), F.lit(0.0)))
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("lo", "hi")])
