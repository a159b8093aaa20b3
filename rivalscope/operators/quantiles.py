"""Exact quantiles of any numbers, however many distinct ones a group holds.

Spark's exact percentile keeps every distinct value of a group in one buffer, so one group of
continuous values can outgrow a task. Here the searched rank is closed in by counting instead:
approximate quantiles, whose sketches are bounded, cut the range of a group in cells, exact
counts of the cells tell which one holds the rank, and only its rows go on. Counting is split
over all tasks that hold rows of the group; no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder

#: Rows of a group up to which its values are sorted in one buffer.
LEAF = 100_000
#: Cuts of a range in one round.
CELLS = 32


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, null being a value."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys], F.lit(True))


def _stash(df: DataFrame, tag: str) -> DataFrame:
    folder = work_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def exact_quantile(df: DataFrame, keys: Sequence[str], column: str, fraction: float = 0.5, name: str = "quantile",
                   leaf: int = LEAF, cells: int = CELLS) -> DataFrame:
    """(keys, name): the exact quantile of a column in each group, between two values by linear interpolation.

    Null values don't count; a group without values is null; null keys form a group. NaN is the
    greatest value, as in sorting. Each round narrows a group of more than ``leaf`` rows by about
    ``cells``, so a group of n rows takes log(n / leaf) / log(cells) rounds; a value that fills a
    cell alone is found at once, so repeated values cost nothing more.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction lies between 0 and 1")
    keys = list(keys)
    rows = _stash(df.select(*keys, F.col(column).cast("double").alias("_x")), "quantile-rows")
    at = F.lit(fraction) * (F.col("n") - 1)
    groups = rows.groupBy(*keys).agg(F.count("_x").alias("n"))
    # The neighbouring ranks of the quantile, from 0, as searches of their own; one where it falls on a value.
    both = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).cast("bigint").alias("rank")),
                   F.struct(F.lit(1).alias("side"), F.ceil(at).cast("bigint").alias("rank")))
    ranks = groups.filter("n > 0").select(*keys, F.col("n").alias("left"), F.inline(F.filter(
        both, lambda r: (r["side"] == 0) | (F.floor(at) != F.ceil(at)))))
    open_ = ranks.select(*keys, "side", "rank", "left", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    found = _found(rows, _stash(open_, "quantile-ranks"), keys, leaf, cells)
    sides = found.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b"))
    own = groups.withColumn("_part", at - F.floor(at))
    other = sides.select(*[F.col(k).alias(f"_{k}") for k in keys], "a", "b")
    value = F.when(F.col("_part") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("_part"))
    return own.join(other, _same(own, other, keys), "left").select(*[own[k] for k in keys], value.alias(name))


def exact_median(df: DataFrame, keys: Sequence[str], column: str, name: str = "median", **options: int) -> DataFrame:
    """The exact median of a column in each group; see :func:`exact_quantile`."""
    return exact_quantile(df, keys, column, 0.5, name, **options)


def _within(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side, _x): values inside the open range of each search. Ranges are few: at most two a group."""
    on = [*keys, "side"] if "side" in rows.columns else list(keys)
    named = ranges.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "side"]], "low", "high")
    inside = ((F.col("low").isNull() | (F.col("_x") > F.col("low"))) & (F.col("high").isNull() | (F.col("_x") < F.col("high"))))
    met = rows.filter(F.col("_x").isNotNull()).alias("rows").join(named, _same(rows, named, on) & inside)
    return met.select(*[f"rows.{k}" for k in keys], F.col("_side").alias("side"), "_x")


def _found(rows: DataFrame, searches: DataFrame, keys: Sequence[str], leaf: int, cells: int) -> DataFrame:
    """(keys, side, x) of every search."""
    done: list[DataFrame] = []
    by = [*keys, "side"]
    while True:
        small, large = searches.filter(F.col("left") <= leaf), searches.filter(F.col("left") > leaf)
        values = _within(rows, small, keys).groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias("_all"))
        values = values.select(*[F.col(k).alias(f"_{k}") for k in by], "_all")
        done.append(small.join(values, _same(small, values, by)).select(*[small[k] for k in by], F.get("_all", F.col("rank").cast("int")).alias("x")))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # Values still searched are written: a round reads only what the last one left.
        rows = _stash(_within(rows, large, keys), "quantile-round")
        plain = F.when(~F.isnan("_x"), F.col("_x"))
        cuts = F.percentile_approx(plain, [i / cells for i in range(cells + 1)], F.lit(50 * cells))
        cuts = F.array_sort(F.array_distinct(F.concat(F.coalesce(cuts, F.array().cast("array<double>")), F.array(F.lit(float("nan"))))))
        edges = _stash(rows.groupBy(*by).agg(cuts.alias("_cuts")).select(*[F.col(k).alias(f"_{k}") for k in by], "_cuts"), "quantile-cuts")
        # Cell 2i + 1 holds the values equal to cut i, cell 2i those between cut i - 1 and cut i.
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
        cell = 2 * below + F.array_contains("_cuts", F.col("_x")).cast("int")
        counts = rows.join(edges, _same(rows, edges, by)).select(*by, cell.alias("_cell")).groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_upto", F.sum("n").over(upto)).alias("counts")  # at most 2 * cells + 5 rows a search
        asked = large.select(*[F.col(k).alias(f"_{k}") for k in by], "rank", "low", "high").alias("asked")
        hit = (counts.join(asked, _same(counts, asked, by)).filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("n")))
               .select(*[f"counts.{k}" for k in by], "_cell", "n", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"), "low", "high"))
        place = F.floor(F.col("_cell") / 2).cast("int")
        hit = _stash(hit.join(edges, _same(hit, edges, by)).select(
            *[hit[k] for k in by], "rank", F.col("n").alias("left"), (F.col("_cell") % 2 == 1).alias("_met"), F.get("_cuts", place).alias("_cut"),
            F.coalesce(F.get("_cuts", place), F.col("high")).alias("high"),
            F.coalesce(F.when(place > 0, F.get("_cuts", place - 1)), F.col("low")).alias("low")), "quantile-ranks")
        done.append(hit.filter("_met").select(*by, F.col("_cut").alias("x")))
        searches = hit.filter("not _met").select(*by, "rank", "left", "low", "high")
