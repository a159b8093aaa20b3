"""Joins, latest-row selection, top-k, pages and set operations.

No operator here forces a broadcast: Spark broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
shuffles it, with skewed partitions split by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_folder


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key; ``order`` ends with a unique column.

    An aggregate instead of a window: rows are reduced before the shuffle, so a
    key that holds a third of the table is not sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*")


def latest_rows(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """All rows at the newest time of their key (ties kept)."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    return (df.join(newest, list(keys), "inner")
            .filter(F.col(ts) == F.col("_newest")).drop("_newest").select(*df.columns))


def left_join_filtered(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column) -> DataFrame:
    """Left join with a predicate on the right side that keeps every left row."""
    return left.join(right.filter(condition), list(on), "left")


def join_norm(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner") -> DataFrame:
    """Equi-join on a computed key, materialised once per side."""
    return (left.withColumn("_k", left_key).join(right.withColumn("_k", right_key), "_k", how).drop("_k"))


def semi_join(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def with_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One count column per child table; zero where a parent has no child."""
    out = parents
    for name, (child, child_key) in children.items():
        n = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side without a cross join."""
    names = [c for f in frames for c in f.columns]
    tall = frames[0]
    for f in frames[1:]:
        tall = tall.unionByName(f, allowMissingColumns=True)
    return tall.agg(*[F.max(c).alias(c) for c in names])


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    rank: str = "rank") -> DataFrame:
    """First n rows per group. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= n)


def topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


#: Rows up to which a page is cut from a sorted head; deeper pages go by a rank index.
SHALLOW = 10_000


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a listing. ``order`` must end with a unique column.

    The head of a listing is a top-k. A deep page would gather all rows before it in one task,
    so it is read from a :class:`RankIndex`; keep that index to read many pages.
    """
    if number < 1 or size < 1:
        raise ValueError("pages and sizes start at 1")
    if number * size <= SHALLOW:
        return df.orderBy(*order).offset((number - 1) * size).limit(size)
    return RankIndex(df, order).page(number, size)


class RankIndex:
    """A listing sorted once: range-sorted parts on disk and the number of rows before each.

    Rows are numbered within their part, so any page is a filter on one or two parts.
    ``total`` is the number of rows.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], folder: str | None = None) -> None:
        spark = df.sparkSession
        self.columns, self.order = df.columns, list(order)
        self.folder = folder or work_folder(spark, "ranks")
        id_ = F.monotonically_increasing_id()  # part number and row number in the sorted part
        (df.orderBy(*order).withColumn("_id", id_).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
         .drop("_id").write.mode("overwrite").partitionBy("_part").parquet(self.folder))
        self.rows = spark.read.schema(T.StructType([*df.schema, T.StructField("_at", T.LongType()), T.StructField("_part", T.IntegerType())])).parquet(self.folder)
        sizes = sorted((r["_part"], r["count"]) for r in self.rows.groupBy("_part").count().collect())  # one row a part
        self.starts, self.total = [], 0
        for part, n in sizes:
            self.starts.append((part, self.total, n))
            self.total += n

    def page(self, number: int, size: int) -> DataFrame:
        low = (number - 1) * size
        high = low + size
        own = F.lit(False)
        for part, start, n in self.starts:
            if start < high and start + n > low:
                own = own | ((F.col("_part") == part) & (F.col("_at") >= low - start) & (F.col("_at") < high - start))
        return self.rows.filter(own).orderBy(*self.order).select(*self.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def check_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def pairwise_gap(df: DataFrame, key: str, cols: Sequence[str], blocks: int = 16) -> DataFrame:
    """All ordered pairs of different keys with the difference of each column.

    The right side is cut into blocks by key hash and the left side visits each
    block, so pairs come from a hash join spread over the blocks.
    """
    left = (df.select(F.col(key).alias("key_a"), *[F.col(c).alias(f"_{c}") for c in cols])
            .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (df.select(F.col(key).alias("key_b"), *cols)
             .withColumn("_block", F.pmod(F.hash("key_b"), F.lit(blocks))))
    return (left.join(right, "_block").filter(F.col("key_a") != F.col("key_b"))
            .select("key_a", "key_b", *[(F.col(f"_{c}") - F.col(c)).alias(f"{c}_gap") for c in cols]))


def distinct_sketches(df: DataFrame, keys: Sequence[str], column: str, precision: int = 12) -> DataFrame:
    """One mergeable sketch of the distinct values of a column per key, to be stored, say by day.

    Opt-in beside the exact distinct count: a relative error of about 1.04 / sqrt(2 ** precision).
    """
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, precision).alias("sketch"))


def distinct_estimates(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Estimated distinct count per key of united sketches; no fact is read again."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def pivot_matrix(df: DataFrame, row: str, column: str, values: Sequence[object], agg: Column) -> DataFrame:
    """One row per ``row`` and one column per listed value; zero when absent."""
    return df.groupBy(row).pivot(column, list(values)).agg(agg).na.fill(0)
