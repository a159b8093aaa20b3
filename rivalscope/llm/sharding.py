"""Uniform shuffle into shards of exact size, by a matrix of cell-to-shard counts.

1. Rows fall into cells by a seeded hash. One count per cell goes to the driver.
2. The driver draws how many rows each cell sends to each shard: a multivariate
   hypergeometric draw, cell after cell, from what the shards have left. Every
   uniform permutation of all rows induces just this law.
3. Each cell is permuted (rank by a second hash); its first rows go to shard 0,
   the next to shard 1, and so on.
4. Each shard is permuted again by a third hash. Ranks inside a shard are counted
   in cells of that hash, so that no shard has to fit one task.

Only row keys are shuffled, twice. What the driver holds is a table of cells by
shards, at most ``MOST_CELLS`` by the number of shards.

Defined cases: an empty table gives no rows; null text has size 8 and the CRC of
the empty string; null ids and repeated rows are rows like any other; more shards
than rows leaves some shards empty; extra columns of the input don't take part.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Bounds the driver's matrix; beyond it cells grow instead.
MOST_CELLS = 65_536


def draw_hypergeometric(rng: np.random.Generator, good: int, total: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``total`` are among ``good``: inverse transform over the exact ratios around the mode."""
    low, high = max(0, n - (total - good)), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    sd = math.sqrt(max(n * share * (1 - share) * (total - n) / max(total - 1, 1), 0.25))
    reach = int(14 * sd) + 30
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    bad = total - good - n
    rise = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad + up + 1)))
    fall = np.cumprod(down * (bad + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.concatenate([fall[::-1], [1.0], rise])
    return int(mode - len(down) + np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))


def communication_matrix(cells: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts by cell and shard: rows sum to ``cells``, columns to ``shards``."""
    rng = np.random.default_rng(seed)
    left = list(shards)
    out = np.zeros((len(cells), len(shards)), np.int64)
    for i, n in enumerate(cells):
        total = sum(left)
        for j in range(len(left)):
            if not n:
                break
            take = n if j == len(left) - 1 else draw_hypergeometric(rng, left[j], total, n)
            out[i, j] = take
            total -= left[j]
            left[j] -= take
            n -= take
    return out


def shuffle_to_shards(rows: DataFrame, keys: list[str], n_shards: int = 24, seed: int = 7,
                      rows_per_cell: int = 100_000) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to ``rows``.

    ``rows`` should be narrow and cheap to read again; ``keys`` are the columns
    that identify a row. Shard sizes differ by one at most.
    """
    spark = rows.sparkSession
    n = rows.count()
    cells = min(MOST_CELLS, max(16, math.ceil(n / rows_per_cell)))
    hashed = lambda salt: F.xxhash64(F.lit(seed * 31 + salt), *keys)
    dealt = rows.withColumn("_cell", F.pmod(hashed(1), F.lit(cells)).cast("int"))
    counts = {r["_cell"]: r["n"] for r in dealt.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    shards = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts.get(i, 0) for i in range(cells)], shards, seed)
    upto = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(matrix.cumsum(axis=1))],
                                 "_cell int, _upto array<bigint>")
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(hashed(2), *keys))
    placed = (dealt.withColumn("_rank", rank).join(upto, "_cell")
              .withColumn("shard", F.size(F.filter("_upto", lambda u: u < F.col("_rank"))))
              .withColumn("_order", hashed(3)))
    bits = max(0, math.ceil(math.log2(max(1, n / n_shards / rows_per_cell))))
    part = F.shiftrightunsigned(F.col("_order"), 64 - bits) if bits else F.lit(0).cast("long")
    placed = placed.withColumn("_part", part).drop("_cell", "_upto", "_rank")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
               .select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(F.shiftrightunsigned("_order", 1), "_order", *keys))
    return (placed.join(offsets, ["shard", "_part"]).withColumn("slot", F.col("_offset") + within - 1)
            .drop("_part", "_order", "_offset"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows with ``shard`` and ``slot`` as one folder per shard, each file in slot order."""
    (rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def document_shards(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """Shard and slot of every document, with its size in bytes and the CRC of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stash(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                             F.crc32(text).cast("long").alias("text_crc32")), "rows")
    return (shuffle_to_shards(rows, ["doc_id", "size", "text_crc32"], n_shards, seed)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
