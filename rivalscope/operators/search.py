"""Substring search through an index of three-letter grams.

Rows hold the key, column and text of each row. Postings hold one row for each column, gram and
distinct text, so a text that many rows share is cut into grams once. A search takes the rarest
grams of its text, keeps the texts that hold all of them in one column, and confirms the rows of
these texts on the text itself. Only the index parts of the chosen grams and the confirmed rows are
read, and keys and text numbers; texts without three letters in a row scan the table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a gram.
GRAM = 3


def grams(text: Column) -> Column:
    """Distinct grams of a text in lower case; each letter is touched a fixed number of times."""
    letters = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    n = F.size(letters) - GRAM
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(*[F.get(letters, i + j) for j in range(GRAM)]))
    return F.when(n >= 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def text_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, text, text_id). Equal numbers of different texts cost a confirmation, they lose nothing."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns]))
    rows = df.select(key, each.alias("_c")).select(key, "_c.column", "_c.text").filter("text is not null")
    return rows.withColumn("text_id", F.xxhash64("text"))


def gram_index(rows: DataFrame) -> DataFrame:
    """(gram, column, text_id): postings of the distinct texts of :func:`text_rows`; nothing is grouped by gram, so a frequent one is no hot key here."""
    return (rows.select("column", "text", "text_id").distinct()
            .select(F.explode(grams(F.col("text"))).alias("gram"), "column", "text_id"))


def _part(gram: Column, parts: int) -> Column:
    return F.pmod(F.hash(gram), F.lit(parts))


def write_gram_index(df: DataFrame, key: str, columns: Sequence[str], folder: str, parts: int = 64) -> None:
    """Store the rows' texts, the postings by parts of grams, and how many postings each gram has."""
    text_rows(df, key, columns).write.mode("overwrite").parquet(f"{folder}/rows")
    (gram_index(df.sparkSession.read.parquet(f"{folder}/rows")).withColumn("part", _part(F.col("gram"), parts))
     .write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings"))
    stored = df.sparkSession.read.parquet(f"{folder}/postings")
    (stored.groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").partitionBy("part").parquet(f"{folder}/sizes"))


def pattern_grams(text: str) -> list[str]:
    """Grams that every match of an ILIKE pattern around ``text`` holds."""
    pieces = re.split(r"[%_]", text.lower())
    return list(dict.fromkeys(p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)))


def candidates(spark: SparkSession, folder: str, key: str, text: str, parts: int = 64, most: int = 4) -> DataFrame | None:
    """Keys that hold the ``most`` rarest grams of a text in one column; None where the text has no gram."""
    wanted = pattern_grams(text)
    if not wanted:
        return None

    def read(name: str, chosen: Sequence[str]) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{name}")
        here = F.lit(False)
        for g in chosen:  # literal parts prune folders
            here = here | ((F.col("part") == _part(F.lit(g), parts)) & (F.col("gram") == g))
        return rows.filter(here)

    sizes = {r["gram"]: r["n"] for r in read("sizes", wanted).collect()}  # one row a gram of the text
    if len(sizes) < len(wanted):
        return spark.read.parquet(f"{folder}/rows").filter("false").select(key)
    chosen = sorted(wanted, key=lambda g: (sizes[g], g))[:most]
    texts = (read("postings", chosen).groupBy("text_id", "column").agg(F.count_distinct("gram").alias("n"))
             .filter(F.col("n") == len(chosen)).select("text_id", "column"))
    return spark.read.parquet(f"{folder}/rows").select(key, "column", "text_id").join(texts, ["text_id", "column"], "left_semi").select(key).distinct()


def like_pattern(text: str) -> str:
    return "%" + text.replace("\\", "\\\\") + "%"


def search(df: DataFrame, folder: str, key: str, columns: Sequence[str], text: str, parts: int = 64) -> DataFrame:
    """Rows with ``text`` in one of the columns, in any case: index first, then the text itself."""
    found = candidates(df.sparkSession, folder, key, text, parts)
    rows = df if found is None else df.join(found, key, "left_semi")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(like_pattern(text)), F.lit(False))
    return rows.filter(hit)
