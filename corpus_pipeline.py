"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
``docs``; the last returns encoded documents. Rows that share a doc_id share
their fate. Extra columns of ``docs`` are carried along; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalscope.llm.common import documents, stash
from rivalscope.llm.line_dedup import apply_bitmaps, keep_bitmaps
from rivalscope.llm.mixing import take_mix
from rivalscope.llm.near_dedup import near_duplicates
from rivalscope.llm.pieces import encode_documents, load_pieces
from rivalscope.llm.quality_rules import quality_rules
from rivalscope.llm.queries import PIECE_MODEL


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``, null being a value."""
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's distributions."""
    return _only(docs, quality_rules(docs).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them; ``n_chars`` follows the text."""
    cut = apply_bitmaps(docs, keep_bitmaps(docs))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else cut


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return _only(docs, near_duplicates(docs, width=5, percent=80).where("kept"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take_mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the scores and changes of its next best segmentations."""
    return encode_documents(docs, load_pieces(PIECE_MODEL))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixture), ("pieces", pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
