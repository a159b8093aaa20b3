"""The registered queries of the subpackage, one per operator, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import load_tokens, token_report
from .common import documents, labels
from .hard_negatives import hard_negatives, relabelled
from .learned_search import nearest
from .lexical_search import ranked_documents
from .line_dedup import line_report
from .mixing import mixed
from .near_dedup import near_duplicates
from .pairwise_quality import quality_scores
from .pieces import encode_documents, load_pieces
from .quality_rules import quality_rules
from .secrets import secret_report
from .sharding import document_shards
from .toxicity import toxicity_scores

#: Where the public piece model lies.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Where the public ranks of the byte-level merges lie.
BYTE_RANKS = os.environ.get("BYTE_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), width=2, percent=80)


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(documents(spark, folder)).drop("times", "source")


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder))


@query
def op4_pairwise_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(documents(spark, folder), labels(spark, folder))


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(documents(spark, folder))


SQL["op5_line_dedup"] = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT a.*, c.k IS NOT NULL AND a.doc_id <> c.keeper AS gone FROM keyed a LEFT JOIN common c ON a.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(documents(spark, folder), load_pieces(PIECE_MODEL))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(documents(spark, folder), labels(spark, folder))


@query
def op8_learned_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return document_shards(documents(spark, folder))


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(documents(spark, folder))


@query
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_report(documents(spark, folder), load_tokens(BYTE_RANKS))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(relabelled(spark.read.parquet(f"{folder}/embeddings.parquet")), F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_documents(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


SQL["op13_lexical_search"] = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
whole AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS len FROM sizes),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term, total),
scores AS (SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * total) // len))))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
