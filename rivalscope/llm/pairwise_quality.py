"""Quality scores learned from preference pairs (Bradley-Terry).

A document of label 1 is preferred to one of label 0. The chance that it wins is
the logistic function of the difference of their scores, and a score is linear in
the features of the text. So the model is logistic regression on feature
differences without intercept, fitted by Newton steps on seeded pairs.

The cut between good and bad is the quantile of the scores in the fit sample that
classes it best. Scores are shifted so that the cut has the value ``cut_at`` after
the logistic function: 0 to 1, higher is better.

The fit sample holds at most ``sample`` labelled rows (smallest seeded hashes of
the id), outside the held-out ids. Every document is scored, by its whole text.

Defined cases: null or empty text has features of zero and a score; null labels
are skipped; without both labels in the sample every score is one half; a
document with several labels gives a row for each to the fit; repeated rows score alike; an empty
table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import chunks, lowered, mix, span_hashes, word_spans

ship(__name__)

# Frequent words of the four languages.
FREQUENT = ("the of and to in a is that it for on was as with be by are this at from der die und den von zu das mit sich des auf ist im dem "
            "nicht ein eine de la le et les en un du une que est pour qui dans par el los se del las por con su para al y").split()
FEATURES = ("log_words", "few_words", "mean_length", "symbols", "bars", "exclaims", "upper", "digits", "marks", "frequent",
            "repeated_windows", "repeated_lines", "distinct_words", "beyond_ascii", "words_per_line")
_CLASS = np.zeros((256, 7), np.int32)
for _k, _bytes in enumerate((b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?'\"()-", bytes(range(192, 256)))):
    _CLASS[list(_bytes), _k] = 1


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by text; ``first`` has the first value of each text and the end."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes by text."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n).astype(np.float64)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        out[:, 1] = 1
        return out
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(first))
    size = np.maximum(np.diff(offsets), 1)
    low = lowered(data)
    hashes = span_hashes(low, starts, ends)
    kinds = np.stack([_per_text(_CLASS[data, k], offsets) for k in range(_CLASS.shape[1])], axis=1) / size[:, None]
    at_least = np.maximum(words, 1)
    joined = "".join(FREQUENT).encode()
    bounds = np.cumsum([0, *map(len, FREQUENT)])
    frequent = np.isin(hashes, span_hashes(np.frombuffer(joined, np.uint8), bounds[:-1], bounds[1:]))
    out[:, 0] = np.log1p(words)
    out[:, 1] = words < 20
    out[:, 2] = np.minimum(_per_text((ends - starts).astype(np.float64), first) / at_least, 40)
    out[:, 3:9] = kinds[:, :6]
    out[:, 9] = _per_text(frequent, first) / at_least
    if len(hashes) > 2:
        with np.errstate(over="ignore"):
            windows = mix(hashes[:-2] * np.uint64(3) + mix(hashes[1:-1]) * np.uint64(5) + hashes[2:])
        same = doc[:-2] == doc[2:]
        n_windows = np.bincount(doc[:-2][same], minlength=n).astype(np.float64)
        out[:, 10] = 1 - _distinct(doc[:-2][same], windows[same], n) / np.maximum(n_windows, 1)
        out[:, 10] *= n_windows > 0
    out[:, 12] = _distinct(doc, hashes, n) / at_least
    breaks = np.flatnonzero(data == 10)
    line_from = np.union1d(offsets[:-1][offsets[:-1] < len(data)], breaks + 1)
    line_from = line_from[line_from < len(data)]
    line_to = np.append(line_from[1:], len(data))
    line_to = np.where(data[line_to - 1] == 10, line_to - 1, line_to)
    owner = np.searchsorted(offsets, line_from, "right") - 1
    filled = line_to - line_from > 1
    owner, line_hash = owner[filled], span_hashes(low, line_from[filled], line_to[filled])
    lines = np.bincount(owner, minlength=n).astype(np.float64)
    out[:, 11] = np.where(lines > 0, 1 - _distinct(owner, line_hash, n) / np.maximum(lines, 1), 0)
    out[:, 13] = kinds[:, 6]
    out[:, 14] = np.log1p(words / np.maximum(lines, 1))
    return out


@dataclass
class Ranker:
    weights: np.ndarray
    shift: float


def fit_pairs(features: np.ndarray, labels: np.ndarray, cut_at: float, pairs: int, seed: int, ridge: float = 1e-2) -> Ranker | None:
    """Weights by Newton steps on sampled pairs of a preferred and another document."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return None
    spread = features.std(axis=0)
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0)
    rng = np.random.default_rng(seed)
    d = (features[rng.choice(good, pairs)] - features[rng.choice(bad, pairs)]) * scale
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope = d.T @ (1 - p) / pairs - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    weights = w * scale
    scores = features @ weights
    order = np.sort(scores)
    best, cut = -1, 0.0
    for q in np.arange(0, 1.0, 0.0025):  # the quantile that classes the sample best
        c = order[min(int(q * len(order)), len(order) - 1)]
        right = int(((scores >= c) == (labels == 1)).sum())
        if right > best:
            best, cut = right, float(c)
    return Ranker(weights, float(np.log(cut_at / (1 - cut_at)) - cut))


def scores_of(model: Ranker | None, features: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(features), 0.5)
    return 1 / (1 + np.exp(-np.clip(features @ model.weights + model.shift, -700, 700)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled rows outside the held-out ids."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = rows.distinct().orderBy(F.xxhash64(F.lit(seed), "_id"), "_id", "label").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                f = text_features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at),
                                                  pa.array(list(f), pa.list_(pa.float64()))], ["doc_id", "label", "f"])
    return rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, f array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, cut_at: float = 0.3, sample: int = 20_000, pairs: int = 100_000,
                   seed: int = 3) -> DataFrame:
    """Every document with held_out, score and predicted (1 at or above ``cut_at``)."""
    fit = sorted(_featured(fit_sample(docs, labels, "quality", sample, seed)).collect(), key=lambda r: (r["doc_id"], r["label"], r["f"]))
    model = fit_pairs(np.array([r["f"] for r in fit]).reshape(len(fit), len(FEATURES)), np.array([r["label"] for r in fit]), cut_at, pairs, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(scores_of(model, text_features(data, offsets)))], ["doc_id", "score"])
    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))
