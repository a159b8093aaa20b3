"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Each model is a logistic regression
on words and word beginnings; from the second on it also sees the probabilities of all
earlier categories. In training those are out-of-fold predictions, so that no
model learns from probabilities fitted on its own rows.

The labels know toxic or not. The categories before the last, ``insult`` and
``contempt``, are weak labels: a toxic row that holds a word of the category. The
last category is the label itself and gives the verdict.

Features are words and the first 3 to 6 bytes of longer words, so that rare words
of one stem count together. They are chosen on the fit sample (at most ``sample``
labelled rows, smallest seeded hashes of the id) by the standardised difference of
their shares in toxic and clean rows of one language: at most ``words`` in each, and
``MOST`` x ``words`` in all, taken in turns. Languages without both labels are pooled.
Every document is scored, by its whole text.

The verdict's cut is the one of best F-measure with precision weighted double on the
out-of-fold scores of the last model, drawn towards 0.5 as by ``PRIOR`` further toxic
rows (few rows don't show how high clean text scores), unless ``cut`` gives it.

Defined cases: null or empty text has no words and a score; null labels are
skipped; without both labels in the sample every probability is 0 and nothing is
toxic; repeated rows score alike; an empty table gives no rows; extra columns
take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import chunks, lowered, span_hashes, word_spans

ship(__name__)

# Words that mark a row of toxic label as one of the category.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "fool", "dumb", "loser", "clown", "imbecile", "jerk"),
    "contempt": ("trash", "worthless", "scum", "garbage", "pathetic", "disgusting", "vermin", "filth"),
}
#: Bytes of word beginnings.
BEGINNINGS = (3, 4, 5, 6)
#: Features of all languages together, in units of ``words``.
MOST = 8
#: Least standardised difference of a feature.
LEAST = 2.0
#: Toxic rows that a cut of 0.5 counts for.
PRIOR = 20
_LETTER = np.zeros(256, bool)
_LETTER[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def word_hashes(words: tuple[str, ...] | list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.cumsum([0, *(len(w.encode()) for w in words)])
    return span_hashes(data, at[:-1], at[1:])


def token_hashes(data: np.ndarray, offsets: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each token (runs of letters and digits, A-Z lowered) and of its beginnings, and their number by text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    spaced = np.where(_LETTER[data], lowered(data), 32).astype(np.uint8)
    starts, ends, first = word_spans(spaced, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    longer = [np.flatnonzero(ends - starts > k) for k in beginnings]
    every = np.concatenate([np.arange(len(starts)), *longer])
    to = np.concatenate([ends, *(starts[own] + k for own, k in zip(longer, beginnings, strict=True))])
    return span_hashes(spaced, starts[every], to), doc[every], np.bincount(doc[every], minlength=n)


def word_features(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """By text: 1 for each chosen feature (sorted hashes) it holds, their share of all features, and a constant."""
    hashes, doc, count = token_hashes(data, offsets, BEGINNINGS)
    n = len(offsets) - 1
    out = np.zeros((n, len(chosen) + 2))
    out[:, -1] = 1
    if len(hashes) and len(chosen):
        at = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
        hit = chosen[at] == hashes
        out[doc[hit], at[hit]] = 1
        out[:, -2] = np.sqrt(np.bincount(doc[hit], minlength=n) / np.maximum(count, 1))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 12, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of ridge-penalised logistic regression by Newton steps; the last column is the intercept."""
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        slope, bend = -penalty * w, np.diag(penalty)
        for at in range(0, len(x), 2048):  # in blocks, so that no copy of all rows is held
            own = x[at:at + 2048].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            slope += own.T @ (y[at:at + 2048] - p)
            half = x[at:at + 2048] * np.sqrt(p * (1 - p)).astype(x.dtype)[:, None]
            bend += half.T @ half
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))


@dataclass
class Chain:
    chosen: np.ndarray
    weights: list[np.ndarray]
    cut: float


def fit_chain(x: np.ndarray, targets: list[np.ndarray], folds: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One model per category; later ones get out-of-fold probabilities of earlier ones, placed before the constant.

    Also the out-of-fold probabilities of the last.
    """
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(x)) % folds
    models = []
    for y in targets:
        models.append(fit_logistic(x, y))
        out = np.zeros(len(x))
        for k in range(folds):
            held = fold == k
            out[held] = probability(x[held], fit_logistic(x[~held], y[~held], start=models[-1]))
        x = np.column_stack([x[:, :-1], out.astype(x.dtype), x[:, -1]])
    return models, out


def best_cut(scores: np.ndarray, labels: np.ndarray, beta: float = 0.5) -> float:
    """The middle between the score of greatest F-measure, above which rows are positive, and the next one below."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    last = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # rows of equal score go together
    f = (1 + beta ** 2) * hits[last] / (last + 1 + beta ** 2 * labels.sum())
    at = last[int(f.argmax())]
    return float(s[at] + s[at + 1]) / 2 if at + 1 < len(s) else float(s[at])


def chain_probabilities(x: np.ndarray, models: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for w in models:
        out.append(probability(x, w))
        x = np.column_stack([x[:, :-1], out[-1], x[:, -1]])
    return out


def _fit(docs: DataFrame, labels: DataFrame, sample: int, words: int, folds: int, seed: int) -> Chain | None:
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label")).distinct()
    chosen_ids = ids.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id", "label").limit(sample)
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(chosen_ids), F.col("doc_id") == F.col("_id"))
    known: dict[str, list[int]] = {}
    for r in rows.groupBy("lang", "label").agg(F.count("*").alias("n")).collect():
        known.setdefault(r["lang"], [0, 0])[r["label"]] = r["n"]
    if not all(map(sum, zip(*known.values(), strict=True))) or not known:
        return None
    # Rows of each language with both labels; of all others together under a null language.
    total = [(k, *v) for k, v in known.items() if all(v)]
    rest = [v for v in known.values() if not all(v)]
    if rest and all(map(sum, zip(*rest, strict=True))):
        total.append((None, *map(sum, zip(*rest, strict=True))))
    own = F.when(F.col("lang").isin([k for k, *_ in total if k is not None]), F.col("lang"))
    rows = rows.withColumn("lang", own)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                hashes, doc, _ = token_hashes(data, offsets, BEGINNINGS)
                order = np.lexsort((hashes, doc))
                h, d = hashes[order].view(np.int64), doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                label = np.asarray(batch.column(0).slice(at, to - at).to_pylist(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(label[d[new]]),
                                                      batch.column(2).slice(at, to - at).take(pa.array(d[new]))], ["h", "label", "lang"])
    held = rows.select("label", "text", "lang").mapInArrow(tokens, "h long, label int, lang string")
    sizes = docs.sparkSession.createDataFrame(total, "of string, clean long, toxic long")
    share = F.col("n") / (F.col("clean") + F.col("toxic"))
    lead = ((F.col("hits") / F.col("toxic") - (F.col("n") - F.col("hits")) / F.col("clean"))
            / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / F.col("toxic") + 1 / F.col("clean"))))
    ranked = (held.groupBy("lang", "h").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).where("hits >= 3")
              .join(F.broadcast(sizes), F.col("lang").eqNullSafe(F.col("of"))).select("lang", "h", lead.alias("lead")).where(F.col("lead") > LEAST)
              .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("lead"), "h"))).where(F.col("at") <= words)
              .groupBy("h").agg(F.min("at").alias("at"), F.max("lead").alias("lead"))
              .orderBy("at", F.desc("lead"), "h").limit(MOST * words).collect())
    chosen = np.sort(np.array([r["h"] for r in ranked], np.int64).view(np.uint64))
    lists = {k: word_hashes(v) for k, v in CATEGORIES.items()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                f = word_features(data, offsets, chosen)
                hashes, doc, _ = token_hashes(data, offsets)
                weak = [np.bincount(doc[np.isin(hashes, w)], minlength=to - at) > 0 for w in lists.values()]
                places = [np.flatnonzero(r).tolist() for r in f[:, :-2]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(places, pa.list_(pa.int32())), pa.array(f[:, -2]),
                     pa.array(np.stack(weak, axis=1).tolist(), pa.list_(pa.bool_()))], ["label", "at", "share", "weak"])
    fit = rows.select("label", "text").mapInArrow(features, "label int, at array<int>, share double, weak array<boolean>").collect()
    fit.sort(key=lambda r: (r["at"], r["share"], r["label"], r["weak"]))
    x = np.zeros((len(fit), len(chosen) + 2), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(fit):
        x[i, r["at"]] = 1
        x[i, -2] = r["share"]
    toxic = np.array([r["label"] for r in fit], float)
    weak = [toxic * np.array([r["weak"][k] for r in fit]) for k in range(len(lists))]
    models, out = fit_chain(x, [*weak, toxic], folds, seed)
    n = toxic.sum()
    return Chain(chosen, models, (n * best_cut(out, toxic) + PRIOR * 0.5) / (n + PRIOR))


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float | None = None, sample: int = 20_000, words: int = 200, folds: int = 5,
                    seed: int = 13) -> DataFrame:
    """Every document with a probability for each category, score (the last one) and toxic."""
    model = _fit(docs, labels, sample, words, folds, seed)
    names = [*CATEGORIES, "score"]
    if cut is None:
        cut = 0.5 if model is None else model.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                p = ([np.zeros(to - at)] * len(names) if model is None
                     else chain_probabilities(word_features(data, offsets, model.chosen), model.weights))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *map(pa.array, p)], ["doc_id", *names])
    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
    return scored.select("doc_id", *[F.col(n).alias(f"p_{n}") for n in CATEGORIES], "score", (F.col("score") >= cut).alias("toxic"))
