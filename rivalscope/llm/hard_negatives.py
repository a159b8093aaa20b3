"""Hard negatives of anchors: near vectors of another label, found with bounds from segment summaries.

1. Components become whole numbers, so scores are exact integers. Each vector is
   cut in segments, and each segment in halves again; a row keeps the mean and the
   deviation (the length of what the mean leaves) of every segment of every level.
2. The inner product over a segment of n components is n times the product of the
   means, give or take the product of the deviations. Summed over the segments of a
   level this bounds a score from both sides, and the next level bounds it closer.
3. Anchors meet rows in blocks. A block goes through the levels, coarsest first,
   and keeps the rows that some anchor may still need: their upper bound reaches the
   worst score it holds, or the band below its positives, and their lower bound is
   not above its best positive. Only rows that pass all levels are scored.

First the positives are searched in the blocks of the anchor's own label, then the
negatives of all positives of an anchor in the blocks of all rows. A block returns the few
best for each anchor or positive; these are ranked again over all blocks.

Defined cases: rows with a null label, vector, id or component, or a component that
is not finite, take no part; nor do vectors whose squared length leaves 62 bits, as
their scores might leave 64; vectors meet those of their own length only, and vectors
without components score 0; equal rows count once, rows that share an id but differ are rows of their own;
a positive with a score below 0 has no negatives, as its band is empty; fewer
than asked give all; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import stash

ship(__name__)

#: Rows, and anchors, that meet in one task.
BLOCK = 20_000
#: Rows that go through the levels at once, and anchors likewise.
ROWS_AT_ONCE = 2_048
ANCHORS_AT_ONCE = 128
#: Fewest components of a segment.
SMALLEST = 4
LOW = -(1 << 62)


# ------------------------------------------------------------------ summaries

def segment_edges(width: int) -> list[np.ndarray]:
    """For each level, where its segments begin and end; each level halves the segments of the one before."""
    edges, out = np.array([0, width]), []
    while width and (len(out) == 0 or np.diff(edges).min() >= SMALLEST):
        out.append(edges)
        edges = np.unique(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))
    return out


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, level after level, for each row of whole numbers."""
    x = x.astype(np.float64)
    means, deviations = [np.zeros((len(x), 0))], [np.zeros((len(x), 0))]
    for edges in segment_edges(x.shape[1]):
        n = np.diff(edges)
        mean = np.add.reduceat(x, edges[:-1], axis=1) / n
        rest = x - np.repeat(mean, n, axis=1)
        means.append(mean)
        deviations.append(np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1)))
    return np.concatenate(means, axis=1), np.concatenate(deviations, axis=1)


def prepare(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, width, v, means, deviations) of the rows that take part, written down."""
    kind = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 2.0 ** 31)))
    whole = rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256.0).cast("long")).alias("v"))
    # Squared length below 2^62: any score then fits 64 bits.
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = whole.where(length < 2.0 ** 62).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            width = frame["v"].map(len)
            for w, own in frame.groupby(width, sort=False):
                x = np.stack(own["v"].to_numpy()) if w else np.zeros((len(own), 0), np.int64)
                means, deviations = summaries(x)
                yield own.assign(width=np.int32(w), means=list(means), deviations=list(deviations))
    made = whole.mapInPandas(run, f"vec_id long, label {kind}, v array<long>, width int, means array<double>, deviations array<double>")
    return stash(made.withColumn("row", F.monotonically_increasing_id()), "summaries")


# ------------------------------------------------------------------ bounded scoring inside a block

class Side:
    """Vectors of one length with their summaries scaled so that bounds are sums of products."""

    def __init__(self, frame: pd.DataFrame):
        width = int(frame["width"].iloc[0])
        self.x = np.stack(frame["v"].to_numpy()).astype(np.int64) if width else np.zeros((len(frame), 0), np.int64)
        self.row = frame["row"].to_numpy(np.int64)
        self.vec_id = frame["vec_id"].to_numpy(np.int64)
        self.label = frame["label"].to_numpy()
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        if width:
            means, deviations, at = np.stack(frame["means"].to_numpy()), np.stack(frame["deviations"].to_numpy()), 0
            for edges in segment_edges(width):
                n = len(edges) - 1
                self.levels.append((means[:, at:at + n] * np.sqrt(np.diff(edges)), deviations[:, at:at + n]))
                at += n


def exact_scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products; by doubles where all sums are exact in them."""
    if largest < 2.0 ** 52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def needed_scores(anchors: Side, a: np.ndarray, rows: Side, b: np.ndarray, least: np.ndarray, most: np.ndarray,
                  apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``b`` that some anchor of ``a`` may need, their exact scores, and which pairs are within the bounds.

    ``least`` and ``most`` are the scores between which an anchor needs a row; ``apart``: pairs allowed at all.
    """
    ok = np.ones((len(a), len(b)), bool) if apart is None else apart
    slack = 1e-9 * np.outer(anchors.norm[a], rows.norm[b]) + 0.5
    least, most = least.astype(np.float64)[:, None], most.astype(np.float64)[:, None]
    for (mean_a, rest_a), (mean_b, rest_b) in zip(anchors.levels, rows.levels, strict=True):
        middle, reach = mean_a[a] @ mean_b[b].T, rest_a[a] @ rest_b[b].T + slack
        ok = ok & (middle + reach >= least) & (middle - reach <= most)
        own = ok.any(axis=0)
        if not own.all():
            b, ok, slack = b[own], ok[:, own], slack[:, own]
        if not len(b):
            break
    largest = float(anchors.norm[a].max(initial=0) * rows.norm[b].max(initial=0))
    return b, exact_scores(anchors.x[a], rows.x[b], largest), ok


def _ranked(score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: greater score, then smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        few = np.flatnonzero(score >= edge)
        return few[np.lexsort((row[few], vec_id[few], -score[few]))[:k]]
    return np.lexsort((row, vec_id, -score))[:k]


def best_positives(k: int) -> Callable:
    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` best other rows of one block for each anchor."""
        out: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            anchors, rows = Side(left), Side(right)
            for a0 in range(0, len(anchors.row), ANCHORS_AT_ONCE):
                a = np.arange(a0, min(a0 + ANCHORS_AT_ONCE, len(anchors.row)))
                held = [(np.zeros(0, np.int64),) * 3 for _ in a]
                least, most = np.full(len(a), LOW), np.full(len(a), 1 << 62)
                for b0 in range(0, len(rows.row), ROWS_AT_ONCE):
                    b = np.arange(b0, min(b0 + ROWS_AT_ONCE, len(rows.row)))
                    b, scores, ok = needed_scores(anchors, a, rows, b, least, most)
                    for i, anchor in enumerate(a):
                        own = np.flatnonzero(ok[i] & (scores[i] >= least[i]) & (rows.row[b] != anchors.row[anchor]))
                        if not len(own):
                            continue
                        s, v, r = (np.concatenate(p) for p in zip(held[i], (scores[i, own], rows.vec_id[b[own]], rows.row[b[own]])))
                        top = _ranked(s, v, r, k)
                        held[i] = s[top], v[top], r[top]
                        if len(top) == k:
                            least[i] = s[top[-1]]
                out += [(int(anchors.row[anchor]), int(v), int(r), int(s)) for anchor, h in zip(a, held) for s, v, r in zip(*h)]
        return pd.DataFrame(out, columns=["anchor", "vec_id", "row", "score"]).astype("int64")
    return best


def best_negatives(k: int) -> Callable:
    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` best rows of another label in one block for each positive of each anchor, within its band."""
        out: list[tuple[int, int, int, int, int]] = []
        if len(left) and len(right):
            anchors, rows = Side(left), Side(right)
            caps = [np.array(c, np.int64) for c in left["scores"]]
            floors = [np.array([-((-4 * int(c)) // 5) for c in own], np.int64) for own in caps]  # 80 p <= 100 n
            for a0 in range(0, len(anchors.row), ANCHORS_AT_ONCE):
                a = np.arange(a0, min(a0 + ANCHORS_AT_ONCE, len(anchors.row)))
                held = [[(np.zeros(0, np.int64),) * 3 for _ in caps[i]] for i in a]
                bar = [floors[i].copy() for i in a]
                least, most = np.array([x.min() for x in bar]), np.array([caps[i].max() for i in a])
                for b0 in range(0, len(rows.row), ROWS_AT_ONCE):
                    b = np.arange(b0, min(b0 + ROWS_AT_ONCE, len(rows.row)))
                    apart = anchors.label[a][:, None] != rows.label[b][None, :]
                    b, scores, ok = needed_scores(anchors, a, rows, b, least, most, apart)
                    for i, anchor in enumerate(a):
                        near = np.flatnonzero(ok[i] & (scores[i] >= least[i]) & (scores[i] <= most[i]))
                        if not len(near):
                            continue
                        s0, v0, r0 = scores[i, near], rows.vec_id[b[near]], rows.row[b[near]]
                        for j, cap in enumerate(caps[anchor]):
                            own = (s0 <= cap) & (s0 >= bar[i][j])
                            if own.any():
                                s, v, r = (np.concatenate(p) for p in zip(held[i][j], (s0[own], v0[own], r0[own])))
                                top = _ranked(s, v, r, k)
                                held[i][j] = s[top], v[top], r[top]
                                if len(top) == k:
                                    bar[i][j] = max(bar[i][j], s[top[-1]])
                        least[i] = bar[i].min()
                out += [(int(anchors.row[anchor]), j, int(v), int(r), int(s))
                        for anchor, slots in zip(a, held) for j, h in enumerate(slots) for s, v, r in zip(*h)]
        return pd.DataFrame(out, columns=["anchor", "place", "vec_id", "row", "score"]).astype("int64")
    return best


# ------------------------------------------------------------------ blocks

def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], block: int):
    """Anchors and rows grouped so that each anchor meets each row of its keys in one task, ``block`` of each side at most on average."""
    sides = (rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
             .join(anchors.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("turns")), keys))

    def cell(own: Column) -> Column:
        return F.pmod(F.xxhash64("row"), own).cast("int")

    def each(other: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), other - 1))
    left = anchors.join(sides, keys).withColumns({"turn": cell(F.col("turns"))}).withColumn("block", each(F.col("blocks")))
    right = rows.join(sides, keys).withColumns({"block": cell(F.col("blocks"))}).withColumn("turn", each(F.col("turns")))
    cells = [*keys, "block", "turn"]
    return left.drop("blocks", "turns").groupBy(*cells).cogroup(right.drop("blocks", "turns").groupBy(*cells))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' positives.

    ``is_anchor`` is a condition on vec_id.
    """
    rows = prepare(vectors)
    anchors = rows.where(is_anchor).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own beside the rows'
    found = _met(anchors, rows, ["width", "label"], block).applyInPandas(
        best_positives(positives), "anchor long, vec_id long, row long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # A positive below 0 has an empty band.
    chosen = stash(ranked.where("score >= 0").groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("vec_id").alias("positive_id"), "score"))).alias("positives")), "positives")
    asked = anchors.join(chosen.select(F.col("anchor").alias("row"), F.col("positives.score").alias("scores")), "row")
    near = _met(asked, rows, ["width"], block).applyInPandas(
        best_negatives(negatives), "anchor long, place long, vec_id long, row long, score long")
    last = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
    best = near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")).join(chosen, "anchor")
    return best.join(named, "anchor").withColumn("p", F.get("positives", F.col("place").cast("int"))).select(
        "anchor_id", F.col("p.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, the label is the next of ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long"))
