"""Ranked lexical search: posting lists in geometric blocks, exact best documents.

1. One pass over the documents keeps each document's number of terms and its
   counts of asked terms (the forward form). Document frequencies, weights and the
   mean length come from that table.
2. Documents are range-sorted by two minimum hashes of their terms, so that similar
   ones lie together, and dealt to cells of bounded size. In a cell each term has a
   posting list. A list is cut in blocks by similarity: some of its documents are
   centres, every other joins the centre of greatest inner product. A block keeps
   the coordinatewise maximum of its documents: for each term, the greatest
   contribution that one of them makes. Blocks are made when a list is first opened
   and kept for all items.
3. An item goes through its terms from the rarest on. A document is found in the
   list of its first term in that order, so what later lists can still add is
   bounded by the sum of the later terms' greatest contributions; when that sum
   falls below the score to beat, all later lists are left closed. In an open list a
   block is skipped only if the item's product with its summary falls below that
   score; the documents of other blocks are scored in full from their forward form.

The score to beat is the last of the best so far, carried from cell to cell of a
task; it starts with that of a sample of the documents. The best of all tasks are
ranked again. All sums are whole numbers, so bounds and results are exact.

Items are asked in passes of about ``TERMS_AT_ONCE`` terms, whose vocabulary and
weights are the only things broadcast. Terms are told apart by 64-bit hashes.

Defined cases: null or empty texts hold no term and match nothing; repeated document
rows are documents of their own; equal item rows are asked once; null document ids
come last among equal scores; fewer matches than ``k`` are all returned; empty
tables give no rows; extra columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import chunks, lowered, mix, span_hashes, stash, word_spans

ship(__name__)

#: Terms of items that one pass asks for, about.
TERMS_AT_ONCE = 200_000
#: Documents of a cell, documents of a task, documents of a block (about).
CELL, TASK, BLOCK = 2_048, 8_192, 32
#: One document in so many gives the first score to beat.
SEED_SHARE = 32
_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _TERM[_low:_high + 1] = True
_LAST = np.iinfo(np.int64).max


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of some texts in a row, and the first term of each text (and the end)."""
    data = np.where(_TERM[data], lowered(data), np.uint8(32))
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends).view(np.int64), first


# ------------------------------------------------------------------ items

def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): distinct terms of each distinct item, written down."""
    rows = items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("text")):
                terms, first = term_hashes(data, offsets)
                for k in range(to - at):
                    own, times = np.unique(terms[first[k]:first[k + 1]], return_counts=True)
                    place = pa.array(np.full(len(own), at + k))
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(place), batch.column("item_id").take(place), pa.array(own),
                                                      pa.array(times.astype(np.int64))], ["item", "item_id", "term", "times"])
    kind = rows.schema["item_id"].dataType.simpleString()
    return stash(rows.mapInArrow(run, f"item long, item_id {kind}, term long, times long"), "items")


# ------------------------------------------------------------------ forward form

def forward(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, times, sign1, sign2): terms are places in the sorted ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        signs = [mix(asked.view(np.uint64) ^ np.uint64(seed)).view(np.int64) for seed in (0x51, 0xA7)]
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("text")):
                terms, first = term_hashes(data, offsets)
                place = np.minimum(np.searchsorted(asked, terms), len(asked) - 1)
                own = np.flatnonzero(asked[place] == terms)
                text = np.searchsorted(first, own, "right") - 1
                pair, times = np.unique(text * len(asked) + place[own], return_counts=True)
                term = pair % len(asked)
                bounds = np.searchsorted(pair // len(asked), np.arange(to - at + 1)).astype(np.int32)
                least = []
                for sign in signs:
                    low = np.full(to - at, _LAST)
                    some = np.flatnonzero(np.diff(bounds))
                    if len(some):
                        low[some] = np.minimum.reduceat(sign[term], bounds[some])
                    least.append(pa.array(low))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))), *least],
                    ["doc_id", "n", "terms", "times", "sign1", "sign2"])
    made = docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, times array<int>, sign1 long, sign2 long")
    return stash(made, "forward")


# ------------------------------------------------------------------ cells

def impacts(times: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What one occurrence weight is multiplied with: grows with the count, shrinks with the document's length."""
    m = 100 - 25 + (25 * n * total) // max(length, 1)
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


class Cell:
    """Some documents: forward form, posting lists, and the lists' blocks with their summaries as far as they were opened."""

    def __init__(self, first: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.first, self.term, self.impact = first, term, impact
        order = np.argsort(term, kind="stable")
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[order]
        self.listed, at = np.unique(term[order], return_index=True)
        self.bounds = np.append(at, len(order))
        self.greatest = np.maximum.reduceat(impact[order], at) if len(at) else np.zeros(0, np.int64)
        self.opened: dict[int, tuple[np.ndarray, ...]] = {}

    def entries(self, docs: np.ndarray, from_term: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some documents, and the first of each; with ``from_term`` only entries of that term or later ones."""
        size = np.diff(self.first)[docs]
        at = np.repeat(self.first[docs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if from_term < 0:
            return at, np.cumsum(size) - size
        keep = self.term[at] >= from_term  # never leaves a document of the term's list empty
        count = np.add.reduceat(keep, np.cumsum(size) - size)
        return at[keep], np.cumsum(count) - count

    def blocks(self, k: int) -> tuple[np.ndarray, ...]:
        """Documents of the k-th list by block, first document of each block, and the summaries: first coordinate of each block, terms, maxima."""
        made = self.opened.get(k)
        if made is None:
            docs = self.doc[self.bounds[k]:self.bounds[k + 1]]
            at, first = self.entries(docs, int(self.listed[k]))
            near = np.zeros(len(docs), np.int64)
            if len(docs) > BLOCK:
                near = nearest_centre(self.term[at], self.impact[at], first, -(-len(docs) // BLOCK))
            order = np.argsort(near, kind="stable")
            _, start, label = np.unique(near[order], return_index=True, return_inverse=True)
            block = np.empty(len(docs), np.int64)
            block[order] = label
            size = np.diff(np.append(first, len(at)))
            key = np.repeat(block, size) * (int(self.term.max()) + 1) + self.term[at]
            by = np.argsort(key, kind="stable")
            coordinate, where = np.unique(key[by], return_index=True)
            owner, term = np.divmod(coordinate, int(self.term.max()) + 1)
            made = self.opened[k] = (docs[order], np.append(start, len(docs)), np.searchsorted(owner, np.arange(len(start))),
                                     term, np.maximum.reduceat(self.impact[at][by], where))
        return made

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at, first = self.entries(docs)
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], first)


def nearest_centre(term: np.ndarray, impact: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """For each document of a list, which of ``n`` centres, documents spread over the list, has the greatest inner product with it."""
    names, place = np.unique(term, return_inverse=True)
    size = np.diff(np.append(first, len(term)))
    value = impact.astype(np.float32)
    value /= np.repeat(np.sqrt(np.add.reduceat(value * value, first)), size)
    best, near = np.full(len(first), -1.0, np.float32), np.zeros(len(first), np.int64)
    centre = np.zeros(len(names), np.float32)
    for c, doc in enumerate(np.linspace(0, len(first) - 1, n).astype(np.int64)):
        own = slice(first[doc], first[doc] + size[doc])
        centre[place[own]] = value[own]
        alike = np.add.reduceat(centre[place] * value, first)
        near[alike > best] = c
        np.maximum(best, alike, out=best)
        centre[place[own]] = 0
    return near


class Best:
    """The ``k`` best documents of an item so far, and the score that others must reach."""

    def __init__(self, k: int, bar: int):
        self.k, self.bar = k, max(1, bar)
        self.score, self.doc, self.known = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        own = score >= self.bar
        if not own.any():
            return
        score, doc, known = (np.concatenate(p) for p in zip((self.score, self.doc, self.known), (score[own], doc[own], known[own])))
        top = np.lexsort((doc, ~known, -score))[:self.k]
        self.score, self.doc, self.known = score[top], doc[top], known[top]
        if len(top) == self.k:
            self.bar = max(self.bar, int(self.score[-1]))


def search_cell(cell: Cell, ids: np.ndarray, known: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], best: list[Best],
                weight: np.ndarray) -> int:
    """Add a cell's documents to the best of each item; returns how many were scored. ``weight``: a row of zeros, one for each term."""
    scored = 0
    for (terms, gains), top in zip(items, best, strict=True):
        place = np.minimum(np.searchsorted(cell.listed, terms), len(cell.listed) - 1)
        here = cell.listed[place] == terms
        own, gain, lists = terms[here], gains[here], place[here]
        if not len(own):
            continue
        left = np.cumsum((gain * cell.greatest[lists])[::-1])[::-1]  # what this list and later ones can give
        if left[0] < top.bar:
            continue
        weight[own] = gain
        seen = np.zeros(len(ids), bool)
        for k, most in zip(lists.tolist(), left.tolist()):
            if most < top.bar:
                break
            docs, start, first, term, greatest = cell.blocks(k)
            bound = np.add.reduceat(weight[term] * greatest, first)
            open_ = np.repeat(bound >= top.bar, np.diff(start))
            new = docs[open_ & ~seen[docs]]
            if len(new):
                seen[new] = True
                scored += len(new)
                top.add(cell.scores(new, weight), ids[new], known[new])
        weight[own] = 0
    return scored


# ------------------------------------------------------------------ search

def _searched(cells: DataFrame, shared, k: int) -> DataFrame:
    """(place, doc_id, score): the best of each partition for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        total, length, order, bars = asked["total"], asked["length"], asked["order"], asked["bars"]
        best = [Best(k, b) for b in bars]
        weight = np.zeros(len(order), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CELL):
                part = batch.slice(at, CELL)
                terms, times = part.column("terms"), part.column("times")
                first = terms.offsets.to_numpy().astype(np.int64)
                low, high = int(first[0]), int(first[-1])
                term = order[terms.values.to_numpy(zero_copy_only=False)[low:high]]
                n = np.repeat(part.column("n").to_numpy(), np.diff(first))
                impact = impacts(times.values.to_numpy(zero_copy_only=False)[low:high].astype(np.int64), n, total, length)
                ids = part.column("doc_id")
                search_cell(Cell(first - low, term, impact), ids.fill_null(_LAST).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False),
                            asked["items"], best, weight)
        for i, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.score), i)), pa.array(top.doc, pa.int64(), mask=~top.known),
                                                  pa.array(top.score)], ["place", "doc_id", "score"])
    return cells.select("doc_id", "n", "terms", "times").mapInArrow(run, "place long, doc_id long, score long")


def _one_pass(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """(place, doc_id, score, rank) for the items of one pass; ``rows``: (item, term, times) of the pass, by item."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.array([r["term"] for r in rows], np.int64))
    table = forward(docs, vocabulary)
    total, length = table.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    total, length = total or 0, length or 0
    held = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in held], np.int64)
    order = np.empty(len(vocabulary), np.int64)  # place of each term, rarest first
    order[np.lexsort((np.arange(len(vocabulary)), held))] = np.arange(len(vocabulary))
    by_item: dict[int, list] = {}
    for r in rows:
        by_item.setdefault(r["item"], []).append(r)
    items = []
    for own in by_item.values():
        place = np.searchsorted(vocabulary, np.array([r["term"] for r in own], np.int64))
        gain = weights[place] * np.array([r["times"] for r in own], np.int64)
        at = np.argsort(order[place])
        items.append((order[place][at], gain[at]))
    asked = {"items": items, "total": total, "length": length, "order": order, "bars": [1] * len(items)}
    some = table.where(F.size("terms") > 0).withColumn("own", F.monotonically_increasing_id())
    n = some.count()
    last = Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())

    def top(cells: DataFrame, shared) -> DataFrame:
        return _searched(cells, shared, k).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    # A first score to beat, from a share of the documents; all are searched afterwards.
    for r in top(some.where(F.pmod(F.xxhash64("own"), F.lit(SEED_SHARE)) == 0), spark.sparkContext.broadcast(asked)).where(F.col("rank") == k).collect():
        asked["bars"][r["place"]] = r["score"]
    parts = max(1, -(-n // TASK))
    cells = some.repartitionByRange(parts, "sign1", "sign2", "own").sortWithinPartitions("sign1", "sign2", "own")
    return top(cells, spark.sparkContext.broadcast(dict(asked)))


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    terms = item_terms(items)
    passes = max(1, -(-terms.count() // TERMS_AT_ONCE))
    out = None
    for p in range(passes):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).orderBy("item", "term").collect()
        if not rows:
            continue
        names = list(dict.fromkeys(r["item"] for r in rows))
        found = _one_pass(docs, rows, k)
        named = spark.createDataFrame(list(enumerate(names)), "place long, item long").join(terms.select("item", "item_id").distinct(), "item")
        found = found.join(named, "place").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    if out is None:
        kind = terms.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
