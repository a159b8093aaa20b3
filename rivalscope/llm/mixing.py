"""Mixing sources to target sizes by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources
(its pattern) are summed up; a flow network then routes words:

    start -> pattern (one arc per repetition, each dearer than the last)
          -> source of the pattern -> end (the source's quota)

The cheapest flow of greatest size fills the quotas with as little repetition as
it can. Networks are solved per connected group of sources, each in its own
task; a task holds patterns and sources of its group, never documents.

Documents are then picked by a seeded hash: whole repetitions first, then the
documents with the smallest hashes until the pattern's rest is used up. The cut
is found by a histogram of hashes and refined inside one cell of it, so that a
source with a third of all rows is never ordered in one task.

Defined cases: null text has size 0 and is taken 0 times; a null source is a
source of its own, ordered last; sources without words get target 0; repeated
rows are rows of their own; documents with no source are not taken; an empty
table gives no rows; extra columns don't take part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import n_words, stash, unused

ship(__name__)

#: Weights by source order, repeating.
WEIGHTS = (3, 1, 2)
#: Bits of the hash histogram that finds the cut.
CELL_BITS = 12
#: Parts that the sizes of one pattern are dealt over.
SALTS = 32


# ------------------------------------------------------------------ targets

def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    All targets share ``share`` times the words by weight. A source stops at
    ``most`` times its own size; what it leaves is shared again by weight until
    none is above. Each round reads two sums.
    """
    ranked = stash(_numbered(sizes), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    rows = ranked.select("source", "source_size", weight.cast("double").alias("weight"), (most * F.col("source_size")).alias("room"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("room")
        left = rows.agg(F.sum(F.when(full, F.col("room"))).alias("room"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
                        F.count_if(full).alias("n")).first()
        if left["n"] == capped or not left["weight"]:
            break
        capped, level = left["n"], (share * total - (left["room"] or 0.0)) / left["weight"]
    return rows.select("source", "source_size", F.least(F.col("room"), F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """Add ``n``, the place of each source by code point, null last: a range sort, then counts by sorted part."""
    key = [F.col("source").isNull(), F.col("source")]
    part = stash(sizes.orderBy(*key).withColumn("id", F.monotonically_increasing_id()), "order")
    part = part.withColumns({"part": F.shiftright("id", 33), "at": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("off"))
    return part.join(offsets, "part").select("source", "source_size", (F.col("off") + F.col("at")).alias("n"))


# ------------------------------------------------------------------ flow

def cheapest_flow(patterns: list[tuple[int, tuple[int, ...]]], quotas: list[int], repeats: int) -> dict[tuple[int, int], int]:
    """Words from each pattern to each source: successive shortest paths.

    ``patterns``: size and places of its sources in ``quotas``. Repetition ``r``
    of a word costs ``r`` (0 at first use), so total cost is convex.
    """
    start, end = 0, 1
    heads: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(quotas))]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, most: int, price: int) -> int:
        for x, y, m, c in ((a, b, most, price), (b, a, 0, -price)):
            heads[x].append(len(to))
            to.append(y)
            room.append(m)
            cost.append(c)
        return len(to) - 2

    routes: dict[tuple[int, int], int] = {}
    for i, (size, sources) in enumerate(patterns):
        for r in range(repeats):
            arc(start, 2 + i, size, r)
        for s in sources:
            routes[i, s] = arc(2 + i, 2 + len(patterns) + s, size * repeats, 0)
    for s, quota in enumerate(quotas):
        arc(2 + len(patterns) + s, end, quota, 0)
    potential = [0] * len(heads)
    while True:
        best = {start: 0}
        by: dict[int, int] = {}
        queue = [(0, start)]
        done = set()
        while queue:
            d, a = heapq.heappop(queue)
            if a in done:
                continue
            done.add(a)
            for e in heads[a]:
                if room[e] and to[e] not in done:
                    far = d + cost[e] + potential[a] - potential[to[e]]
                    if far < best.get(to[e], 1 << 60):
                        best[to[e]], by[to[e]] = far, e
                        heapq.heappush(queue, (far, to[e]))
        if end not in best:
            break
        for a in range(len(heads)):
            potential[a] += best.get(a, best[end]) if best.get(a, best[end]) < best[end] else best[end]
        step, a = 1 << 60, end
        while a != start:
            step, a = min(step, room[by[a]]), to[by[a] ^ 1]
        a = end
        while a != start:
            room[by[a]] -= step
            room[by[a] ^ 1] += step
            a = to[by[a] ^ 1]
    return {k: room[e ^ 1] for k, e in routes.items() if room[e ^ 1]}


def _solve(group: pd.DataFrame, repeats: int) -> pd.DataFrame:
    """Rows (pattern, size, sources, quotas) of one connected group: words that each pattern gives to each of its sources."""
    quotas: dict[str | None, int] = {}
    for names, amounts in zip(group["sources"], group["quotas"], strict=True):
        quotas.update(zip(names, (int(round(q)) for q in amounts), strict=True))
    order = {s: i for i, s in enumerate(sorted(quotas, key=lambda s: (s is None, s or "")))}
    rows = group.sort_values("pattern")
    flow = cheapest_flow([(int(n), tuple(order[s] for s in names)) for n, names in zip(rows["size"], rows["sources"], strict=True)],
                         [quotas[s] for s in order], repeats)
    name, patterns = list(order), rows["pattern"].tolist()
    out = [(patterns[i], name[s], n) for (i, s), n in sorted(flow.items())]
    return pd.DataFrame({"pattern": pd.Series([p for p, _, _ in out], dtype="int64"), "source": pd.Series([s for _, s, _ in out], dtype=object),
                         "words": pd.Series([n for _, _, n in out], dtype="int64")})


def _overlap(patterns: DataFrame) -> bool:
    """Whether some document has several sources."""
    return bool(patterns.where(F.size("sources") > 1).take(1))


def _groups(patterns: DataFrame) -> DataFrame:
    """(pattern, group): the smallest pattern id that shared sources reach."""
    member = stash(patterns.select("pattern", F.explode("sources").alias("source")), "member")
    label = patterns.select("pattern", F.col("pattern").alias("group"))
    if not _overlap(patterns):  # single sources: each pattern is its own group
        return label
    label = stash(label, "label")
    while True:
        low = member.join(label, "pattern").groupBy(F.col("source").alias("_source")).agg(F.min("group").alias("low"))
        new = member.join(low, F.col("source").eqNullSafe(F.col("_source"))).groupBy("pattern").agg(F.min("low").alias("group"))
        new = stash(new, "label")
        changed = new.join(label.withColumnRenamed("group", "was"), "pattern").where("group <> was").take(1)
        label = new
        if not changed:
            return label


# ------------------------------------------------------------------ selection

def mix(docs: DataFrame, members: Column, repeats: int = 2, share: float = 1.5, seed: int = 11,
        weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` (doc_id, size and more) with ``times`` each document is taken, and ``taken_for``: the source each time counts for.

    ``members`` is an array of source names. Sizes of a document count in each
    of its sources; see :func:`mixed` for single sources. The words that the flow
    sends from a pattern to a source are the next of its documents in the order of their hashes.
    """
    names = F.array_sort(F.array_distinct(members))
    # Rows alike in all that is looked at are told apart by their number.
    named = stash(docs.withColumns({"_row": F.monotonically_increasing_id(), "_sources": names, "_pattern": F.xxhash64(F.to_json(names, {"ignoreNullFields": "false"})),
                                    "_hash": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))}), "mix")
    patterns = stash(named.groupBy(F.col("_pattern").alias("pattern")).agg(
        F.sum("size").alias("size"), F.first("_sources").alias("sources")), "patterns")
    sizes = patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stash(source_targets(sizes, share, float(repeats), weights), "targets")
    quota = (patterns.select("pattern", F.explode("sources").alias("source")).alias("p")
             .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
             .groupBy("pattern").agg(F.collect_list(F.struct(F.col("p.source").alias("source"), "target")).alias("q")))
    network = (patterns.drop("sources").join(quota, "pattern").join(_groups(patterns), "pattern")
               .select("pattern", "size", "group", F.col("q.source").alias("sources"), F.col("q.target").alias("quotas")))
    flow = stash(network.groupBy("group").applyInPandas(lambda g: _solve(g, repeats), "pattern long, source string, words long"), "flow")
    used = flow.groupBy("pattern").agg(F.sum("words").alias("used"))
    plan = stash(patterns.select("pattern", "size").join(used, "pattern", "left").na.fill(0, ["used"]).select(
        "pattern", F.col("size").alias("pattern_size"), F.when(F.col("size") > 0, F.floor(F.col("used") / F.col("size"))).otherwise(0).alias("whole"),
        F.when(F.col("size") > 0, F.col("used") % F.col("size")).otherwise(F.lit(0)).alias("rest")), "plan")
    return _assigned(_picked(named, plan), named, flow, _overlap(patterns)), targets


def _cells(named: DataFrame) -> DataFrame:
    """Sizes of hash cells, and what comes before them in their pattern."""
    upto = Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return (named.groupBy(F.col("_pattern").alias("pattern"), _cell().alias("cell")).agg(F.sum("size").alias("cell_size"))
            .withColumn("before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0))))


def _cell() -> Column:
    return F.shiftrightunsigned("_hash", 64 - CELL_BITS)


def _assigned(picked: DataFrame, named: DataFrame, flow: DataFrame, overlap: bool) -> DataFrame:
    """Add ``taken_for``. A pattern's words, repetition after repetition in the order of hash cells, go to its sources one after the other."""
    if not overlap:
        return picked.withColumn("taken_for", F.array_repeat(F.get("_sources", F.lit(0)), F.col("times")))
    shares = flow.where("words > 0").groupBy(F.col("pattern").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("source", "words"))).alias("_shares"))
    upto = F.transform("_shares", lambda s, i: F.struct(s["source"].alias("source"), F.aggregate(
        F.slice("_shares", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("upto")))
    cells = _cells(named).select(F.col("pattern").alias("_at"), F.col("cell").alias("_c"), F.col("before").alias("_start"))
    rows = (picked.join(shares.withColumn("_shares", upto), F.col("_pattern") == F.col("_of"), "left")
            .join(cells, (F.col("_pattern") == F.col("_at")) & (F.col("_cell") == F.col("_c")), "left"))

    def source_of(r: Column) -> Column:
        word = r * F.col("pattern_size") + F.col("_start")
        return F.coalesce(F.get(F.filter("_shares", lambda s: s["upto"] > word), F.lit(0)), F.element_at("_shares", -1))["source"]
    each = F.transform(F.sequence(F.lit(0), F.col("times") - 1), source_of)
    return rows.withColumn("taken_for", F.when(F.col("times") > 0, each).otherwise(F.array().cast("array<string>")))


def _picked(named: DataFrame, plan: DataFrame) -> DataFrame:
    """``times`` of each document: the pattern's whole repetitions, and one more for documents before the pattern's cut."""
    cut = (_cells(named).join(plan, "pattern")
           .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("cell_size") > F.col("rest")))
           .groupBy("pattern").agg(F.min(F.struct("cell", "before")).alias("c"))
           .select("pattern", F.col("c.cell").alias("cut"), (F.col("c.before")).alias("before")))
    plan = stash(plan.join(cut, "pattern", "left"), "cut")
    placed = named.join(plan, named["_pattern"] == plan["pattern"], "left").withColumn("_cell", _cell())
    below = F.coalesce(F.col("_cell") < F.col("cut"), F.lit(False))
    edge = F.coalesce(F.col("_cell") == F.col("cut"), F.lit(False))
    # Only the documents of the cut cell are put in order.
    in_order = Window.partitionBy("_pattern").orderBy(F.shiftrightunsigned("_hash", 1), "_hash", "doc_id", "size", "_row")
    fitting = (placed.where(edge).withColumn("_sum", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_more", (F.col("before") + F.col("_sum") <= F.col("rest")).cast("int")))
    others = placed.where(~edge).withColumns({"_sum": F.lit(0).cast("long"), "_more": below.cast("int")})
    first = stash(others.unionByName(fitting), "first")
    # One more document, the one whose size is nearest to what is left, if that brings the pattern nearer.
    left = (first.groupBy("_pattern").agg(F.sum(F.col("_more") * F.col("size")).alias("taken"))
            .join(plan.select("pattern", (F.col("rest")).alias("_rest")), F.col("_pattern") == F.col("pattern"))
            .select("pattern", (F.col("_rest") - F.col("taken")).alias("left"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")))
    sizes = (first.where("_more = 0 and size > 0").groupBy("_pattern", "size")  # one document for each size of a pattern
             .agg(F.min(F.struct("_hash", "doc_id", "_row")).alias("doc")).withColumn("_part", F.pmod(F.xxhash64("size"), F.lit(SALTS)).cast("int")))
    last = (sizes.join(left, (F.col("_pattern") == left["pattern"]) & (F.col("_part") == left["part"]))
            .where(F.abs(F.col("left") - F.col("size")) < F.col("left"))
            .groupBy("_pattern").agg(F.min(F.struct(F.abs(F.col("left") - F.col("size")).alias("off"), "doc")).alias("one"))
            .select(F.col("_pattern").alias("pattern"), F.col("one.doc._row").alias("one_row")))
    extra = F.col("_row") == F.col("one_row")
    done = first.drop("pattern").join(last, F.col("_pattern") == last["pattern"], "left")
    return done.withColumn("times", (F.coalesce(F.col("whole"), F.lit(0)) + F.col("_more")
                                     + F.coalesce(extra, F.lit(False)).cast("int")).cast("int"))


def mixed(docs: DataFrame, repeats: int = 2, share: float = 1.5, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times) of documents that each belong to one source."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    picked, targets = mix(rows, F.array("source"), repeats, share, seed)
    t = targets.withColumnRenamed("source", "of")
    return (picked.join(t, F.col("source").eqNullSafe(F.col("of")), "left")
            .select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "times", "source"))


def take_mix(docs: DataFrame, repeats: int = 2, share: float = 1.5, seed: int = 11) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken; rows that share a doc_id go by the one taken most."""
    times = mixed(docs, repeats, share, seed).where("times > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("times").alias("times"))
    again = F.explode(F.sequence(F.lit(1), times["times"]))
    return docs.join(times, docs["doc_id"].eqNullSafe(times["_id"])).withColumn(unused(docs, "_copy"), again).select(*[docs[c] for c in docs.columns])
