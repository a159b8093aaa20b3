"""Nearest neighbours by inner product, with learned partitions.

1. Equal vectors are one point. A point keeps the smallest ``k + 1`` ids of its
   copies: more can't enter a result, as ties go to smaller ids.
2. On a sample of at most ``sample`` points a neighbour graph is built and cut in
   parts of equal size: from seeds, points move to the part that most of their
   neighbours have, in order of their gain, while the part has room.
3. A small classifier (softmax over the vector, its parts' graph neighbours as soft
   labels) learns the parts. It places every point in its likeliest part, and
   sends every query to its ``probes`` likeliest parts.
4. Parts are cut in blocks of bounded size by a hash of the id; a task compares
   the queries of a part with one block, in double precision, and keeps the best
   ``k + 1`` of each query. The best over all blocks are ranked again on the vectors.

The number of parts grows with the square root of the number of points, up to one
part for eight sampled vectors; the partitions are learned at every size that has
two parts (64 points). A query takes further parts, in order, while those it has
hold ``k`` points or fewer. Measured recall against brute force is given in the README.

Defined cases: vectors that are null, zero, or hold null or non-finite parts take
no part, as candidates or as queries; so do null ids; vectors of another length
than most meet only vectors of their own length; with fewer than ``k`` candidates
a query gets all of them (all parts are then probed);
repeated rows of one id are one candidate; an empty table gives no rows; extra
columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import stash

ship(__name__)

#: Most points compared in one task, and about as many queries.
BLOCK = 20_000
QUERY_BLOCK = 20_000


def usable(vector: Column) -> Column:
    """Not null, not zero, all parts finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def points_of(vectors: DataFrame, k: int) -> DataFrame:
    """(point, vector, ids): one row for each distinct vector, named by its smallest id, with the smallest k + 1 ids."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector")).distinct()
    # Ids are cut to k + 1 per salt first, by a rank that Spark limits before the shuffle: no list holds a hot vector's copies.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("at", F.row_number().over(Window.partitionBy("vector", "salt").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    return (few.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
            .select(F.get("ids", F.lit(0)).alias("point"), "vector", "ids"))


# ------------------------------------------------------------------ learning

def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` points of greatest inner product with each point, itself left out, in blocks."""
    out = np.zeros((len(x), degree), np.int64)
    for at in range(0, len(x), 128):
        s = -(x[at:at + 128] @ x.T)
        s[np.arange(len(s)), np.arange(at, at + len(s))] = np.inf
        out[at:at + 128] = np.argpartition(s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int, rounds: int = 12) -> np.ndarray:
    """A part for each point, of nearly equal sizes, that keeps most graph edges inside."""
    rng = np.random.default_rng(seed)
    n = len(x)
    room = math.ceil(1.1 * n / parts)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.full(n, -1)
    for step in range(rounds):
        if step < 4:  # a rough start by nearest centres
            gain = x @ centres.T
            gain /= np.abs(gain).max() + 1e-12
        else:  # then by the parts of graph neighbours, in either direction
            gain = np.zeros((n, parts))
            for j in range(graph.shape[1]):
                np.add.at(gain, (np.arange(n), part[graph[:, j]]), 1.0)
                np.add.at(gain, (graph[:, j], part), 1.0)
            gain += 1e-3 * (x @ centres.T)
        choice = np.argsort(-gain, axis=1)[:, :16]
        order = np.argsort(-(gain[np.arange(n), choice[:, 0]] - gain[np.arange(n), choice[:, -1]]), kind="stable")
        sizes = np.zeros(parts, np.int64)
        for i in order.tolist():
            for c in choice[i].tolist():
                if sizes[c] < room:
                    break
            else:
                c = int(sizes.argmin())
            part[i] = c
            sizes[c] += 1
        for c in range(parts):
            inside = part == c
            if inside.any():
                m = x[inside].mean(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    return part


def fit_router(x: np.ndarray, soft: np.ndarray, seed: int, rounds: int = 40, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft labels by Adam over seeded batches."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros((x.shape[1], soft.shape[1])), np.zeros(soft.shape[1])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    t = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 1024):
            own = order[at:at + 1024]
            z = x[own] @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            d = (p - soft[own]) / len(own)
            t += 1
            for v, g, m, s in ((w, x[own].T @ d, state[0], state[1]), (b, d.sum(axis=0), state[2], state[3])):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
    return w, b


def learn_partitions(x: np.ndarray, parts: int, seed: int, degree: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weights that route a vector to parts."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.maximum(norm, 1e-300)
    graph = neighbour_graph(x, min(degree, len(x) - 1))
    part = balanced_parts(x, graph, parts, seed)
    soft = np.zeros((len(x), parts))
    soft[np.arange(len(x)), part] += 1.0
    for j in range(graph.shape[1]):
        soft[np.arange(len(x)), part[graph[:, j]]] += 1.0 / graph.shape[1]
    return fit_router(x, soft / soft.sum(axis=1, keepdims=True), seed)


# ------------------------------------------------------------------ search

def learned(points: DataFrame, n: int, sample: int, part_share: float, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The router over ``n`` points; None where they are too few for two parts."""
    parts = int(part_share * math.sqrt(n)) // 4
    if parts < 2:
        return None
    chosen = points.select("point", "vector").orderBy(F.xxhash64(F.lit(seed), "point"), "point").limit(sample).collect()
    width = pd.Series([len(r["vector"]) for r in chosen]).mode()[0]
    x = np.array([r["vector"] for r in chosen if len(r["vector"]) == width])
    parts = min(parts, len(x) // 8)
    return learn_partitions(x, parts, seed) if parts > 1 else None


def _routes(model: tuple[np.ndarray, np.ndarray] | None, probes: int, sizes: np.ndarray | None = None, least: int = 0):
    """A function column: the likeliest parts of each vector; given the parts' sizes, as many as hold ``least`` points."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def routes(vectors: pd.Series) -> pd.Series:
        if model is None or not len(vectors):
            return pd.Series([np.array([-len(v)], np.int32) for v in vectors])
        w, b = model
        out = []
        for v in vectors:
            v = np.asarray(v, np.float64)
            if len(v) != len(w):
                out.append(np.array([-len(v)], np.int32))
                continue
            z = v / np.linalg.norm(v) @ w + b
            order = np.argsort(-z, kind="stable").astype(np.int32)
            enough = 0 if sizes is None else int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1
            out.append(order[:max(probes, enough)])
        return pd.Series(out)
    return routes


def _best(k: int):
    def best(key: tuple, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        """The best points of one block for each query of its part, with ties to smaller names."""
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "point": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(points):
            return empty
        points = points.sort_values("point", kind="stable")
        names = points["point"].to_numpy()
        x = np.stack(points["vector"].to_numpy())
        out_q, out_p, out_s = [], [], []
        q_names, q_vectors = queries["query"].to_numpy(), np.stack(queries["vector"].to_numpy())
        for at in range(0, len(q_names), 256):
            s = q_vectors[at:at + 256] @ x.T
            if s.shape[1] > k:
                edge = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
            else:
                edge = np.full((len(s), 1), -np.inf)
            rows, cols = np.nonzero(s >= edge - 1e-9 * np.abs(edge))
            out_q.append(q_names[at + rows])
            out_p.append(names[cols])
            out_s.append(s[rows, cols])
        return pd.DataFrame({"query": np.concatenate(out_q), "point": np.concatenate(out_p), "score": np.concatenate(out_s)})
    return best


def _exact():
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        """Inner product in double precision, parts summed in order."""
        out = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            out[i] = np.dot(np.asarray(x, np.float64), np.asarray(y, np.float64))
        return pd.Series(out)
    return score


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = 10_000, part_share: float = 1.0, probe_share: float = 0.75,
            seed: int = 17) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each id divisible by ``every``."""
    points = stash(points_of(vectors, k), "points")
    n = points.count()
    model = learned(points, n, sample, part_share, seed)
    parts = 1 if model is None else len(model[1])
    probes = math.ceil(probe_share * parts)
    placed = stash(points.withColumn("part", F.get(_routes(model, 1)("vector"), F.lit(0))), "placed")
    sizes = np.zeros(parts, np.int64)
    for r in placed.where("part >= 0").groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = (vectors.where(F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0) & usable(F.col("embedding")))
             .select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("vector")).distinct())
    # Equal query vectors are searched once.
    queries = stash(asked.groupBy("vector").agg(F.min("query_id").alias("query"))
                    .withColumn("part", F.explode(_routes(model, probes, sizes, k + 1)("vector"))), "queries")
    blocks = blocks.join(queries.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("turns")), "part")
    sent = queries.join(blocks, "part").select("query", "vector", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                               F.pmod(F.xxhash64("query"), F.col("turns")).cast("int").alias("turn"))
    held = placed.join(blocks, "part").select("point", "vector", "part", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int").alias("block"),
                                              F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    cells = ["part", "block", "turn"]
    found = (sent.groupBy(*cells).cogroup(held.groupBy(*cells))
             .applyInPandas(_best(k + 1), "query long, point long, score double"))
    top = found.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("point")).alias("minus"))), asc=False),
                                             1, 2 * k + 2).alias("top"))
    kept = top.select("query", F.explode("top").alias("t")).select("query", (-F.col("t.minus")).alias("point"))
    named = asked.join(queries.select("query", "vector").distinct(), "vector").select("query_id", "query")
    names = points.select("point", F.col("vector").alias("pv"), "ids")
    scored = (kept.join(names, "point").join(queries.select("query", F.col("vector").alias("qv")).dropDuplicates(["query"]), "query")
              .select("query", "ids", _exact()("qv", "pv").alias("score")))
    ranked = scored.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform(
        "ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("vec_id")))))), 1, k + 1).alias("top"))
    out = named.join(ranked, "query").select("query_id", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    return out.select("query_id", F.posexplode("top").alias("at", "t")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.minus")).alias("score"))
