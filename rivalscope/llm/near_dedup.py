"""Near-duplicates by banded MinHash with odd sketches.

1. Texts become sets of hashed word shingles. Documents with equal sets are one
   class from here on, so copies cost one row each.
2. ``BANDS`` x ``ROWS`` MinHash values; documents that agree on all rows of a band
   share a bucket. At similarity 0.8 a pair misses all buckets with a chance of
   (1 - 0.8^4)^32, less than 1 in 10 million.
3. The MinHash values, each tagged with its place, are folded into a bitmap of
   parities, the odd sketch. The bits set in the XOR of two sketches estimate
   how many values differ. In each bucket every document is compared with the
   smallest one, its hub, first by sketch; a pair goes on unless the estimate is
   over ``SLACK`` below the threshold, five standard deviations.
4. Pairs that pass are confirmed on their full sets. Links give components.
5. Buckets that still hold several components are searched once more: each member
   outside the hub's component against the whole bucket, in blocks and turns, by sketch and
   full set, in the first bucket that a pair shares. So no link between two
   members of a bucket is lost, and no pairs are written but links.
6. Components over all links; the smallest document id names a component.

Hot buckets: hubs and members meet in joins that Spark can split; step 5 cuts a
bucket in blocks and the members outside the hub's component in turns, both of
bounded size; a task holds one turn and one block. Members are repeated for each
turn, those outside also for each block. In a bucket where these are many, that step is quadratic in them.

Defined cases: null or empty text, or one without words, has no shingles and is
linked with nothing; with fewer words than a shingle the whole sequence is the
shingle; null ids take no part in links and get themselves as component; repeated
rows give repeated results; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import chunks, lowered, mix, span_hashes, stash, word_spans

ship(__name__)

BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
SLACK = 0.18
#: Shingles in a block and in a turn of step 5.
BLOCK_SHINGLES = 500_000
_SEEDS = np.random.default_rng(20240501).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(lowered(data), starts, ends)
    n = len(offsets) - 1
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width if len(total) else 0):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(total)])
    out = []
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            out.append(np.unique(total[a:b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mix(np.array([whole * np.uint64(31) + h], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    best = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        x = shingles[at:at + 1024, None] * _SEEDS[None, :]
        best = np.minimum(best, x.min(axis=0))
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    """One hash a band, which also tells the band."""
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values.reshape(BANDS, ROWS)[:, k])
    return key


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of the MinHash values with their places, as bytes."""
    at = mix(values + np.arange(len(values), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) % 2 == 1)


def most_odd_bits(similarity: float) -> float:
    """Expected bits set in the XOR of two sketches at that similarity."""
    differing = 2 * BANDS * ROWS * (1 - similarity)
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing)


def odd_similarity(bits: np.ndarray) -> np.ndarray:
    """Similarity estimated from the bits set in the XOR of two sketches."""
    inside = np.maximum(1 - 2 * bits / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log(inside)


def xor_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits set in the XOR of sketches of equal rows."""
    return np.bitwise_count(a ^ b).sum(axis=-1)


def linked(common: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (size_a + size_b - common)


# ------------------------------------------------------------------ sets and classes

def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, p1, p2, keys, sketch) of every row: size and 128-bit fingerprint of its set, band keys, odd sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                values = [min_hashes(x) for x in sets]
                with np.errstate(over="ignore"):
                    p1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
                    p2 = np.array([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array([len(x) for x in sets], pa.int64()), pa.array(p1.view(np.int64)),
                     pa.array(p2.view(np.int64)), pa.array([band_keys(v).view(np.int64) for v in values], pa.list_(pa.int64())),
                     pa.array([odd_sketch(v).tobytes() for v in values], pa.binary())],
                    ["doc_id", "n_shingles", "p1", "p2", "keys", "sketch"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, p1 long, p2 long, keys array<long>, sketch binary")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of rows (id, text, p1): the sorted set as 8-byte numbers, for texts whose fingerprint is p1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                with np.errstate(over="ignore"):
                    prints = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                own = np.flatnonzero(prints == np.asarray(batch.column(2).slice(at, to - at)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at).take(pa.array(own)), pa.array([sets[i].tobytes() for i in own], pa.binary())],
                    ["id", "shingles"])
    return texts.select("id", "text", "p1").mapInArrow(run, "id long, shingles binary")


# ------------------------------------------------------------------ links

def _sketch_filter(least: float):
    most = most_odd_bits(least)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint64).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint64).reshape(len(b), -1)
        return pd.Series(xor_counts(x, y) <= most)
    return near


def _set_filter(percent: int):
    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = 100 * common >= percent * (len(x) + len(y) - common)
        return pd.Series(out)
    return same


def hub_links(sigs: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of bucket members b with their bucket's hub a."""
    hubs = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    pairs = buckets.join(hubs, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    side = lambda name: sigs.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    by_size = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    near = _sketch_filter(percent / 100 - SLACK)
    likely = stash(pairs.join(side("a"), "a").join(side("b"), "b").where(by_size).where(near("sa", "sb")).select("a", "b"), "likely")
    same = _set_filter(percent)
    both = (likely.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b"))
    return both.where(same("xa", "xb")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach, for ids in a link. Large stars and small stars in turn."""
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        new = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(low.select("u", F.col("m").alias("v"))).distinct())
        new = stash(new, "edges")
        moved = new.exceptAll(edges).take(1) or edges.exceptAll(new).take(1)
        edges = new
        if not moved:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _block_links(percent: int):
    most = most_odd_bits(percent / 100 - SLACK)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the turn's stray members and the block, in the first bucket a pair shares."""
        ids, comps = rows["id"].to_numpy(), rows["component"].to_numpy()
        keys = np.stack([np.frombuffer(x, np.int64) for x in rows["keys"]])
        sketches = np.stack([np.frombuffer(x, np.uint64) for x in rows["sketch"]])
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(x) for x in sets])
        bound = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(sets)
        place = int(np.flatnonzero((keys == rows["key"].iloc[0]).all(axis=0))[0])
        mine, asked = rows["own"].to_numpy(), np.flatnonzero(rows["asks"].to_numpy())
        out_a, out_b = [], []
        for q in asked:
            cand = mine & (comps != comps[q]) & ((ids < ids[q]) | ~rows["stray"].to_numpy())
            cand &= 100 * np.minimum(sizes, sizes[q]) >= percent * np.maximum(sizes, sizes[q])
            at = np.flatnonzero(cand)
            at = at[xor_counts(sketches[at], sketches[q][None]) <= most]
            at = at[~(keys[at, :place] == keys[q, :place]).any(axis=1)]
            if not len(at):
                continue
            spans = np.concatenate([np.arange(bound[i], bound[i + 1]) for i in at])
            where = np.minimum(np.searchsorted(sets[q], flat[spans]), sizes[q] - 1)
            common = np.add.reduceat(sets[q][where] == flat[spans], np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
            hit = at[linked(common, sizes[at], sizes[q], percent)]
            _, one = np.unique(comps[hit], return_index=True)  # one link a component is enough
            out_a += ids[hit[one]].tolist()
            out_b += [int(ids[q])] * len(one)
        return pd.DataFrame({"a": pd.Series(out_a, dtype="int64"), "b": pd.Series(out_b, dtype="int64")})
    return search


def stray_links(sigs: DataFrame, buckets: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the hubs could not show, in buckets of several components."""
    named = buckets.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    stats = (named.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.min("component").alias("lo"),
                                      F.max("component").alias("hi"), F.min(F.struct("id", "component")).alias("hub"))
             .where("members > 2 and lo <> hi")
             .select("key", F.col("hub.component").alias("hub_component"), F.col("hub.id").alias("hub"),
                     F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    rows = named.join(stats, "key").where("id <> hub").withColumn("stray", F.col("component") != F.col("hub_component"))
    turns = (rows.where("stray").groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("turns")))
    rows = rows.join(turns, "key").withColumns({
        "block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "turn": F.pmod(F.xxhash64(F.lit(1), "id"), F.col("turns")).cast("int")})
    rows = stash(rows.select("key", "id", "component", "stray", "block", "blocks", "turn", "turns"), "mixed")
    ids = rows.select("id").distinct()
    packed = sigs.select("id", _packed_keys()("keys").alias("keys"), "sketch")
    kept = stash(sets.join(ids, "id", "left_semi").join(packed, "id"), "kept")
    # A member meets every turn in its block; a stray one asks in its turn every block. Cells of both are one row.
    member = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: F.struct(F.col("block").alias("at"), t.alias("by")))
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("at"), F.col("turn").alias("by")))
    cells = F.when(F.col("stray"), F.array_union(member, asking)).otherwise(member)
    spread = (rows.withColumn("cell", F.explode(cells)).select(
        "key", "id", "component", "stray", "cell.at", "cell.by", (F.col("cell.at") == F.col("block")).alias("own"),
        (F.col("stray") & (F.col("cell.by") == F.col("turn"))).alias("asks")))
    return (spread.join(kept, "id").groupBy("key", "at", "by").applyInPandas(
        _block_links(percent), "a long, b long").distinct())


def _packed_keys():
    @F.pandas_udf("binary")
    def packed(keys: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, np.int64).tobytes() for x in keys])
    return packed


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Every row of ``docs`` with n_shingles, component_id and kept."""
    signed = stash(signatures(docs, width), "signatures")
    prints = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stash(prints.groupBy("p1", "p2", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    same_set = ["p1", "p2", "n_shingles"]
    member = stash(signed.select("doc_id", *same_set).join(classes, same_set, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id")), "member")
    sigs = stash(prints.join(classes.hint("merge"), same_set).where("doc_id = id").select(
        "id", F.col("n_shingles").alias("n"), "p1", "keys", "sketch"), "classed")
    buckets = sigs.select("id", "n", F.explode("keys").alias("key")).distinct()
    several = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    buckets = stash(buckets.join(several, "key"), "buckets")
    # Sets of bucket members alone. A merge join at every size: the ids grow with the input.
    near = sigs.select("id", "p1").join(buckets.select("id").distinct(), "id", "left_semi")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    sets = stash(full_sets(texts.join(near.hint("merge"), "id"), width), "sets")
    links = stash(hub_links(sigs, buckets, sets, percent), "links")
    found = stash(components(links), "components")
    more = stash(stray_links(sigs, buckets, found, sets, percent), "more")
    if more.take(1):
        found = stash(components(links.union(more)), "components")
    return member.join(found, "id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
