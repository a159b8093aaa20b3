"""What a step holds or moves must not grow faster than its input."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from __spark_entry__ import QUERIES
from rivalscope.operators import search
from rivalscope.operators import vectors as vx
from rivalscope.sources import html


def test_signature_search_moves_each_vector_once(spark):
    """The index has one row a vector, and tiles of any size find what matching all pairs finds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    index = vx.signature_index(rows, 16, bits=4, tables=2)
    assert index.count() == 300 and {len(r.buckets) for r in index.select("buckets").collect()} == {2}
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")

    def found(**tile):
        out = vx.approximate_knn(index, queries, 5, 16, bits=4, tables=2, probes=2, **tile).collect()
        return {(r.query_id, r.rank): (r.vec_id, r.distance) for r in out}

    own, near = vx._signer(16, 4, 2, 1, 5)(x), vx._signer(16, 4, 2, 2, 5)(x)
    dist = 1 - x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = {}
    for i in range(300):
        may = [j for j in range(300) if any(own[j, t, 0] in near[i, t] for t in range(2))]
        for rank, j in enumerate(sorted(may, key=lambda j: (round(dist[i, j], 9), j))[:5], 1):
            want[i, rank] = j
    assert {key: v[0] for key, v in found().items()} == want
    assert found(rows=40, per_tile=70) == found()


def brute(q, x, k, may=None):
    """(query, row) of the k nearest by distances in double precision, with equal ones by row."""
    dist = 1 - np.stack([(a * x).sum(axis=1) / (np.linalg.norm(a) * np.linalg.norm(x, axis=1)) for a in q])
    if may is not None:
        dist[~may] = np.inf
    return [(i, j) for i, d in enumerate(dist) for j in np.lexsort((np.arange(len(x)), np.round(d, 13)))[:k] if d[j] < np.inf]


def test_buckets_are_matched_for_near_pairs_only():
    """Few pairs are asked whether they may be compared, and the nearest allowed ones are found all the same."""
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(8000, 24)), rng.normal(size=(100, 24))
    may, asked = rng.random((100, 8000)) < 0.4, []

    def hit(r, c):
        asked.append(len(r))
        return may[r, c]

    block = vx._Block(pa.array(range(8000)), x, np.linalg.norm(x, axis=1), None, 10)
    r, c, _ = block.nearest(q, np.linalg.norm(q, axis=1), hit)
    assert [*zip(r.tolist(), c.tolist())] == brute(q, x, 10, may)
    assert sum(asked) < 0.05 * may.size


def test_products_of_single_precision_only_choose():
    """Directions that single precision can't tell apart, far lengths and vectors without a length: the order is that of doubles."""
    rng = np.random.default_rng(7)
    x = np.concatenate([100 + 0.01 * rng.normal(size=(1500, 8)), 1e90 * rng.normal(size=(20, 8)), 1e-90 * rng.normal(size=(20, 8))])
    q = x[::20]
    r, c, d = vx._Block(pa.array(range(len(x))), x, np.linalg.norm(x, axis=1), None, 5).nearest(q, np.linalg.norm(q, axis=1))
    assert [*zip(r.tolist(), c.tolist())] == brute(q, x, 5)
    y = np.concatenate([np.zeros((4, 8)), x[:2], 1e120 * x[:1], np.full((1, 8), np.nan)])
    with np.errstate(invalid="ignore"):
        n = np.linalg.norm(y, axis=1)
    r, c, d = vx._Block(pa.array(range(8)), y, n, None, 5).nearest(y, n)
    assert c[r == 4].tolist()[2:] == [5, 0, 1] and set(c[r == 4][:2]) == {4, 6} and not np.isfinite(d[r == 4][3:]).any()
    assert c[r == 0].tolist() == c[r == 7].tolist() == [0, 1, 2, 3, 4] and not np.isfinite(d[(r == 0) | (r == 7)]).any()


def test_search_moves_each_vector_a_bounded_number_of_times(spark):
    """Vectors travel in the precision they are stored in, to few tiles, and each pair meets once."""
    for n in (50_000, 600_000):
        blocks, turns = vx._grid(n, n, 64 * n, 4, vx.TILE_ROWS, vx.TILE_QUERIES)
        assert blocks + turns <= 20 and blocks * turns >= 48 and n / blocks <= vx.TILE_ROWS
    assert vx._grid(10, 600_000, 64 * 600_000, 10, vx.TILE_ROWS, vx.TILE_QUERIES)[1] == 1
    assert vx._grid(100_000, 100_000, 4096 * 100_000, 4, vx.TILE_ROWS, vx.TILE_QUERIES)[0] >= 32
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).cast("array<float>").alias("embedding"))
    left, right = vx._unit_rows(rows, "vec_id", "embedding", "query"), vx._unit_rows(rows, "vec_id", "embedding", "item")
    tiles = vx._tiles(left, right, 3, 50, 70).withColumn("task", F.spark_partition_id()).collect()
    assert {len(r.item_v if r._side == 0 else r.query_v) for r in tiles} == {12}
    blocks, turns = vx._grid(200, 200, 600, 3, 50, 70)
    assert len(tiles) == 200 * (blocks + turns) and len({r._cell for r in tiles}) == len({r.task for r in tiles}) == blocks * turns
    sides = {}
    for r in tiles:
        sides.setdefault(r._cell, ([], []))[r._side].append(r.item if r._side == 0 else r.query)
    assert sorted((q, i) for items, queries in sides.values() for q in queries for i in items) == [(q, i) for q in range(200) for i in range(200)]


def test_nodes_leave_in_slices():
    """A batch of many pages is never held as nodes at once; slices join to the same nodes."""
    pages = [f"<p id=a>{'x ' * 40_000}</p>" for _ in range(40)] + [None, "", "<b>" + "y" * (2 * html.SLICE_LETTERS)]
    out = list(html._parser(False).func(iter([pa.array(pages), pa.array([], pa.string()), pa.array(["<i>z"])])))
    assert sum(map(len, out)) == len(pages) + 1
    assert max(sum(len(n["text"] or "") for page in part.to_pylist() for n in page) for part in out[:-2]) <= html.SLICE_LETTERS
    assert pa.concat_arrays(out).to_pylist() == html._node_arrays([*pages, "<i>z"], False).to_pylist()


def test_parser_memory_does_not_follow_the_batch(monkeypatch):
    """Beyond the batch itself, the most a worker holds is the same for few pages and for many."""
    def held(n):
        batch = pa.array(["<ul class=a>" + "<li><a href=/x>some words</a></li>" * 300 + "</ul>"] * n)
        before = pa.total_allocated_bytes()
        tracemalloc.start()
        arrow = max(pa.total_allocated_bytes() - before for _ in html._parser(True).func(iter([batch])))
        python = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return arrow, python

    monkeypatch.setattr(html, "SLICE_LETTERS", 30_000)
    held(5)
    few, many = held(10), held(60)
    assert all(m <= 1.3 * f for f, m in zip(few, many)), (few, many)


def test_chunks_leave_in_slices():
    texts = ["word " * 20_000] * 30 + [None, "", "one"]
    out = list(vx._cutter(500, 100).func(iter([pa.array(texts)])))
    assert len(out) > 3 and sum(map(len, out)) == len(texts)
    assert pa.concat_arrays(out).to_pylist() == [vx.split_recursive(t, 500, 100) if t else [] for t in texts]


def test_gram_index_grows_with_distinct_texts(spark, folder):
    """Rows that share a text share its postings; a search finds all of them, nulls none."""
    rows = spark.createDataFrame([(i, ["blue ring", "hot bolt", None][i % 3], "RING" if i % 5 == 0 else "x") for i in range(600)],
                                 "id bigint, title string, category string")
    search.write_gram_index(rows, "id", ["title", "category"], folder, parts=4)
    # grams: 7 of "blue ring", 6 of "hot bolt", 2 of "RING"
    assert spark.read.parquet(f"{folder}/postings").count() == 15
    found = {r.id for r in search.search(rows, folder, "id", ["title", "category"], "ring", parts=4).collect()}
    assert found == {i for i in range(600) if i % 3 == 0 or i % 5 == 0}
    assert {r.id for r in search.candidates(spark, folder, "id", "bolt", parts=4).collect()} == {i for i in range(600) if i % 3 == 1}
    assert search.candidates(spark, folder, "id", "rings", parts=4).count() == 0


def test_pages_are_parsed_once_on_all_cores(spark, data):
    """A filter made of the nodes stays above the parsing, and pages made of a small table are spread first."""
    for name in ("prd_05_product_link_kinds", "prd_05_product_links", "prd_06_section_kinds", "aud_00_page_elements"):
        out = QUERIES[name](spark, data)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1, name
    assert QUERIES["prd_05_product_link_kinds"](spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_link_sets_come_from_one_pass(spark, data):
    """Both kinds of links leave one parsing of the page."""
    out = QUERIES["set_04_link_sets"](spark, data)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert out.dtypes == [("page_id", "bigint"), ("kind", "string"), ("link", "string")]
    got = {(r.page_id, r.kind, r.link) for r in out.collect()}
    assert out.count() == len(got) and {k for _, k, _ in got} == {"internal", "external"}
    some = min(p for p, _, _ in got)
    assert (some, "external", "other.example/x") in got and (some, "internal", f"/in/{some}") in got


def test_page_queries_parse_once_in_slices(spark, data):
    """Each page query gets its nodes from one pass of the parser that gives them in slices."""
    for name in ("cls_06_classify_pages", "aud_05_links", "aud_26_overall_seo", "aud_07_element_counts", "txt_11_time_markers",
                 "aud_02_meta_description", "txt_10_main_content", "prd_05_product_links", "aud_00_page_elements", "set_04_link_sets"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        steps = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
        assert len(steps) == 1 and steps[0].rstrip().endswith(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}"), (name, steps)
