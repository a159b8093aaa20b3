"""Indexes against plain scans: gram search, rule prefixes, deep pages, continuous aggregates, sketches."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rivalscope.operators import relational as rel
from rivalscope.operators import search
from rivalscope.plans import social
from rivalscope.sources import policies
from rivalscope.streaming import continuous


def test_gram_search_equals_scan(spark, folder):
    rng = random.Random(7)
    words = ["ring", "RINGS", "Äpfel", "string", "spring 5%", "a_b", "x", "", "naïve 東京都庁", "back\\slash", "Ärger", "ringed seal"]
    rows = [(i, rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))]), rng.choice([None, *words])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, title string, category string")
    search.write_gram_index(df, "id", ["title", "category"], folder, parts=8)
    for text in ["ring", "RING", "ing se", "x", "", "äpf", "東京都", "5%", "a_b", "nowhere", "ringed seal", "k\\s", "%ring", "rin_s"]:
        want = df.filter(F.col("title").ilike(search.like_pattern(text)) | F.col("category").ilike(search.like_pattern(text)))
        got = search.search(df, folder, "id", ["title", "category"], text, parts=8)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), text


def test_gram_search_reads_few_rows(spark, folder):
    """Only rows that hold all chosen grams are confirmed, and only the index parts of these grams are scanned."""
    df = spark.range(2000).select("id", F.concat(F.lit("item "), F.conv("id", 10, 26)).alias("title"), F.lit("any").alias("category"))
    search.write_gram_index(df, "id", ["title", "category"], folder, parts=8)
    found = search.candidates(spark, folder, "id", "m 2p", parts=8)
    assert 0 < found.count() < 100
    plan = search.search(df, folder, "id", ["title", "category"], "m 2p", parts=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan and search.candidates(spark, folder, "id", "zz", parts=8) is None


def test_rule_prefixes_equal_scan(spark):
    rng = random.Random(3)
    part = lambda: "/" + "".join(rng.choice("abé/") for _ in range(rng.randrange(0, 7)))
    rules = [("big", part()) for _ in range(120)] + [("small", "/a"), ("small", "/a"), ("none", ""), ("null", None)]
    urls = [(rng.choice(["big", "small", "none", "other", "null", None]), rng.choice([None, part(), part() + part()])) for _ in range(400)]
    u = spark.createDataFrame(urls, "site string, path string")
    r = spark.createDataFrame(rules, "site string, path string")
    blocked = lambda s, p: [x for t, x in rules if t == s and s is not None and p is not None and x and p.startswith(x)]
    kept = sorted(map(repr, ((x.site, x.path) for x in policies.apply_robots(u, r).collect())))
    assert kept == sorted(repr(x) for x in urls if not blocked(*x))
    longest = {(x.site, x.path): x.rule for x in policies.matching_rules(u, r).collect()}
    assert longest == {x: max(blocked(*x), key=len) for x in set(urls) if blocked(*x)}


def test_policy_values_keep_their_order(spark):
    text = "User-agent: a\n" + "".join(f"Disallow: /{k}\nAllow: /{99 - k}\n" for k in range(60))
    df = spark.createDataFrame([("s", text)], "site string, text string")
    g = policies.ai_policy_groups(df.repartition(3)).first()
    assert g.disallows == [f"/{k}" for k in range(60)] and g.allows == [f"/{99 - k}" for k in range(60)]


@pytest.mark.parametrize("size", [7, 500, 3000])
def test_deep_pages(spark, size):
    df = spark.range(3001).select("id", (F.col("id") * 7919 % 101).alias("score"))
    order = [F.desc("score"), F.asc("id")]
    every = [r.id for r in df.orderBy(*order).collect()]
    index = rel.RankIndex(df.repartition(5), order)
    assert index.total == 3001
    for number in (1, 2, 3001 // size, 3001 // size + 1, 3001 // size + 2):
        assert [r.id for r in index.page(number, size).collect()] == every[(number - 1) * size:number * size]
    assert rel.RankIndex(df.limit(0), order).page(1, 5).collect() == []


def test_deep_page_reads_its_own_part_only(spark, monkeypatch):
    monkeypatch.setattr(rel, "SHALLOW", 10)
    df = spark.range(1000).select("id", F.lit("x").alias("text"))
    deep = rel.page(df, [F.asc("id")], 50, 10)
    assert [r.id for r in deep.collect()] == list(range(490, 500)) and deep.columns == ["id", "text"]
    assert "PartitionFilters" in deep._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        rel.page(df, [F.asc("id")], 0, 10)


def files(folder):
    return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in Path(folder, "daily").glob("day=*/*.parquet")}


def test_late_row_changes_one_day(spark, folder):
    at = lambda day, hour, v: ("p", v, dt.datetime(2024, 1, day, hour))
    schema = "external_post_id string, like_count int, snapshot_time timestamp_ntz"
    now = lambda day, hour: F.lit(dt.datetime(2024, 1, day, hour).isoformat()).cast("timestamp_ntz")
    batches = [[at(1, 1, 10), at(2, 1, 20), at(3, 1, 30)], [at(1, 5, 30)], [at(5, 11, 7), at(5, 9, 5)]]
    every = [r for b in batches for r in b]

    def step(i, as_of):
        continuous.record(spark.createDataFrame(batches[i], schema), i, folder)
        return continuous.refresh(spark, folder, social.post_daily_metrics, as_of)
    assert step(0, now(4, 0)) == 3
    before = files(folder)
    assert step(1, now(4, 0)) == 1  # a late row of the first day
    after = files(folder)
    assert {d for d in after if after[d] != before.get(d)} == {"day=2024-01-01"}
    assert step(2, now(5, 11)) == 1  # one row is of the last hour
    daily = {str(r.day): r.avg_likes for r in spark.read.parquet(f"{folder}/daily").collect()}
    assert daily == {"2024-01-01": 20.0, "2024-01-02": 20.0, "2024-01-03": 30.0, "2024-01-05": 5.0}
    assert continuous.refresh(spark, folder, social.post_daily_metrics, now(5, 13)) == 1  # the held day again, without a new batch
    full = {(r.external_post_id, r.day): r.avg_likes for r in social.post_daily_metrics(spark.createDataFrame(every, schema)).collect()}
    assert {(r.external_post_id, r.day): r.avg_likes for r in spark.read.parquet(f"{folder}/daily").collect()} == full
    continuous.record(spark.createDataFrame(batches[1], schema), 1, folder)  # a batch that runs again adds nothing
    assert spark.read.parquet(f"{folder}/facts").count() == len(every)


def test_distinct_sketch_error(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("day"), (F.col("id") * 31 % 90_001).alias("v"))
    sketches = rel.distinct_sketches(df, ["day"], "v")
    for keys, exact in ((["day"], df.groupBy("day").agg(F.count_distinct("v").alias("n"))), ([], df.agg(F.count_distinct("v").alias("n")))):
        got = rel.distinct_estimates(sketches, keys).collect()
        want = exact.collect()
        key = (lambda r: r["day"]) if keys else (lambda r: 0)
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert abs(a["estimate"] / b["n"] - 1) < 3 * 1.04 / 2 ** 6
