import datetime as dt
import math

from pyspark.sql import functions as F

from rivalscope.functions import rules, text
from rivalscope.operators import relational as rel
from rivalscope.operators import text as tx
from rivalscope.operators import vectors as vx
from rivalscope.plans import issues, market, performance, seo, social
from rivalscope.streaming import frontier


def row(df):
    return df.collect()[0]


def test_fixed_and_ratio(spark):
    r = row(spark.range(1).select(rules.fixed(F.lit(1.005), 2).alias("a"), rules.ratio(F.lit(1), F.lit(0)).alias("b")))
    assert (r.a, r.b) == (1.01, None)


def test_price_text(spark):
    df = spark.createDataFrame([("12,5 DT",), ("1 299,00",), ("1.299,00",), ("x",), (None,)], "p string")
    assert [None if r[0] is None else float(r[0]) for r in df.select(text.parse_price("p")).collect()] == [12.5, 1299.0, None, None, None]


def test_speed_missing_and_minus_one(spark):
    rows = [("a", 1, '{"ttfb": -1, "first_paint": 900}'), ("b", 1, None)]
    p = spark.createDataFrame(rows, "url_hash string, competitor_id int, technical_metadata string")
    null = {r.url_hash: r for r in performance.with_speed_scores(p).collect()}
    value = {r.url_hash: r for r in performance.with_speed_scores(p, "value").collect()}
    assert null["a"].ttfb_score is None and null["a"].page_speed_score == 0.2
    assert value["a"].ttfb_score == 1.0 and value["a"].page_speed_score == 0.4
    assert null["b"].page_speed_score == 0.0


def test_seo_default_and_newest(spark):
    schema = ("id bigint, page_url_hash string, has_breadcrumbs boolean, bullet_list_count int, number_list_count int, "
              "avg_paragraph_word_count double, internal_links_count int, external_links_count int, seo_flags string, created_at timestamp")
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "p", True, 1, 0, 50.0, 11, 1, None, t),
            (2, "p", None, None, 0, None, None, None, '{"scores": {"overall_seo_score_percent": 90}}', t + dt.timedelta(1))]
    df = spark.createDataFrame(rows, schema)
    r = row(seo.page_seo_scores(df))
    assert (r.id, r.overall_score, r.content_score) == (2, 90.0, 70.0)
    assert r.ux_score == 60 * .25 + 70 * .2 + 50 * .25 + 70 * .15 + 80 * .15
    assert r.page_seo_score == round(45 + 14 + 10.5 + 7 + r.ux_score * .05, 2)
    assert seo.page_seo_scores(df, all_snapshots=True).count() == 2


def test_gap_matrix_is_antisymmetric(spark):
    cols = ["avg_seo_score", "avg_content_score", "avg_on_page_score", "avg_technical_score", "avg_ux_score"]
    s = spark.createDataFrame([(i, f"d{i}", *[float(i * 10 + j) for j in range(5)]) for i in range(7)],
                              "competitor_id int, domain string, " + ", ".join(f"{c} double" for c in cols))
    m = {(r.competitor_a, r.competitor_b): r.seo_gap for r in seo.competitor_gap_matrix(s, blocks=3).collect()}
    assert len(m) == 42 and all(m[b, a] == -v for (a, b), v in m.items())


def test_issue_ranking(spark):
    flags = ('{"scores": {"content_issues": ["A: 5 things (Score: 1.0/10.0)"], "technical_issues": ["B (Penalty: 2.0/8.0)", "C 3 left", "D"]}}')
    s = spark.createDataFrame([("p1", flags), ("p2", '{"scores": {"content_issues": ["A: 7 things (Score: 4.0/10.0)"]}}'), ("p3", "{}")],
                              "page_url_hash string, seo_flags string")
    pages = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 1)], "url_hash string, competitor_id int")
    got = {r.issue: r for r in issues.competitor_top_issues(s, pages).collect()}
    a = got["a: things"]
    assert (a.occurrence_count, a.affected_pages, a.total_impact, a.rank) == (2, 2, 15.0, 1)
    assert a.impact_ratio == round(15 / 21, 4) and a.coverage_ratio == 1.0
    assert a.priority_score == round((round(15 / 21, 4) * .6 + .4) * math.log10(3), 4)
    assert (got["b"].total_impact, got["c 3 left"].total_impact, got["d"].total_impact) == (2.0, 3.0, 1.0)
    assert abs(sum(r.impact_ratio for r in got.values()) - 1) < 1e-3


def test_market_score(spark):
    comp = spark.createDataFrame([(1, "a"), (2, "b")], "id int, domain string")
    cats = spark.createDataFrame([("tools", 2.0, True), ("toys", 1.0, True), ("old", 5.0, False)],
                                 "normalized_name string, relevance_weight double, is_active boolean")
    prods = spark.createDataFrame([(1, "Tóols", "t", "b", 1.0, '{"a":1}', True)] * 30 + [(1, "none", "t", None, None, "{}", False)] * 10,
                                  "competitor_id int, category string, title string, brand string, current_price double, specifications string, in_stock boolean")
    got = {r.competitor_id: r for r in market.competitor_market_scores(comp, prods, cats).collect()}
    r = got[1]
    assert (r.coverage_score, r.category_balance_score, r.assortment_score, r.availability_score) == (66.67, 66.67, 100.0, 75.0)
    assert r.final_score == round(66.67 * .4 + 66.67 * .25 + 20 + 11.25, 2)
    assert got[2].final_score == 0.0


def test_social_score_edges(spark):
    as_of = F.lit("2024-04-01 00:00:00").cast("timestamp")
    acc = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 2, "x"), (4, 2, "y")], "id bigint, competitor_id int, platform string")
    t = dt.datetime(2024, 3, 1)
    met = spark.createDataFrame([(1, 1, 100, t), (2, 1, 200, t + dt.timedelta(1)), (3, 2, 0, t), (4, 4, 50, dt.datetime(2020, 1, 1))],
                                "id bigint, account_id bigint, follower_count bigint, snapshot_time timestamp")
    posts = spark.createDataFrame([(1, 1, t, 10, None, 5), (2, 1, dt.datetime(2020, 1, 1), 999, 9, 9)],
                                  "id bigint, account_id bigint, publish_time timestamp, like_count bigint, comment_count bigint, share_count bigint")
    m = {r.account_id: r for r in social.account_metrics(acc, met, posts, as_of).collect()}
    assert set(m) == {1, 2, 4}  # no metric row, no score
    assert (m[1].avg_engagement, m[1].growth_rate, m[1].follower_delta, m[1].engagement_rate) == (15.0, 1.0, 100, 0.075)
    assert m[2].engagement_rate is None and m[4].growth_rate == 0.0 and m[4].posts_last_3m == 0
    s = {(r.competitor_id, r.platform): r for r in social.competitor_social_score(acc, met, posts, as_of).collect()}
    assert s[1, "x"].score == 0.65 + 0.0  # flat engagement gives 0; reach, activity and growth are at their maximum
    assert s[2, "y"].score == 0.0


def test_series_first_row(spark):
    h = spark.createDataFrame([(dt.date(2024, 1, d), 1, "x", float(d)) for d in (1, 2, 4)], "snapshot_date date, competitor_id int, platform string, score double")
    rows = social.social_time_series(h).orderBy("snapshot_date").collect()
    assert rows[0].volatility is None and rows[0].composite_score is None and rows[0].trend_direction == "flat"
    assert [r.score_delta for r in rows] == [None, 1.0, 2.0] and rows[2].score_acceleration == 1.0
    f = row(social.forecast_regression(h, "2024-01-04"))
    assert abs(f.trend_slope - 1.5) < 1e-9


def test_retry_delays(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 9)], "n int")
    assert [r[0] for r in df.select(frontier.retry_delay(F.col("n"))).collect()] == [10.0, 10.0, 20.0, 160.0, 300.0]


def test_select_batch_cap(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "d", "queued", 5, t) for i in range(20)] + [(100, "d", "queued", 1, t), (101, "d", "inflight", 1, t)]
    s = spark.createDataFrame(rows, "id int, domain string, status string, priority int, queued_at timestamp")
    got = frontier.select_batch(s, cap=5).orderBy("slot").collect()
    assert [r.id for r in got] == [100, 0, 1, 2]


def test_latest_by_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    got = rel.latest_by(df, ["k"], ["v"])
    assert row(got.filter("k = 0")).v == 19999 and got.count() == df.select("k").distinct().count()


def test_text_features_against_python(spark, data):
    from collections import Counter
    import re
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(30)
    texts = {r.doc_id: r.text for r in docs.collect()}
    stop = set(tx.STOPWORDS)
    got: dict = {}
    for r in tx.top_keywords(docs).collect():
        got.setdefault(r.doc_id, []).append((r.keyword, r.n))
    for k, t in texts.items():
        c = Counter(w for w in re.findall(r"\b[a-z0-9]+\b", t.lower()) if w not in stop and len(w) >= 4)
        want = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert sorted(got.get(k, []), key=lambda x: (-x[1], x[0])) == want


def test_intent_phrases_and_url(spark):
    df = spark.createDataFrame([("Get started: sign up and buy", "https://x.y/pricing"), ("", None), ("contact about", "https://x.y/")], "text string, url string")
    rows = tx.search_intent(df, url="url").collect()
    # get 3, get started 1, sign up 3, buy 3, /pricing 4
    assert rows[0].transactional_score == 14 and rows[0].search_intent == "transactional"
    assert rows[1].search_intent == "informational" and rows[1].intent_confidence == 0.0
    assert rows[2].search_intent == "navigational" and rows[2].navigational_score == 6


def test_chunks(spark):
    text_ = " ".join(f"word{i}" for i in range(400)) + "\n\n" + "x" * 1200
    pieces = vx.split_recursive(text_, 500, 100)
    assert all(len(p) <= 500 for p in pieces)
    assert all(f"word{i}" in " ".join(pieces) for i in range(400)) and "".join(pieces).count("x") >= 1200
    df = spark.createDataFrame([(1, text_)], "id int, text string")
    assert [r.chunk for r in vx.chunk_documents(df, "text").orderBy("chunk_no").collect()] == pieces
    ends = vx.chunk_stride(df, "text").orderBy("chunk_no").collect()
    assert ends[-1].chunk.endswith("x") and all(len(r.chunk) <= 500 for r in ends)


def test_knn_brute_force(spark, data):
    import numpy as np
    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    rows = e.collect()
    m = np.array([r.embedding for r in rows], float)
    q = m[:3]
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    got: dict = {}
    for r in vx.knn(e, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    d = 1 - (m @ q.T) / (np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None])
    for i in range(3):
        assert got[i] == [rows[j].vec_id for j in np.argsort(d[:, i], kind="stable")[:5]]


def test_knn_tiles_ties_and_odd_vectors(spark):
    """More queries than one tile holds, hundreds of copies, zero, null, short vectors: the k nearest, copies by key."""
    import numpy as np
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(2000, [0.0] * 6), (2001, None), (2002, [1.0, 2.0]), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding")
    got: dict = {}
    for r in vx.knn(df, queries, 7, rows=40, per_tile=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v in rows if v and len(v) == 6 and None not in v}
    for i, u in unit.items():
        if i == 2000:
            continue
        near = sorted((round(1 - float(u @ w), 12), j) for j, w in unit.items() if j != 2000)[:7]
        assert got[i] == [j for _, j in near]
    assert got[2002] == [2002] and 2001 not in got and 2003 not in got and len(got[2000]) == 7


def test_signature_search_recall(spark):
    """Recall of the approximate form against the exact one over all rows of the larger table, and how much it leaves unread."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    queries = e.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vx.knn(e, queries, 10).select("query_id", "vec_id")
    found = vx.approximate_knn(vx.signature_index(e, 64), queries, 10, 64)
    n = exact.count()
    recall = found.join(exact, ["query_id", "vec_id"]).count() / n
    print("recall", recall)
    assert n == 20_000 and recall >= 0.9


def test_embed_hook(spark):
    df = spark.createDataFrame([("a",), ("bbb",)], "t string")
    out = vx.embed(df, "t", lambda: (lambda texts: [[len(x), 1] for x in texts])).collect()
    assert [list(r.embedding) for r in out] == [[1.0, 1.0], [3.0, 1.0]]
