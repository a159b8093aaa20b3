import datetime as dt
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from rivalscope.catalog.streams import job_events, payloads
from rivalscope.streaming import frontier, ingest, metrics

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def stream_of(spark, folder, batches, schema):
    """Files read one per micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/b=*")


def run(df, folder, mode, spark):
    out = []
    q = (df.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(b.collect()))
         .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None
    return out


def test_dedup_seen_equals_batch(spark, folder):
    schema = "url_id string, ts timestamp, n int"
    batches = [[("a", at(0), 1), ("b", at(10), 2), ("a", at(20), 3)], [("a", at(3600), 4), ("c", at(3700), 5)]]
    out = run(frontier.dedup_seen(stream_of(spark, folder, batches, schema)), folder, "append", spark)
    twin = frontier.dedup_seen_batch(spark.createDataFrame([r for b in batches for r in b], schema), tie="n").collect()
    assert sorted(r.url_id for r in out) == sorted(r.url_id for r in twin) == ["a", "b", "c"]


EVENTS = "url_id string, domain string, event string, ts timestamp, error string, n long"


def until(seconds):
    """An event of another URL, later than all others: moves the watermark."""
    return ("~", "d", "queued", at(seconds), None, 0)


def newest(out):
    return {r.url_id: r for r in out if r.url_id != "~"}


def test_job_state(spark, folder):
    batches = [
        [("a", "d", "queued", at(0), None, 1), ("a", "d", "inflight", at(1), None, 2), ("b", "d", "inflight", at(2), None, 3)],
        [("a", "d", "failed", at(5), "e1", 4), ("b", "d", "completed", at(6), None, 5)],
        [("c", "d", "failed", at(7), "x1", 6), ("c", "d", "failed", at(8), "x2", 7), ("c", "d", "failed", at(9), "x3", 8),
         ("c", "d", "failed", at(10), "x4", 9)], [until(14)], [until(14)]]
    out = run(frontier.job_state(stream_of(spark, folder, batches, EVENTS), watermark="1 second", tie="n"), folder, "update", spark)
    last = newest(out)
    twin = {r.url_id: r for r in frontier.job_state_batch(
        spark.createDataFrame([r for b in batches[:3] for r in b], EVENTS), "n").collect()}
    assert last.keys() == twin.keys()
    for k, t in twin.items():
        assert (last[k].status, last[k].retries, last[k].last_error) == (t.status, t.retries, t.last_error)
    assert last["a"].due_at == at(15) and last["c"].status == "failed" and last["c"].due_at is None


def test_job_state_of_shuffled_batches_equals_batch(spark, folder, data):
    """All events, dealt over three batches in any order: the batch twin's rows, retries included."""
    events = job_events(spark, data).withColumnRenamed("event_id", "n").select("url_id", "domain", "event", "ts", "error", "n")
    rows = [tuple(r) for r in events.collect()]
    random.Random(3).shuffle(rows)
    cut = len(rows) // 3
    end = ("~", "d", "queued", max(r[3] for r in rows) + dt.timedelta(days=900), None, 0)
    batches = [rows[:cut], rows[cut:2 * cut], rows[2 * cut:], [end], [end]]
    schema = EVENTS.replace("timestamp", events.schema["ts"].dataType.simpleString())
    stream = stream_of(spark, folder, batches, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run(frontier.job_state(stream, "400 days", lease_seconds=None, requeue=False, keep_seconds=None, tie="n"), folder, "update", spark)
    want = {r.url_id: (r.domain, r.status, r.retries, r.last_error) for r in frontier.job_state_batch(events, "n").collect()}
    assert {k: (r.domain, r.status, r.retries, r.last_error) for k, r in newest(out).items()} == want and len(want) > 10


def test_late_failure_counts(spark, folder):
    """A failure that arrives after newer events, but before the watermark, is applied at its own time."""
    batches = [[("a", "d", "completed", at(100), None, 1)], [("a", "d", "failed", at(50), "e", 2)], [until(5000)], [until(5000)]]
    out = run(frontier.job_state(stream_of(spark, folder, batches, EVENTS)), folder, "update", spark)
    last = newest(out)["a"]
    assert (last.status, last.retries, last.last_error) == ("completed", 1, "e")


def test_finished_state_is_removed(spark, folder):
    """A finished URL is forgotten after its time; a later event begins a new record; an open one stays."""
    batches = [[("a", "d", "failed", at(0), "e", 1), ("a", "d", "completed", at(1), None, 2), ("b", "d", "queued", at(2), None, 3)],
               [until(500)], [until(501)], [("a", "d", "queued", at(600), None, 4)], [until(2000)], [until(2001)]]
    df = frontier.job_state(stream_of(spark, folder, batches, EVENTS), watermark="1 second", keep_seconds=100)
    out = run(df, folder, "update", spark)
    mine = [(r.status, r.retries) for r in out if r.url_id == "a"]
    assert ("completed", 1) in mine and mine[-1] == ("queued", 0)
    last = max(int(p.name) for p in Path(folder, "ck/commits").iterdir() if p.name.isdigit())
    held = [{r[0] for r in spark.read.format("statestore").option("stateVarName", "job").option("batchId", i).load(f"{folder}/ck")
             .select("key.url_id").collect()} for i in range(last + 1)]
    with_a = ["a" in h for h in held]
    gone = with_a.index(False, with_a.index(True))
    assert "b" in held[gone] and "a" in held[-1]


def test_rejected_texts_and_repeated_compaction(spark, folder):
    text = '{"event": "crawl_result", "result": {"url": "https://a.example/x", "domain": "a.example"}}'
    for i, body in enumerate([text, "no json", text.replace("/x", "/y")]):
        ingest.write_batch(spark.createDataFrame([(body, at(i))], "value string, received_at timestamp"), i, f"{folder}/out")
    assert [r.value for r in ingest.read_rows(spark, f"{folder}/out", "rejects").collect()] == ["no json"]
    for _ in range(2):
        ingest.compact(spark, f"{folder}/out", "web_pages", 1, f"{folder}/small")
        pages = ingest.read_rows(spark, f"{folder}/small", "web_pages").collect()
        assert sorted((r.url, r.seen_at) for r in pages) == [("https://a.example/x", at(0)), ("https://a.example/y", at(2))]


def test_lease_expiry_by_timer(spark, folder):
    schema = "url_id string, domain string, event string, ts timestamp, error string, n int"
    batches = [[("a", "d", "inflight", at(0), None, 1)], [("z", "d", "queued", at(5000), None, 2)], [("z", "d", "queued", at(5001), None, 3)]]
    out = run(frontier.job_state(stream_of(spark, folder, batches, schema.replace("int", "long")), lease_seconds=300), folder, "update", spark)
    mine = [r for r in out if r.url_id == "a"]
    assert any(r.status == "retry_scheduled" and r.last_error == "lease expired" and r.retries == 1 for r in mine)


def test_daily_metrics_with_late_rows(spark, folder):
    schema = "external_post_id string, like_count int, snapshot_time timestamp"
    day = 86400
    batches = [[("p", 10, at(0))], [("p", 20, at(6 * day))], [("p", 30, at(60))], [("p", 99, at(30 * day))],
               [("p", 99, at(30 * day + 1))], [("p", 1000, at(120))]]
    out = run(metrics.post_daily_metrics_stream(stream_of(spark, folder, batches, schema)), folder, "update", spark)
    first = [r.avg_likes for r in out if r.day == dt.date(2024, 1, 1)]
    assert first[-1] == 20.0  # the late row of the third batch counts, the last one is too old


def test_rate_usage_stream_equals_batch(spark, folder):
    schema = "proxy string, domain string, ts timestamp"
    batches = [[("p", "d", at(i)) for i in range(3)], [("p", "d", at(3700))]]
    out = run(metrics.rate_usage_stream(stream_of(spark, folder, batches, schema), limit=3), folder, "update", spark)
    twin = metrics.rate_usage(spark.createDataFrame([r for b in batches for r in b], schema), limit=3).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, twin))


def test_ingest_stream(spark, folder, data):
    rows = payloads(spark, data).limit(40).select("value", F.lit("2024-02-01 00:00:00").cast("timestamp").alias("received_at"))
    bad = spark.createDataFrame([("{not json",)], "value string").withColumn("received_at", F.lit(None).cast("timestamp"))
    rows.unionByName(bad).coalesce(2).write.parquet(f"{folder}/in")
    again = payloads(spark, data).limit(40).select("value", F.lit("2024-02-02 00:00:00").cast("timestamp").alias("received_at"))
    again.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s = spark.readStream.schema("value string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = ingest.ingest_stream(s, f"{folder}/out", f"{folder}/ck")
    q.awaitTermination(180)
    assert q.exception() is None
    p = ingest.current_pages(spark, f"{folder}/out")
    assert p.count() == p.select("url_hash").distinct().count()
    r = p.agg(F.min("first_seen_at"), F.max("last_seen_at")).collect()[0]
    assert str(r[0]).startswith("2024-02-01") and str(r[1]).startswith("2024-02-02")
    prods = ingest.current_products(spark, f"{folder}/out")
    assert prods.count() > 0 and prods.filter("last_updated_at < '2024-02-02'").count() == 0
    seeds = ingest.current_seeds(spark, f"{folder}/out")
    assert seeds.count() == seeds.select("url_id").distinct().count() > 0
    assert ingest.read_rows(spark, f"{folder}/out", "jobs").count() == 80
    before = sorted(map(tuple, seeds.collect()))
    ingest.compact(spark, f"{folder}/out", "seeds", 1, f"{folder}/small")
    assert sorted(map(tuple, ingest.current_seeds(spark, f"{folder}/small").collect())) == before


def test_repeated_batch_changes_nothing(spark, folder):
    body = json.dumps({"event": "product_scrape_result", "result": {
        "url": "https://s.example/p/1", "domain": "s.example", "product": {"title": "T", "price": "1,5 DT"}}})
    batch = spark.createDataFrame([(body,)], "value string")
    for _ in range(2):
        ingest.write_batch(batch, 3, f"{folder}/out")
    rows = ingest.read_rows(spark, f"{folder}/out", "products").collect()
    assert [(r.title, float(r.current_price)) for r in rows] == [("T", 1.5)]
