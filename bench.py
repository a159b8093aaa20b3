"""Time the headline queries: one warm-up and the median of the timed runs, full results to the noop sink."""

from __future__ import annotations

import json
import os
import statistics
import time

from rivalscope import catalog
from rivalscope.session import build_session

HEADLINE = [
    "rank_by_page_speed", "sco_01_page_seo_scores", "sco_02_competitor_seo_summary", "sco_03_competitor_gap_matrix",
    "sco_04_competitor_top_issues", "sco_07_page_performance_scores", "sco_08_page_overall_scores",
    "sco_11_competitor_market_scores", "sco_13_competitor_social_score", "sco_15_social_time_series",
    "sco_16_forecast_regression", "sco_21_competitor_list", "sco_29_job_totals", "snk_02_upsert_pages", "agg_11_latest_by",
    "win_10_top_n_per_group", "cls_01_classify_url", "txt_01_top_keywords", "txt_04_readability", "txt_07_search_intent",
    "vec_03_knn", "aud_00_visible_text", "aud_05_links", "str_02_job_state", "str_05_select_batch",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    catalog.load()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        def once() -> float:
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start
        once()
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
