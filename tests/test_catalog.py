import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import rows_of
from rivalscope import catalog
from rivalscope.catalog.bindings import TABLES

catalog.load()
SAMPLE = ["rank_by_page_speed", "sco_02_competitor_seo_summary", "sco_03_competitor_gap_matrix", "sco_04_competitor_top_issues",
          "sco_11_competitor_market_scores", "sco_13_competitor_social_score", "sco_15_social_time_series", "sco_29_job_totals",
          "snk_01_upsert", "snk_06_history_delta", "prj_03_canonical_url", "joi_04_grid_totals", "joi_09_latest_rows",
          "agg_12_growth", "win_06_minmax_norm", "cls_01_classify_url", "txt_03_top_ngrams", "txt_04_readability",
          "aud_00_visible_text", "aud_05_links", "vec_03_knn", "str_05_select_batch", "str_08_served_while_banned"]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, duck, data, key):
    df = catalog.QUERIES[key](spark, data)
    cur = duck.execute(catalog.SQL[key])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("key", ["cls_08_discover_urls_whole", "sco_25_stock_history_whole"])
def test_query_reads_whole_tables(spark, duck, data, key):
    test_query_equals_sql(spark, duck, data, key)
    got = catalog.QUERIES[key](spark, data)
    if key.startswith("cls"):
        assert got.where("source = 'sitemap'").count() == spark.read.parquet(f"{data}/lineitem.parquet").count()
        assert got.where("source = 'homepage'").take(1)
    else:
        assert got.select("product_id").distinct().count() == spark.read.parquet(f"{data}/lineitem.parquet").select("l_partkey").distinct().count()


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
