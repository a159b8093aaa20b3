"""Declared schemas. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

#: Tables of the test data.
INPUT_TABLES: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

#: Tables of the competitive-intelligence model.
MODEL_TABLES: dict[str, str] = {
    "competitors": "id int, domain string, name string, metadata string, created_at timestamp",
    "scrape_jobs": "id bigint, url_hash string, url string, domain string, priority int, retries int, "
                   "status string, queued_at timestamp, updated_at timestamp, started_at timestamp, "
                   "finished_at timestamp, job_type string, technical_metadata string",
    "web_pages": "url_hash string, competitor_id int, url string, normalized_url string, "
                 "recent_content_hash string, page_type string, page_metadata string, "
                 "technical_metadata string, first_seen_at timestamp, last_seen_at timestamp, "
                 "next_run_at timestamp, last_success_at timestamp, last_failure_at timestamp, last_error string",
    "page_snapshots": "id bigint, page_url_hash string, status_code int, final_url string, text_hash string, "
                      "language string, title string, meta_description string, has_breadcrumbs boolean, "
                      "bullet_list_count int, number_list_count int, avg_paragraph_word_count double, "
                      "internal_links_count int, external_links_count int, headings string, seo_flags string, "
                      "created_at timestamp",
    "products": "id bigint, competitor_id int, url_hash string, title string, category string, "
                "on_page_category string, brand string, specifications string, on_page_details string, "
                "description_embedding array<float>, current_price decimal(10,2), in_stock boolean, "
                "category_page_hash string, first_seen_at timestamp, last_updated_at timestamp",
    "price_history": "id bigint, product_id bigint, price decimal(10,2), recorded_at timestamp",
    "stock_history": "id bigint, product_id bigint, in_stock boolean, recorded_at timestamp",
    "social_accounts": "id bigint, competitor_id int, platform string, external_id string, username string, "
                       "display_name string, profile_url string, is_verified boolean, is_business boolean, "
                       "follower_count bigint, following_count bigint, created_at timestamp, "
                       "updated_at timestamp, raw_json string",
    "social_account_links": "id bigint, account_id bigint, url string, title string, link_type string",
    "social_posts": "id bigint, account_id bigint, platform string, external_post_id string, text string, "
                    "post_url string, content_type string, publish_time timestamp, like_count bigint, "
                    "comment_count bigint, share_count bigint, view_count bigint, raw_json string",
    "social_post_metrics": "id bigint, external_post_id string, like_count bigint, comment_count bigint, "
                           "share_count bigint, view_count bigint, snapshot_time timestamp",
    "social_account_metrics": "id bigint, account_id bigint, follower_count bigint, following_count bigint, "
                              "like_count bigint, snapshot_time timestamp",
    "competitor_social_score_history": "snapshot_date date, competitor_id int, platform string, score double, "
                                       "engagement_score double, reach_score double, activity_score double, "
                                       "growth_score double",
    "competitor_social_ai_analysis": "id bigint, competitor_id int, platform string, analysis_date date, "
                                     "ai_summary string, created_at timestamp",
    "target_categories": "id int, parent_category_id int, category_name string, normalized_name string, "
                         "category_description string, relevance_weight decimal(5,2), is_active boolean, "
                         "metadata string",
    "webhook_events": "id bigint, source string, event string, payload string, received_at timestamp",
}

#: One crawl result as posted by a worker.
CRAWL_RESULT = (
    "struct<id:string,url:string,domain:string,priority:int,retries:int,status:string,status_code:int,"
    "final_url:string,title:string,job_type:string,last_error:string,queued_at:double,started_at:double,"
    "completed_at:double,seo_report:string,homepage_urls:map<string,array<string>>,products:array<string>,"
    "product:string,page_content:string>"
)


def schema_of(name: str) -> T.StructType:
    ddl = INPUT_TABLES.get(name) or MODEL_TABLES[name]
    return T.StructType.fromDDL(ddl)
