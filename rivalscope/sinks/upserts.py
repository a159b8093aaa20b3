"""Key-based writes as set expressions: the result replaces the target table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import anti_join, latest_by


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
           order: Sequence[str]) -> DataFrame:
    """Insert new keys; for known keys overwrite ``set_cols`` with the newest update."""
    newest = latest_by(updates, keys, order)
    fresh = newest.select(*keys, F.lit(True).alias("_hit"), *[
        F.col(c).alias(f"_new_{c}") for c in target.columns if c not in keys and c in newest.columns])
    joined = target.withColumn("_old", F.lit(True)).join(fresh, list(keys), "full_outer")
    out = []
    for c in target.columns:
        new = f"_new_{c}"
        if c in keys or new not in fresh.columns:
            out.append(F.col(c))
        elif c in set_cols:
            out.append(F.when(F.col("_hit"), F.col(new)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(new)).alias(c))
    return joined.select(*out)


def upsert_pages(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Keep the first time a page was seen, move the last time forward, derive the next run.

    Both sides have url_hash, first_seen_at, last_seen_at and last_error.
    """
    both = target.unionByName(updates)
    seen = both.groupBy("url_hash").agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.max_by("last_error", "last_seen_at").alias("last_error"),
        F.max(F.when(F.length(F.trim("last_error")) > 0, F.col("last_seen_at"))).alias("last_failure_at"))
    return seen.withColumn("next_run_at", F.col("last_seen_at") + F.expr("INTERVAL 3 DAYS"))


def derive_page_times(df: DataFrame) -> DataFrame:
    """Columns that are set when a page row is written."""
    failed = F.length(F.trim(F.col("last_error"))) > 0
    return df.withColumns({
        "first_seen_at": F.coalesce("first_seen_at", "last_seen_at"),
        "next_run_at": F.col("last_seen_at") + F.expr("INTERVAL 3 DAYS"),
        "last_failure_at": F.when(failed, F.col("last_seen_at")),
        "last_success_at": F.when(~F.coalesce(failed, F.lit(False)), F.col("last_seen_at")),
    })


def insert_new(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``updates`` whose key is not in the target, one per key (the first by ``order``)."""
    rest = [c for c in updates.columns if c not in keys]
    first = (updates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
             .select(*keys, "_r.*").select(*updates.columns))
    return anti_join(first, target, keys)


def history_delta(current: DataFrame, history: DataFrame, key: str, value: str, ts: str, tie: str,
                  mode: str = "changes") -> DataFrame:
    """Rows of ``current`` to append to a history.

    ``changes`` appends a row only when the value differs from the newest one,
    ``all`` appends every row.
    """
    if mode == "all":
        return current
    last = history.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias("_last"))
    return (current.join(last, key, "left")
            .filter(~F.col(value).eqNullSafe(F.col("_last"))).select(*current.columns))


def retain(df: DataFrame, ts: str, as_of, days: int = 90) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; the bound reaches the scan."""
    return df.filter(F.col(ts) >= F.lit(as_of) - F.make_dt_interval(F.lit(days)))


def purge_competitor(tables: dict[str, DataFrame], competitor_id: int) -> dict[str, DataFrame]:
    """Remove a competitor with its pages, products, accounts and their dependants."""
    links = {  # child: (child key, parent table, parent key)
        "page_snapshots": ("page_url_hash", "web_pages", "url_hash"),
        "price_history": ("product_id", "products", "id"),
        "stock_history": ("product_id", "products", "id"),
        "social_posts": ("account_id", "social_accounts", "id"),
        "social_account_metrics": ("account_id", "social_accounts", "id"),
        "social_account_links": ("account_id", "social_accounts", "id"),
    }
    out = dict(tables)
    if "competitors" in tables:
        out["competitors"] = tables["competitors"].filter(F.col("id") != competitor_id)
    for name in ("web_pages", "products", "social_accounts", "competitor_social_score_history"):
        if name in tables:
            out[name] = tables[name].filter(F.col("competitor_id") != competitor_id)
    for name, (key, parent, parent_key) in links.items():
        if name in tables and parent in tables:
            gone = tables[parent].filter(F.col("competitor_id") == competitor_id).select(F.col(parent_key).alias(key))
            out[name] = tables[name].join(gone, key, "left_anti")
    return out


def replace_set(feed: DataFrame, column: str) -> DataFrame:
    """Distinct members of a feed; they replace the reference set. An empty feed changes nothing."""
    return feed.select(column).filter(F.length(F.trim(column)) > 0).distinct()
