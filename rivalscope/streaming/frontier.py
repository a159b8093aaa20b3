"""URL de-duplication, job state, leases, retries and batch selection.

A job event has url_id, domain, event (queued, inflight, completed, failed),
ts, and optionally error and priority.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.relational import anti_join
from ..shipping import ship

ship(__name__)

STATE_SCHEMA = ("url_id string, domain string, status string, retries int, last_error string, "
                "updated_at timestamp, due_at timestamp")


def dedup_seen(stream: DataFrame, key: str = "url_id", ts: str = "ts", ttl: str = "3 days") -> DataFrame:
    """First sighting of each URL within the time to live."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def dedup_seen_batch(df: DataFrame, key: str = "url_id", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Batch twin: the first row per key."""
    order = F.struct(ts, tie) if tie else F.struct(ts)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def unseen(urls: DataFrame, seen: DataFrame, key: str = "url_id") -> DataFrame:
    """URLs not yet in the frontier."""
    return anti_join(urls, seen, [key])


def retry_delay(attempt: Column, base: float = 10.0, multiplier: float = 2.0, cap: float = 300.0) -> Column:
    """Seconds to wait before an attempt: exponential with a cap."""
    exponent = F.greatest(F.lit(0), attempt - 1)
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(float(multiplier)), exponent))


def retry_plan(failures: DataFrame, retries: str = "retries", failed_at: str = "failed_at", max_retries: int = 3,
               base: float = 10.0, multiplier: float = 2.0, cap: float = 300.0) -> DataFrame:
    """Next state of failed jobs: scheduled again with a due time, or failed for good."""
    n = F.col(retries)
    dead = n > max_retries
    wait = retry_delay(n, base, multiplier, cap)
    return (df_with_delay(failures, wait, dead)
            .withColumn("next_retry_at", F.when(~dead, F.col(failed_at) + F.make_dt_interval(
                F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)")))))


def df_with_delay(failures: DataFrame, wait: Column, dead: Column) -> DataFrame:
    return failures.withColumn("status", F.when(dead, "failed").otherwise("retry_scheduled")).withColumn(
        "delay_seconds", F.when(~dead, wait))


def job_state_batch(events: DataFrame, tie: str, max_retries: int = 3) -> DataFrame:
    """Batch twin of :func:`job_state` without due times: newest event, failure count, newest error."""
    failed = F.col("event") == "failed"
    newest = F.struct("ts", tie)
    g = events.groupBy("url_id").agg(
        F.max_by("domain", newest).alias("domain"), F.max_by("event", newest).alias("event"),
        F.count_if(failed).alias("retries"),
        F.max_by("error", F.when(failed, newest)).alias("last_error"))
    status = (F.when((F.col("event") == "failed") & (F.col("retries") <= max_retries), "retry_scheduled")
              .otherwise(F.col("event")))
    return g.select("url_id", "domain", status.alias("status"), "retries", "last_error")


class JobStateProcessor(StatefulProcessor):
    """State of one URL, replayed in event time.

    Events wait in a list until the watermark has passed them, so none of them can
    still be preceded by another; then they are applied in the order of ``(ts, tie)``,
    and what falls due in between (a lease, a retry) is applied at its own time. The
    outcome doesn't depend on how events were spread over batches. One timer a URL
    stands at the next instant that matters: a waiting event, a due time, or the end
    of the time a finished URL is remembered, when its state is removed.
    """

    def __init__(self, lease_seconds: float | None, max_retries: int, base: float, multiplier: float, cap: float,
                 keep_seconds: float | None, requeue: bool, tie: str | None) -> None:
        self.lease_seconds, self.max_retries = lease_seconds, max_retries
        self.base, self.multiplier, self.cap = base, multiplier, cap
        self.keep_seconds, self.requeue, self.tie = keep_seconds, requeue, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE_SCHEMA.replace("url_id string, ", ""))
        self.waiting = handle.getListState("waiting", "ts timestamp, tie long, domain string, event string, error string")

    def _load(self) -> dict | None:
        if not self.state.exists():
            return None
        names = ["domain", "status", "retries", "last_error", "updated_at", "due_at"]
        return dict(zip(names, self.state.get()))

    def _wait(self, attempt: int) -> dt.timedelta:
        return dt.timedelta(seconds=min(self.cap, self.base * self.multiplier ** max(0, attempt - 1)))

    def _fail(self, job: dict, error: str | None, at: dt.datetime) -> None:
        job["retries"] += 1
        job["last_error"] = error
        dead = job["retries"] > self.max_retries
        job.update(status="failed" if dead else "retry_scheduled", updated_at=at,
                   due_at=None if dead or not self.requeue else at + self._wait(job["retries"]))

    def _forget_at(self, job: dict | None) -> dt.datetime | None:
        """When a finished URL is forgotten."""
        if job is None or self.keep_seconds is None or job["status"] not in ("completed", "failed"):
            return None
        return job["updated_at"] + dt.timedelta(seconds=self.keep_seconds)

    def _apply(self, job: dict | None, event: tuple) -> dict:
        at, _, domain, kind, error = event
        if job is None:
            job = dict(domain=domain, status=None, retries=0, last_error=None, updated_at=at, due_at=None)
        job["domain"] = domain
        if kind == "failed":
            self._fail(job, error, at)
        else:
            lease = kind == "inflight" and self.lease_seconds is not None
            job.update(status=kind, updated_at=at, due_at=at + dt.timedelta(seconds=self.lease_seconds) if lease else None)
        return job

    def _pass_time(self, job: dict | None, at: dt.datetime, changes: list[dict]) -> dict | None:
        """Apply what falls due before ``at``, and note each change."""
        while job is not None and job["due_at"] is not None and job["due_at"] < at:
            due = job["due_at"]
            if job["status"] == "inflight":
                self._fail(job, "lease expired", due)
            else:
                job.update(status="queued", updated_at=due, due_at=None)
            changes.append(dict(job))
        forget = self._forget_at(job)
        return None if forget is not None and forget < at else job

    def _set_timer(self, job: dict | None, waiting: list[tuple]) -> None:
        """One timer, just after the earliest instant that matters."""
        instants = [e[0] for e in waiting]
        if job is not None:
            instants += [t for t in (job["due_at"], self._forget_at(job)) if t is not None]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if instants:
            self.handle.registerTimer(int(pd.Timestamp(min(instants), tz="UTC").timestamp() * 1000) + 1)

    def _events(self) -> list[tuple]:
        return [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            ties = batch[self.tie] if self.tie else [0] * len(batch)
            new += [(r.ts.to_pydatetime(), int(t), r.domain, r.event, r.error) for r, t in zip(batch.itertuples(), ties, strict=True)]
        self.waiting.appendList(new)
        self._set_timer(self._load(), self._events())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms").to_pydatetime()
        before, waiting = self._load(), sorted(self._events(), key=lambda e: e[:2])
        job = None if before is None else dict(before)
        ripe, changes = [e for e in waiting if e[0] < now], []
        for event in ripe:
            job = self._apply(self._pass_time(job, event[0], changes), event)
            changes.append(dict(job))
        job = self._pass_time(job, now, changes)
        if ripe:
            waiting = waiting[len(ripe):]
            self.waiting.clear()
            if waiting:
                self.waiting.put(waiting)
        if job is None:
            self.state.clear()
        elif job != before:
            self.state.update((job["domain"], job["status"], job["retries"], job["last_error"], job["updated_at"], job["due_at"]))
        self._set_timer(job, waiting)
        return iter([pd.DataFrame([{"url_id": key[0], **c} for c in changes])] if changes else [])

    def close(self) -> None:
        pass


def job_state(stream: DataFrame, watermark: str = "10 minutes", lease_seconds: float | None = 300.0, max_retries: int = 3,
              base: float = 10.0, multiplier: float = 2.0, cap: float = 300.0, keep_seconds: float | None = 259_200.0,
              requeue: bool = True, tie: str | None = None) -> DataFrame:
    """State row of each URL after every change, in order, events being applied in event time once the watermark has passed them.

    ``tie`` orders events of one instant. ``lease_seconds=None`` knows no leases, ``requeue=False`` leaves
    failed URLs waiting for a retry, ``keep_seconds`` is how long a completed or failed URL is remembered (None:
    for ever). Events older than the watermark when they arrive are dropped by Spark. Needs the RocksDB state
    store provider; state is one small row per URL and its events within the watermark's delay.
    """
    proc = JobStateProcessor(lease_seconds, max_retries, base, multiplier, cap, keep_seconds, requeue, tie)
    return (stream.withWatermark("ts", watermark).groupBy("url_id")
            .transformWithStateInPandas(proc, STATE_SCHEMA, "Update", "EventTime"))


def expired_leases(state: DataFrame, as_of, lease_seconds: int = 300) -> DataFrame:
    """Jobs in flight whose lease has run out."""
    deadline = F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    return state.filter((F.col("status") == "inflight") & (deadline <= as_of))


def lane(priority: str = "priority", threshold: int = 3) -> Column:
    """0 for the front lane, 1 for the back lane."""
    return F.when(F.col(priority) <= threshold, 0).otherwise(1)


def select_batch(state: DataFrame, cap: int = 10, n: int | None = None, due: Column | None = None,
                 lane_expr: Column | None = None, tie: str = "id") -> DataFrame:
    """Jobs to lease next: due ones, front lane first, at most ``cap`` per domain in flight.

    Free slots of a domain never exceed the cap, so Spark limits each domain to
    ``cap`` rows before the shuffle; a crowded domain is not sorted whole.
    """
    ready = state.filter((F.col("status") == "queued") | (due if due is not None else F.lit(False)))
    busy = state.groupBy("domain").agg(F.count_if(F.col("status") == "inflight").alias("_busy"))
    key = lane_expr if lane_expr is not None else lane()
    w = Window.partitionBy("domain").orderBy(key, "queued_at", tie)
    first = ready.withColumn("slot", F.row_number().over(w).cast("bigint")).filter(F.col("slot") <= cap)
    out = first.join(busy, "domain").filter(F.col("slot") <= F.lit(cap) - F.col("_busy")).drop("_busy")
    return out if n is None else out.orderBy("slot", "queued_at", tie).limit(n)


def cached_queries(requests: DataFrame, cache: DataFrame, key: str = "query") -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache and requests to run."""
    k = cache.select(key).distinct()
    return requests.join(k, key, "left_semi"), requests.join(k, key, "left_anti")
