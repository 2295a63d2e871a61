"""Streams: seen-set, trap guard, per-host clocks, and the freshness fold as keyed state."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import url as U
from ..operators.freshness import FIRST, LEAST, MOST
from ..operators.frontier import admitted


def unseen(urls: DataFrame, event_time: str | None = None, late: str = "7 days") -> DataFrame:
    """First arrivals of each url; with an event time, what is older than ``late`` is forgotten."""
    if event_time is None:
        return urls.dropDuplicates(["url"])
    return urls.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["url"])


_STATE = "etag string, last_modified string, content_hash string, last_checked double, interval_s double, checks bigint, changes bigint, body_bytes bigint, links array<string>, last_event bigint"
_OUT = "url string, " + _STATE + ", next_due double"


def freshness(events: DataFrame) -> DataFrame:
    """The recheck state of each url after each micro-batch, one row per url in it.

    Events of a batch are taken in (now_s, event_id) order. Only what is greater in that order than
    the last event of the state counts: an event that is sent again in a later batch changes nothing,
    and what is older is late and left to the batch fold.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        s = list(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["now_s", "event_id"]).drop_duplicates("event_id")
        none = lambda v: None if pd.isna(v) else v
        for e in rows.itertuples():
            etag, modified, digest = none(e.etag), none(e.last_modified), none(e.content_hash)
            size = 0 if pd.isna(e.body_bytes) else int(e.body_bytes)
            if s is not None and (e.now_s, e.event_id) <= (s[3], s[9]):
                continue
            same = not pd.isna(e.not_modified) and bool(e.not_modified)
            links = list(e.links) if e.links is not None else []
            if s is None:
                s = [etag, modified, None if same else digest, float(e.now_s), FIRST, 1, 0, 0 if same else size, [] if same else links, int(e.event_id)]
                continue
            changed = not same and digest is not None and s[2] is not None and digest != s[2]
            interval = min(max(s[4] / 2 if changed else s[4] * 2, LEAST), MOST)
            if same:
                etag, modified, digest, size, links = etag or s[0], modified or s[1], s[2], s[7], list(s[8])
            s = [etag, modified, digest, float(e.now_s), interval, s[5] + 1, s[6] + changed, size, links, int(e.event_id)]
        if s is not None:
            state.update(tuple(s))
            yield pd.DataFrame([[key[0], *s, s[3] + s[4]]], columns=[c.split()[0] for c in _OUT.split(", ")])

    named = events.select("url", "event_id", "now_s", "etag", "last_modified", "content_hash", "not_modified", "body_bytes", "links")
    return named.where(F.col("url").isNotNull()).groupBy("url").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def admitted_batch(path: str, budget: int = U.BUDGET):
    """A ``foreachBatch`` sink of the trap guard: keeps (ord, url, reason) of each url once, as a table.

    The budget of a shape goes on over batches: what earlier batches admitted counts, and comes first.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("ord").alias("ord")).select("ord", "url")
        old = _earlier(spark, path, number)
        if old is not None:
            fresh = rows.join(old.select("url"), "url", "left_anti").select(F.struct(F.lit(1).alias("k"), F.col("ord").alias("o")).alias("ord"), "url")
            before = old.where("reason is null").select(F.struct(F.lit(0).alias("k"), F.col("ord").alias("o")).alias("ord"), "url")
            rows = admitted(before.unionByName(fresh), budget).where("ord.k = 1").select(F.col("ord.o").alias("ord"), "url", "reason")
        else:
            rows = admitted(rows, budget)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def _earlier(spark, path: str, number: int) -> DataFrame | None:
    """What batches other than ``number`` left in a table; None before the first."""
    try:
        return spark.read.parquet(path).where(F.col("batch") != number)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return None
        raise


def paced(requests: DataFrame, delay_s: float, clock=time.time) -> DataFrame:
    """(host, url, start_s): requests (host, url) of a stream, each host's at least ``delay_s`` apart.

    A host's clock is state: the time at which it may be asked next. Requests that meet a busy host
    wait in its state; a timer wakes the host when it is ready, without a new arrival.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        ready, waiting = state.get if state.exists else (0.0, [])
        waiting = list(waiting) + [u for f in frames for u in f["url"]]
        now, out = clock(), []
        while waiting and ready <= now:
            start = max(ready, now)
            out.append((key[0], waiting.pop(0), start))
            ready = start + delay_s
        state.update((ready, waiting))
        if waiting:
            state.setTimeoutDuration(max(1, int(1000 * (ready - now))))
        yield pd.DataFrame(out, columns=["host", "url", "start_s"])

    own = requests.where(F.col("host").isNotNull() & F.col("url").isNotNull()).select("host", "url")
    return own.groupBy("host").applyInPandasWithState(
        step, "host string, url string, start_s double", "ready double, waiting array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def into_table(path: str, key: str, keep=None):
    """A ``foreachBatch`` sink that adds to a parquet table the rows whose key it does not hold.

    A batch that is run again writes the same folder again, so nothing is added twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        old = _earlier(spark, path, number)
        if old is not None:
            rows = rows.join(old.select(key), key, "left_anti")
        rows = keep(rows) if keep else rows
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
