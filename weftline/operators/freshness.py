"""Adaptive recheck schedule: the fold of check events into one state per url.

A check sets the interval to half of the last one if the content changed, to twice if it did not,
within bounds. Such a step is x -> min(max(x * 2^a, low), high), and steps of this form compose to
one of the same form; so a url's events are folded slice of time by slice of time, each slice to one
short summary, and the summaries of a url are folded in turn. A url that holds a tenth or a third of
all events is spread over its slices, and no task holds more than a slice of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST, FIRST = 60.0, 30 * 24 * 3600.0, 3600.0
#: Seconds of a slice.
SLICE = 6 * 3600.0

def fold(events: DataFrame, slice_s: float = SLICE) -> DataFrame:
    """The state of each url after all its events.

    events: (event_id, url, now_s, etag, last_modified, content_hash, not_modified, body_bytes,
    links), ordered by (now_s, event_id); rows written twice count once, null urls and times not at
    all. ``not_modified`` keeps hash, bytes and links, and the validators where the event has none.
    Result: (url, etag, last_modified, content_hash, last_checked, next_due, interval_s, checks,
    changes, body_bytes, links, hits, bytes_saved); hits are the checks answered by not_modified.
    """
    cols = ["etag", "last_modified", "content_hash", "body_bytes", "links"]
    e = events.where(F.col("url").isNotNull() & F.col("now_s").isNotNull()).dropDuplicates(["event_id"])
    row = F.struct("now_s", "event_id", F.coalesce("not_modified", F.lit(False)).alias("same"), *cols)
    parts = e.groupBy("url", F.floor(F.col("now_s") / slice_s).alias("_slice")).agg(F.array_sort(F.collect_list(row)).alias("_e"))
    part = parts.select("url", F.struct("_slice", _reduce(F.col("_e"), _one).alias("s")).alias("p"))
    whole = part.groupBy("url").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    s = F.col("s")
    # The first check of all has no step. Checks before the first content only double the interval.
    lead = _clamp(F.lit(FIRST) * F.pow(F.lit(2.0), F.greatest(s["pre"] - 1, F.lit(0))))
    begun = F.when(s["pre"] > 0, _clamp(lead * 2)).otherwise(F.lit(FIRST))
    interval = F.when(s["fresh"], F.least(F.greatest(begun * F.pow(F.lit(2.0), s["up"]), s["low"]), s["high"])).otherwise(lead)
    return whole.select("url", _reduce(F.col("_p"), lambda p: p["s"]).alias("s")).select(
        "url", s["etag"].alias("etag"), s["last_modified"].alias("last_modified"), s["content_hash"].alias("content_hash"),
        s["now_s"].alias("last_checked"), (s["now_s"] + interval).alias("next_due"), interval.alias("interval_s"),
        s["checks"].alias("checks"), s["changes"].alias("changes"), s["body_bytes"].alias("body_bytes"),
        F.coalesce(s["links"], F.array().cast("array<string>")).alias("links"), s["hits"].alias("hits"), s["saved"].alias("bytes_saved"),
    )


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(LEAST)), F.lit(MOST))


def _reduce(items: Column, one) -> Column:
    """The summary of an ordered array that is not empty."""
    rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1)))
    return F.aggregate(rest, one(items[0]), lambda a, x: _join(a, one(x)))


def _one(x: Column) -> Column:
    """The summary of one event.

    ``pre`` counts the checks before the first content; ``first`` is that content's hash. The steps
    after it are x -> min(max(x * 2^up, low), high); its own step is left to the join, as it depends
    on what came before.
    """
    own = lambda v: F.when(~x["same"], v)
    n = lambda v: F.lit(v).cast("bigint")
    return F.struct(
        x["now_s"].alias("now_s"), x["etag"].alias("etag"), x["last_modified"].alias("last_modified"),
        (~x["same"]).alias("fresh"), own(x["content_hash"]).alias("first"), own(x["content_hash"]).alias("content_hash"),
        F.coalesce(own(x["body_bytes"]), n(0)).alias("body_bytes"), own(x["links"]).alias("links"),
        F.when(x["same"], n(1)).otherwise(n(0)).alias("pre"), n(0).alias("up"), F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"),
        n(1).alias("checks"), n(0).alias("changes"), F.when(x["same"], n(1)).otherwise(n(0)).alias("hits"), n(0).alias("saved"),
    )


def _join(a: Column, b: Column) -> Column:
    """The summary of a's events followed by b's."""
    changed = a["fresh"] & b["fresh"] & F.coalesce(a["content_hash"] != b["first"], F.lit(False))
    # Steps between a's and b's own: b's leading checks double, its first content halves or doubles.
    up = lambda x, k: _clamp(x * F.pow(F.lit(2.0), k))
    turn = F.when(changed, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    through = lambda x: F.when(
        b["fresh"], F.least(F.greatest(up(up(x, b["pre"]), turn) * F.pow(F.lit(2.0), b["up"]), b["low"]), b["high"])
    ).otherwise(up(x, b["pre"]))
    shift = a["up"] + b["pre"] + F.when(b["fresh"], turn + b["up"]).otherwise(F.lit(0).cast("bigint"))
    valid = lambda n: F.when(b["fresh"], b[n]).otherwise(F.coalesce(b[n], a[n]))
    content = lambda n: F.when(b["fresh"], b[n]).otherwise(a[n])
    own = lambda mine, theirs: F.when(a["fresh"], mine).otherwise(theirs)
    return F.struct(
        b["now_s"].alias("now_s"), valid("etag").alias("etag"), valid("last_modified").alias("last_modified"),
        (a["fresh"] | b["fresh"]).alias("fresh"), own(a["first"], b["first"]).alias("first"), content("content_hash").alias("content_hash"),
        content("body_bytes").alias("body_bytes"), content("links").alias("links"),
        own(a["pre"], a["pre"] + b["pre"]).alias("pre"), own(shift, b["up"]).alias("up"),
        own(through(a["low"]), b["low"]).alias("low"), own(through(a["high"]), b["high"]).alias("high"),
        (a["checks"] + b["checks"]).alias("checks"), (a["changes"] + b["changes"] + changed.cast("bigint")).alias("changes"),
        (a["hits"] + b["hits"]).alias("hits"), (a["saved"] + b["saved"] + F.when(a["fresh"], b["pre"] * a["body_bytes"]).otherwise(F.lit(0))).alias("saved"),
    )


def due(states: DataFrame, now: float, limit: int | None = 1000) -> DataFrame:
    """(url, next_due): urls to check at ``now``, the most overdue first."""
    rows = states.where(F.col("next_due") <= F.lit(now)).select("url", "next_due").orderBy("next_due", "url")
    return rows if limit is None else rows.limit(limit)


def validators(states: DataFrame) -> DataFrame:
    """(url, if_none_match, if_modified_since): headers of a conditional request."""
    return states.select("url", F.nullif("etag", F.lit("")).alias("if_none_match"), F.nullif("last_modified", F.lit("")).alias("if_modified_since"))


def change_rate(states: DataFrame) -> DataFrame:
    return states.select("url", F.coalesce(F.try_divide(F.col("changes"), F.col("checks")), F.lit(0.0)).alias("change_rate"))
