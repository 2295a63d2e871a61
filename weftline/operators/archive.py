"""Content store, capture index, export and summaries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

TEXT_CAP = 200_000


def refused(status: Column, truncated: Column) -> Column:
    """Reason not to store a response, null if there is none."""
    return F.when(status == 304, "not_modified").when(~F.coalesce(status.between(200, 299), F.lit(False)), "not_ok").when(truncated, "truncated")


def store(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, records, refusals) of responses (ord, url, status, body, truncated).

    objects: (digest, size), one per content; records: (url, digest), the last one of each url by
    ord; refusals: (reason, n).
    """
    r = responses.withColumn("reason", refused(F.col("status"), F.coalesce("truncated", F.lit(False)))).withColumn("digest", F.sha2("body", 256))
    ok = r.where(F.col("reason").isNull() & F.col("body").isNotNull())
    objects = ok.groupBy("digest").agg(F.max(F.octet_length("body")).alias("size"))
    records = ok.groupBy("url").agg(F.max(F.struct("ord", "digest")).alias("r")).select("url", "r.digest")
    return objects, records, r.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(records: DataFrame) -> DataFrame:
    """(digest, n): contents that several urls share, the largest groups first."""
    return records.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "digest")


def bytes_written(responses: DataFrame, objects: DataFrame) -> DataFrame:
    """(written, deduplicated): bytes stored, and bytes that equal content saved."""
    whole = responses.where(refused(F.col("status"), F.coalesce("truncated", F.lit(False))).isNull()).agg(F.sum(F.octet_length("body")).cast("bigint").alias("all"))
    one = objects.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("written"))
    return one.select("written", (F.coalesce(whole.select("all").scalar(), F.lit(0)) - F.col("written")).alias("deduplicated"))


def captures(responses: DataFrame) -> DataFrame:
    """(key, timestamp, url, mime, status, digest): the capture index, unsorted.

    responses: (url, fetched_at, mime, status, digest); rows without url or time are left out.
    """
    own = responses.where(F.col("url").isNotNull() & F.col("fetched_at").isNotNull())
    return own.select(
        U.surt(F.col("url")).alias("key"), F.date_format("fetched_at", "yyyyMMddHHmmss").alias("timestamp"), "url", "mime", "status", "digest"
    ).distinct()


def merged(new: DataFrame, old: DataFrame) -> DataFrame:
    """Union of two capture indexes without repeats, in key and time order across files."""
    return new.unionByName(old).distinct().repartitionByRange("key", "timestamp").sortWithinPartitions("key", "timestamp")


def lookup(index: DataFrame, key: str) -> DataFrame:
    """Captures of one key, the oldest first; on a sorted table the filter reaches the row groups."""
    return index.where(F.col("key") == key).orderBy("timestamp", "url")


def prefix(index: DataFrame, start: str) -> DataFrame:
    """Captures whose key starts so; the lower bound lets sorted files be skipped."""
    return index.where((F.col("key") >= start) & F.col("key").startswith(start))


def newest(index: DataFrame) -> DataFrame:
    """(key, timestamp, url, digest): the last capture of each key."""
    return index.groupBy("key").agg(F.max(F.struct("timestamp", "url", "digest")).alias("c")).select("key", "c.*")


def export_records(page: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """The export record of each page row; with text and encoding if ``extracted`` is given.

    Rows written twice are one. Text is cut at 200,000 characters and null where empty.
    """
    keep = ["url", "final_url", "status", "depth", "title", "n_links", "words", "verdict", "duplicate_of", "error", "from_cache", "rendered"]
    out = page.select("ord", *keep, F.round("elapsed", 3).alias("elapsed")).dropDuplicates()
    if extracted is not None:
        more = extracted.select("ord", F.nullif(F.left("main_text", F.lit(TEXT_CAP)), F.lit("")).alias("text"), "encoding")
        out = out.join(more, "ord", "left")
    return out


def crawl_summary(page: DataFrame) -> DataFrame:
    """One row of totals over page rows, written twice or not."""
    p = page.select("ord", "status", "error", "verdict", "rendered", "from_cache", "words", "n_links", "url").dropDuplicates()
    yes = lambda c: F.count(F.when(c, 1))
    return p.agg(
        F.count(F.lit(1)).alias("pages"), yes(F.col("error").isNotNull()).alias("errors"), yes(F.col("status").between(200, 299)).alias("ok"),
        F.countDistinct(U.authority(F.col("url"))).alias("hosts"), yes(F.col("rendered")).alias("rendered"), yes(F.col("from_cache")).alias("from_cache"),
        yes(F.col("verdict").isin("exact_duplicate", "near_duplicate")).alias("duplicates"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("links"),
    )


def page_event(page: DataFrame) -> DataFrame:
    """The thirteen fields of each page that a viewer gets, with the host it ended on."""
    host = U.authority(F.coalesce(F.nullif("final_url", F.lit("")), "url"))
    same = ["url", "final_url", "status", "depth", "title", "error", "verdict", "duplicate_of", "words", "from_cache"]
    return page.select(*same, F.col("n_links").alias("links"), F.round("elapsed", 3).alias("elapsed"), host.alias("host")).distinct()


def summary_event(pages: DataFrame, rejected: DataFrame | None = None, seeds: list[str] | None = None, objects: int = 0, records: int = 0) -> DataFrame:
    """One row of all totals of a crawl: counts of pages, errors, hosts, verdicts, refusals by reason,
    bytes, revalidated pages, the busiest host, the span of time, and what was stored.

    pages: (url, status, error, verdict) and, where known, (fetched_at, elapsed, body_bytes, from_cache);
    rejected: (url, reason).
    """
    has = lambda c, kind: F.col(c) if c in pages.columns else F.lit(None).cast(kind)
    p = pages.select("url", "status", "error", "verdict", has("fetched_at", "timestamp").alias("at"), has("elapsed", "double").alias("took"), has("body_bytes", "bigint").alias("size"), has("from_cache", "boolean").alias("cached"))
    count_of = lambda df, c: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c).cast("string"), F.col("n"))))).alias("m"))
    none = F.create_map().cast("map<string,bigint>")
    yes = lambda c: F.count(F.when(c, 1))
    begin = F.unix_micros(F.col("at").cast("timestamp"))
    total = p.agg(
        yes(F.col("error").isNull()).alias("pages"), yes(F.col("error").isNotNull()).alias("errors"), F.countDistinct(U.authority(F.col("url"))).alias("hosts_seen"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_downloaded"), yes((F.col("status") == 304) | F.coalesce("cached", F.lit(False))).alias("not_modified"),
        F.round((F.max(begin + F.coalesce("took", F.lit(0.0)) * 1_000_000) - F.min(begin)) / 1_000_000, 2).alias("duration"), F.round(F.sum("took"), 1).alias("worker_seconds"),
    )
    out = total.crossJoin(F.broadcast(count_of(p, "verdict").withColumnRenamed("m", "dedup")))  # one row each
    if rejected is not None:
        traps, robots = rejected.where("reason <> 'robots'"), rejected.where("reason = 'robots'").agg(F.count(F.lit(1)).alias("blocked_by_robots"))
        out = out.crossJoin(F.broadcast(count_of(traps, "reason").withColumnRenamed("m", "rejected_by_traps"))).crossJoin(F.broadcast(robots))
    else:
        out = out.withColumn("rejected_by_traps", none).withColumn("blocked_by_robots", F.lit(0).cast("bigint"))
    return out.withColumns({
        "dedup": F.coalesce("dedup", none), "rejected_by_traps": F.coalesce("rejected_by_traps", none), "generated": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm"),
        "seeds": F.array(*[F.lit(s) for s in seeds or []]).cast("array<string>"), "stored_objects": F.lit(objects), "warc_records": F.lit(records),
    })


def triage_reasons(found: DataFrame) -> DataFrame:
    """(ord, reasons): why a browser would add something; from extraction alone.

    found: (ord, main_text, links, script_bytes, body_bytes, empty_app_root, noscript_hint).
    """
    words = F.size(F.filter(F.split(F.coalesce("main_text", F.lit("")), "\\s+"), lambda w: w != ""))
    share = F.when(F.col("body_bytes") > 0, F.col("script_bytes") / F.col("body_bytes")).otherwise(F.lit(0.0))
    links = F.coalesce(F.size("links"), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(F.col("empty_app_root"), "empty_app_root"), F.when(F.col("noscript_hint"), "noscript_hint"),
        F.when((words < 25) & (share > 0.30), "thin_and_script_heavy"),
        F.when((links <= 0) & (F.col("script_bytes") > 0) & (words < 25), "no_links_with_scripts"),
    ))
    return found.select("ord", reasons.alias("reasons"))


def diff(expected: DataFrame, got: DataFrame, trap: str) -> DataFrame:
    """(path, kind): missing and extra paths; extra ones that match ``trap`` are traps."""
    e, g = expected.select("path").distinct(), got.select("path").distinct()
    miss = e.join(g, "path", "left_anti").withColumn("kind", F.lit("missing"))
    extra = g.join(e, "path", "left_anti").withColumn("kind", F.when(F.col("path").rlike(trap), "trap").otherwise("extra"))
    return miss.unionByName(extra)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given columns, nulls first; with partial results per task."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_r"))
    return last.select(key, "_r.*")
