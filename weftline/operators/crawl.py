"""The crawl as a dataflow over a table of responses: requests, gates, pages, verdicts, links.

A round takes one level of the link graph: requests that were not seen, in scope, allowed by robots
and admitted by the trap guard meet their responses; pages are parsed once; verdicts of all pages so
far decide whose links are followed. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions import response as R
from ..functions import url as U
from ..plans.shared import cut, running_sum
from . import dedup, frontier

FOLLOWED = ("new", "canonical_alias")


def numbered(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """``rows`` with ``ord``: consecutive numbers from ``start`` in the given total order."""
    one = running_sum(rows.withColumn("_all", F.lit(0)), "_all", order, F.lit(1), "_n")
    return one.withColumn("ord", (F.col("_n") + F.lit(start - 1)).cast("bigint")).drop("_all", "_n")


def expandable_links(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(ord, url, pos, link): links of pages that are neither copies nor seen already."""
    keep = verdicts.where(F.col("verdict").isin(*FOLLOWED)).select("ord")
    return pages.join(keep, "ord", "left_semi").select("ord", "url", F.posexplode("links").alias("pos", "link"))


def within_budget(requests: DataFrame, most: int) -> DataFrame:
    """The first ``most`` requests by ord."""
    return requests.orderBy("ord").limit(most)


def merged_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(reason, n): the greater count of each reason of two tallies."""
    return a.unionByName(b).groupBy("reason").agg(F.max("n").alias("n"))


def paths(pages: DataFrame, host: str) -> DataFrame:
    return pages.where(U.authority(F.col("url")) == host).select(U.path(F.col("url")).alias("path")).distinct()


def crawl(
    seeds: DataFrame, responses: DataFrame, rules: DataFrame | None = None, max_depth: int = 3, max_pages: int = 1_000_000
) -> tuple[DataFrame, DataFrame]:
    """(pages, rejected) of a crawl that starts at the seeds' urls.

    responses: (url, final_url, status, content_type, body, error), one per canonical url; urls
    without a response are failed pages. pages: (ord, url, depth, status, title, links, main_text,
    words, canonical, error, verdict, duplicate_of, distance); rejected: (url, reason).
    """
    start = seeds.select(U.canonical_url("url").alias("url")).where("url is not null").distinct()
    scope = cut(start)
    level = cut(numbered(start.withColumn("depth", F.lit(0)), ["url"], 1))
    pages = rejected = None
    taken = 0
    for depth in range(max_depth + 1):
        admitted = frontier.admitted(level.select("ord", "url") if pages is None else level.select("ord", "url").unionByName(pages.select("ord", "url")))
        admitted = admitted.join(level.select("ord", "depth"), "ord")
        if rules is not None:
            admitted = admitted.join(frontier.robots_allowed(level, rules), "url", "left").withColumn(
                "reason", F.coalesce("reason", F.when(~F.col("allowed"), "robots"))
            ).drop("allowed")
        gate = cut(admitted)
        bad = gate.where(F.col("reason").isNotNull()).select("url", "reason")
        rejected = bad if rejected is None else rejected.unionByName(bad)
        asked = within_budget(gate.where(F.col("reason").isNull()).select("ord", "url", "depth"), max(0, max_pages - taken))
        got = asked.join(responses, "url", "left")
        good = R.ok(F.col("status"), F.col("error")) & R.is_html(F.col("content_type"))
        x = html.extracted("_b", "url", "content_type")
        new = cut(
            got.withColumn("_b", F.when(good, F.col("body"))).withColumn("x", x).select(
                "ord", "url", "depth", "status", "x.title", F.coalesce("x.links", F.array().cast("array<string>")).alias("links"), "x.main_text", "x.canonical",
                F.size(F.filter(F.split(F.coalesce("x.main_text", F.lit("")), " "), lambda w: w != "")).alias("words"),
                F.when(F.col("status").isNull() & F.col("error").isNull(), "no response").otherwise(F.col("error")).alias("error"),
            )
        )
        pages = new if pages is None else pages.unionByName(new)
        taken += new.count()
        found = dedup.verdicts(pages.where(F.col("main_text").isNotNull()).select("ord", "url", F.col("main_text").alias("text"), "canonical"))
        judged = cut(found.select("ord", "verdict", "duplicate_of", "distance"))
        if depth == max_depth or taken >= max_pages:
            break
        links = expandable_links(new, judged).select("ord", "pos", U.canonical_url("link").alias("url")).where("url is not null")
        first = links.groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("f"))
        seen = pages.select("url").unionByName(rejected.select("url"))
        fresh = frontier.in_scope(first.join(seen, "url", "left_anti"), scope).select("url", F.col("f.ord").alias("_o"), F.col("f.pos").alias("_p"))
        top = pages.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
        level = cut(numbered(fresh, ["_o", "_p", "url"], top + 1).select("ord", "url", F.lit(depth + 1).alias("depth")))
        if not level.limit(1).count():
            break
    return pages.join(judged, "ord", "left"), rejected
