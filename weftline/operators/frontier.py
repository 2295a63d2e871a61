"""Frontier: admission, queue order, politeness, robots, sitemaps, link graph and redirects."""

from __future__ import annotations

import re
from itertools import count, groupby
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

from ..functions import url as U
from ..plans.shared import cut, running_sum

MAX_SITEMAP_URLS, MAX_SITEMAP_DEPTH = 50_000, 3


def admitted(urls: DataFrame, budget: int = U.BUDGET) -> DataFrame:
    """(ord, url, reason): the trap guard over urls in discovery order; null reason is admission.

    The budget of a shape counts admitted urls alone. The first ``budget`` of each shape are found
    with a window that Spark cuts before its shuffle; a shape of a third of all urls sends
    ``budget`` rows per task. Null urls are left out.
    """
    own = urls.where(F.col("url").isNotNull()).select("ord", "url", U.trap(F.col("url")).alias("_r"), U.shape(F.col("url")).alias("_s"))
    w = Window.partitionBy("_s").orderBy("ord", "url")
    first = own.where(F.col("_r").isNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= budget)
    last = first.groupBy("_s").agg(F.max(F.struct("ord", "url")).alias("_last"), F.max("_k").alias("_k"))
    over = (F.col("_k") >= budget) & (F.struct("ord", "url") > F.col("_last"))
    return own.join(last, "_s", "left").select(
        "ord", "url", F.coalesce("_r", F.when(F.coalesce(over, F.lit(False)), "shape_budget")).alias("reason")
    )


def tally(admissions: DataFrame) -> DataFrame:
    return admissions.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def queue_order(requests: DataFrame) -> DataFrame:
    """(host, url, place): place of each request in its host's queue by priority, then order.

    Requests seen twice keep their first place. A host of a third of all requests is spread over
    tasks.
    """
    first = requests.groupBy("url").agg(F.min(F.struct("priority", "ord")).alias("q")).select("url", "q.*")
    own = first.withColumn("host", U.authority(F.col("url")))
    return running_sum(own, "host", ["priority", "ord", "url"], F.lit(1), "place").select("host", "url", F.col("place").cast("int").alias("place"))


def delays(hosts: DataFrame, default: float = 0.0, least: float = 0.0, most: float = 30.0) -> DataFrame:
    """(host, delay): robots' delay or the default, within bounds; hosts: (host, crawl_delay)."""
    return hosts.select("host", F.least(F.greatest(F.coalesce("crawl_delay", F.lit(default)), F.lit(least)), F.lit(most)).alias("delay"))


def schedule(queue: DataFrame, pace: DataFrame) -> DataFrame:
    """(host, url, start_s): start to start, one slot for each request of a host."""
    return queue.join(pace, "host").select("host", "url", ((F.col("place") - 1) * F.col("delay")).alias("start_s"))


def busiest(spans: DataFrame) -> DataFrame:
    """(host, peak): the most requests of a host in flight at once; spans: (host, begin, finish).

    Starts and ends are swept in order; at equal times ends come first.
    """
    ends = spans.select("host", F.col("begin").alias("at"), F.lit(1).alias("d")).unionByName(spans.select("host", F.col("finish").alias("at"), F.lit(-1).alias("d")))
    moves = ends.groupBy("host", "at", "d").agg(F.sum("d").alias("s"))
    return running_sum(moves, "host", ["at", "d"], F.col("s"), "n").groupBy("host").agg(F.max("n").alias("peak"))


# -- robots ------------------------------------------------------------------


def robots_fields(body: str) -> list[tuple[str, str]]:
    """(field, value) of each line of a robots.txt that has one; fields in lower case."""
    bare = (line.split("#", 1)[0] for line in body.splitlines())
    pairs = ((f.strip().lower(), v.strip()) for f, v in (x.split(":", 1) for x in bare if ":" in x))
    return [(f, v) for f, v in pairs if f or v]


def _seconds(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def robots_groups(body: str) -> tuple[list[dict], list[str]]:
    """(groups, sitemaps) of a robots.txt; a group has agents, rules and a delay.

    The file is runs of user-agent lines, each followed by the run of lines that hold for those
    agents. An empty Disallow and a bad delay say nothing; the last sound delay holds.
    """
    fields = robots_fields(body)
    runs = [(named, list(part)) for named, part in groupby(fields, key=lambda x: x[0] == "user-agent")]
    follow = {k: part for k, (named, part) in enumerate(runs) if not named}
    groups = []
    for k, (named, part) in enumerate(runs):
        if named:
            own = follow.get(k + 1, [])
            pace = [s for f, v in own if f == "crawl-delay" and (s := _seconds(v)) is not None]
            rules = [(f == "allow", v) for f, v in own if f == "allow" or (f == "disallow" and v)]
            groups.append({"agents": [v.lower() for _, v in part], "rules": rules, "delay": pace[-1] if pace else None})
    return groups, [v for f, v in fields if f == "sitemap"]


def pattern_regex(pattern: str) -> str:
    """Regular expression of a rule: ``*`` is anything, a final ``$`` an anchor, the rest itself."""
    stop = pattern.endswith("$")
    parts = (pattern[:-1] if stop else pattern).split("*")
    return "^" + ".*".join(re.sub(r"([^\w/])", r"\\\1", p) for p in parts) + ("$" if stop else "")


def agent_rules(status: int | None, body: str | None, agent: str) -> tuple[str, float | None, list[tuple[bool, str, int]], list[str]]:
    """(mode, delay, rules, sitemaps) for one agent; rules: (allow, regex, length of pattern)."""
    if status is None or status >= 500:
        return "none", None, [], []
    if status >= 400:
        return "all", None, [], []
    groups, maps = robots_groups(body or "")
    agent = agent.lower()
    named = [(len(a), -i) for i, g in enumerate(groups) for a in g["agents"] if a != "*" and a in agent]
    star = [i for i, g in enumerate(groups) if "*" in g["agents"]]
    pick = groups[-max(named)[1]] if named else groups[star[0]] if star else None
    if pick is None:
        return "all", None, [], maps
    return "rules", pick["delay"], [(a, pattern_regex(p), len(p)) for a, p in pick["rules"]], maps


_RULES = "struct<mode:string,delay:double,rules:array<struct<allow:boolean,regex:string,size:int>>,sitemaps:array<string>>"


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, mode, delay, rules, sitemaps) of robots files (host, status, body) for one agent."""
    names = ["mode", "delay", "rules", "sitemaps"]
    kinds = pa.struct([("mode", pa.string()), ("delay", pa.float64()), ("rules", pa.list_(pa.struct([("allow", pa.bool_()), ("regex", pa.string()), ("size", pa.int32())]))), ("sitemaps", pa.list_(pa.string()))])

    @arrow_udf(_RULES)
    def parse(status: pa.Array, body: pa.Array) -> pa.Array:
        out = []
        for s, b in zip(status.to_pylist(), body.to_pylist()):
            mode, delay, rules, maps = agent_rules(s, b, agent)
            out.append(dict(zip(names, (mode, delay, [dict(zip(("allow", "regex", "size"), r)) for r in rules], maps))))
        return pa.array(out, kinds)

    return robots.select("host", parse("status", "body").alias("r")).select("host", "r.*")


@arrow_udf(StringType())
def decoded_path(path: pa.Array) -> pa.Array:
    return pa.array([None if p is None else unquote(p) or "/" for p in path.to_pylist()], pa.string())


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed): the longest matching rule decides, allow wins a tie, no rule allows.

    A host's rules are one array in its one row, so a url meets them in one equi-join; hosts without
    a row are allowed.
    """
    own = urls.select("url").distinct().withColumn("host", U.authority(F.col("url")))
    q = U.query(F.col("url"))
    target = decoded_path(F.concat(U.path(F.col("url")), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
    both = own.withColumn("_p", target).join(rules.select("host", "mode", "rules"), "host", "left")
    match = F.filter("rules", lambda r: F.regexp_like("_p", r["regex"]))
    best = F.array_max(F.transform(match, lambda r: F.struct(r["size"].alias("s"), r["allow"].alias("a"))))
    allowed = F.when(F.col("mode") == "none", False).when(F.coalesce(F.col("mode"), F.lit("all")) == "all", True).otherwise(F.coalesce(best["a"], F.lit(True)))
    return both.select("url", allowed.alias("allowed"))


# -- sitemaps ----------------------------------------------------------------


def parse_sitemap(body: bytes | str | None) -> tuple[bool, list[tuple[str, str | None]]]:
    """(is_index, [(url, lastmod)]); malformed XML is an empty sitemap."""
    try:
        root = ElementTree.fromstring(body or b"")
    except ElementTree.ParseError:
        return False, []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    index = local(root) == "sitemapindex"
    want = "sitemap" if index else "url"
    out = []
    for node in root.iter():
        if local(node) != want:
            continue
        loc = next((c.text for c in node if local(c) == "loc" and (c.text or "").strip()), None)
        if loc is None:
            continue
        mod = node.find("{http://www.sitemaps.org/schemas/sitemap/0.9}lastmod")
        out.append((loc.strip(), (mod.text or "").strip() if mod is not None else None))
        if len(out) >= MAX_SITEMAP_URLS:
            break
    return index, out


_SITEMAP = pa.struct([("is_index", pa.bool_()), ("entries", pa.list_(pa.struct([("url", pa.string()), ("lastmod", pa.string())])))])


@arrow_udf(from_arrow_type(_SITEMAP))
def sitemap_entries(body: pa.Array) -> pa.Array:
    rows = []
    for b in body.to_pylist():
        index, got = parse_sitemap(b)
        rows.append({"is_index": index, "entries": [{"url": u, "lastmod": m} for u, m in got]})
    return pa.array(rows, _SITEMAP)


def expand_sitemaps(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """(url, lastmod): pages named by the seeds' sitemaps and those nested in them, to depth 3.

    files: (url, body) of fetched sitemaps; a sitemap that is named again is not read again.
    """
    parsed = cut(files.select("url", sitemap_entries("body").alias("m")).select("url", "m.is_index", F.explode("m.entries").alias("e")))
    level, seen, pages = seeds.select("url").distinct(), None, None
    for _ in range(MAX_SITEMAP_DEPTH + 1):
        hit = parsed.join(level, "url", "left_semi")
        found = hit.where(~F.col("is_index")).select("e.url", "e.lastmod")
        pages = found if pages is None else pages.unionByName(found)
        seen = level if seen is None else seen.unionByName(level)
        level = cut(hit.where("is_index").select("e.url").distinct().join(seen, "url", "left_anti"))
        if not level.limit(1).count():
            break
    return pages.groupBy("url").agg(F.max("lastmod").alias("lastmod"))


# -- graph -------------------------------------------------------------------


def levels(edges: DataFrame, seeds: DataFrame, most: int | None = 5) -> DataFrame:
    """(node, depth): breadth-first levels from the seeds over edges (src, dst), to depth ``most`` or,
    with None, to the end.

    Each round joins the last level alone and is written to the shared folder.
    """
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for depth in count(1) if most is None else range(1, most + 1):
        step = edges.join(level.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        level = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen


def resolve_redirects(hops: DataFrame, most: int = 5) -> DataFrame:
    """(url, final): where each url of hops (url, target) ends; null for loops and long chains.

    Pointers double in each round, so a chain of ``most`` hops takes the logarithm in rounds. A url
    with several targets follows the least.
    """
    one = hops.where(F.col("url").isNotNull() & F.col("target").isNotNull()).groupBy("url").agg(F.min("target").alias("at"))
    now = cut(one.withColumn("steps", F.lit(1)))
    done = 1
    while done <= most:
        nxt = now.select(F.col("url").alias("at"), F.col("at").alias("_to"), F.col("steps").alias("_s"))
        now = cut(now.join(nxt, "at", "left").select("url", F.coalesce("_to", "at").alias("at"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps")))
        done *= 2
    open_ = one.select(F.col("url").alias("at"), F.lit(True).alias("_more"))
    return now.join(open_, "at", "left").select("url", F.when(F.col("_more").isNull() & (F.col("steps") <= most), F.col("at")).alias("final"))


def in_scope(urls: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows of ``urls`` whose host is one of the seeds' hosts."""
    hosts = seeds.select(U.authority(F.col("url")).alias("_h")).distinct()
    return urls.withColumn("_h", U.authority(F.col("url"))).join(hosts, "_h", "left_semi").drop("_h")


def host(url: Column) -> Column:
    return U.authority(url)
