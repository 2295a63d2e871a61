"""Lines repeated across one site's documents.

The lines of each site form a graph: a node is a line (spelling normalised), weighted with the
number of records it stands in; an edge joins two lines that stand next to each other, weighted
with the number of records in which they do. Nodes and edges of high support are kept, the
connected components of what is left are the site's boilerplate blocks, and occurrences of a
block's lines are deleted from every record.

Support is counted within each record first (one row per record and distinct line), so counting is
a plain sum with partial sums before the shuffle, and a site that holds a third of all records is
spread over its lines. Lines travel as 64-bit hashes of (site, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, small

#: White space as in Unicode's and Python's reading, for both regex dialects in use.
SPACE = "[\\t\\n\\u000b\\f\\r\\u001c-\\u001f \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def line_key(line: Column) -> Column:
    """A line lower-cased, each run of white space one space, trimmed, digit runs made ``0``."""
    one = F.regexp_replace(F.lower(line), SPACE + "+", " ")
    return F.regexp_replace(F.regexp_replace(one, "^ | $", ""), "[0-9]+", "0")


def site_of(url: Column) -> Column:
    """Host of a url in lower case, without user, port and leading ``www.``; null without host."""
    host = F.regexp_extract(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\\.)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def sites(page: DataFrame) -> DataFrame:
    """(ord, site) of page rows, one row per ord: final_url, or url where that is null.

    Rows written twice count once; where copies of an ord differ, the least final_url holds. A null
    ord has no row.
    """
    return (
        page.where(F.col("ord").isNotNull())
        .groupBy("ord")
        .agg(F.min("final_url").alias("_f"), F.min("url").alias("_u"))
        .select("ord", site_of(F.coalesce("_f", "_u")).alias("site"))
    )


def lines(records: DataFrame, site: DataFrame, text: str = "main_text") -> DataFrame:
    """(ord, site_, keys): the record's line keys in order as hashes of (site, line), 0 for blank.

    A record without a page row takes the host of its own url; records without host or text have no
    row.
    """
    own = records.where(F.col("ord").isNotNull() & F.col(text).isNotNull()).select(
        "ord", F.col(text).alias("_t"), site_of(F.col("url")).alias("_own")
    )
    both = own.join(site.select("ord", "site"), "ord", "left").select(
        "ord", F.coalesce("site", "_own").alias("site_"), F.split("_t", "\n", -1).alias("_l")
    )
    key = lambda x: F.when(line_key(x) == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.col("site_"), line_key(x)))
    return both.where(F.col("site_").isNotNull()).select("ord", "site_", F.transform("_l", key).alias("keys"))


def supported_nodes(keyed: DataFrame, support: int) -> DataFrame:
    """(key, n): lines that stand in at least ``support`` records of their site."""
    once = keyed.select(F.explode(F.array_distinct(F.filter("keys", lambda k: k != 0))).alias("key"))
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)


def supported_edges(keyed: DataFrame, nodes: DataFrame, support: int) -> DataFrame:
    """(a, b, n): neighbouring lines, both kept, that are neighbours in ``support`` records."""
    seq = F.filter("keys", lambda k: k != 0)
    n = F.size("_s") - 1
    pair = F.arrays_zip(F.slice("_s", 1, n).alias("a"), F.slice("_s", 2, n).alias("b"))
    pairs = (
        keyed.select(seq.alias("_s"))
        .where(F.size("_s") > 1)
        .select(F.explode(F.array_distinct(pair)).alias("e"))
        .select("e.a", "e.b")
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= support)
    )
    kept = nodes.select("key")
    return pairs.join(kept.withColumnRenamed("key", "a"), "a", "left_semi").join(
        kept.withColumnRenamed("key", "b"), "b", "left_semi"
    )


def components(edges: DataFrame) -> DataFrame:
    """(key, block): each node of ``edges`` with the least node of its connected component.

    Alternating large-star and small-star rounds until nothing changes: the number of rounds grows
    with the logarithm of the components' size, no node's neighbours are gathered in one row, and
    each round is written to the shared folder.
    """
    edge = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edge = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edge.groupBy("u").agg(F.min("v").alias("block")).select(F.col("u").alias("key"), "block").unionByName(
                edge.select(F.col("v").alias("key"), F.col("v").alias("block")).distinct()
            )
        last = now


def blocks(keyed: DataFrame, support: int) -> DataFrame:
    """(key, block, n): every kept line with its boilerplate block; lines alone are their own."""
    nodes = cut(supported_nodes(keyed, support))
    found = components(supported_edges(keyed, nodes, support))
    return nodes.join(found, "key", "left").select("key", F.coalesce("block", "key").alias("block"), "n")


#: Records of one line from which on its occurrences are spread over several tasks.
HOT = 1_000_000


def occurrences(keyed: DataFrame, kept: DataFrame, hot: int = HOT) -> DataFrame:
    """(ord, p, key, block): where the kept lines (key, block, n) stand, p counted from 0.

    A footer stands in every record of its site: the occurrences of a line of more than ``hot``
    records are dealt to several copies of its row. Such lines are few, at most one for ``hot``
    lines of the corpus.
    """
    kept = cut(kept)
    each = keyed.select("ord", F.posexplode("keys").alias("p", "key")).where("key <> 0")
    parts = F.ceil(F.col("n") / F.lit(float(hot))).cast("int")
    many = kept.where(F.col("n") > hot).select("key", parts.alias("_parts"))
    if not many.limit(1).count():
        return each.join(small(kept.select("key", "block")), "key")
    each = each.join(small(many), "key", "left").withColumn("_part", F.pmod(F.xxhash64("ord"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    rows = kept.select("key", "block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return each.join(rows, ["key", "_part"]).drop("_part")


def found_lines(records: DataFrame, page: DataFrame, support: int = 8, text: str = "main_text", hot: int = HOT) -> DataFrame:
    """(ord, line_no, block): occurrences of the blocks' lines, counted from 1.

    Null and empty texts, blank lines and repetition within one record count for nothing; a record
    without any host is left alone; further columns are ignored.
    """
    keyed = cut(lines(records, sites(page), text))  # read four times below; 8 bytes a line
    return occurrences(keyed, blocks(keyed, support), hot).select("ord", (F.col("p") + 1).cast("int").alias("line_no"), "block")


def site_blocks(records: DataFrame, page: DataFrame, support: int = 8, text: str = "main_text") -> DataFrame:
    """(site, line, support, block): the kept lines of each site with the records they stand in, and
    the least line of their block; lines are as ``line_key`` gives them."""
    site = sites(page)
    keyed = cut(lines(records, site, text))
    kept = cut(blocks(keyed, support))
    own = records.where(F.col("ord").isNotNull() & F.col(text).isNotNull()).select("ord", site_of(F.col("url")).alias("_own"), F.explode(F.array_distinct(F.split(text, "\n", -1))).alias("_l"))
    named = own.join(site, "ord", "left").select(F.coalesce("site", "_own").alias("site"), line_key(F.col("_l")).alias("line")).where("line <> ''")
    named = named.withColumn("key", F.xxhash64("site", "line")).join(small(kept), "key").groupBy("key").agg(
        F.min("site").alias("site"), F.min("line").alias("line"), F.min("n").alias("support"), F.min("block").alias("_b")
    )
    least = named.groupBy("_b").agg(F.min("line").alias("block"))
    return named.join(least, "_b").select("site", "line", "support", "block")


def remove_lines(records: DataFrame, page: DataFrame, support: int = 8, text: str = "main_text") -> DataFrame:
    """(ord, clean): each record's text without its boilerplate lines; null stays null.

    A text of which nothing is left is empty. The positions to delete are joined as one short array
    per record.
    """
    gone = found_lines(records, page, support, text).groupBy("ord").agg(F.collect_set(F.col("line_no") - 1).alias("_gone"))
    own = records.where(F.col("ord").isNotNull()).select("ord", F.col(text).alias("_t"))
    keep = F.array_join(F.filter(F.split("_t", "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return own.join(gone, "ord", "left").select("ord", F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(keep).alias("clean"))
