"""Command line: ``python -m weftline.cli crawl|index|search ...`` over tables of responses and documents."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import archive, crawl, frontier, search
from .sources import tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline")
    sub = out.add_subparsers(dest="what", required=True)
    c = sub.add_parser("crawl", help="crawl a table of responses from seeds")
    c.add_argument("seeds", nargs="+", help="urls, or @FILE with one url a line")
    c.add_argument("--responses", required=True, help="parquet: url, final_url, status, content_type, body, error")
    c.add_argument("--robots", help="parquet: host, status, body")
    c.add_argument("--agent", default="weftline")
    c.add_argument("--max-pages", type=int, default=100)
    c.add_argument("--max-depth", type=int, default=5)
    c.add_argument("--export", help="folder for the pages as JSON lines")
    c.add_argument("--report", help="HTML file with the summary and the pages")
    c.add_argument("--verify", help="text file with the expected paths, one a line")
    i = sub.add_parser("index", help="build and save an index of exported documents")
    i.add_argument("documents", help="JSON lines with url, title, text")
    i.add_argument("path")
    s = sub.add_parser("search", help="search exported documents or a saved index")
    s.add_argument("source")
    s.add_argument("query", nargs="+")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--saved", action="store_true", help="the source is a saved index")
    s.add_argument("--explain", action="store_true")
    s.add_argument("--hybrid", action="store_true", help="fuse BM25 with character n-grams")
    return out


def seeds_of(spark: SparkSession, given: list[str]):
    """(url) from arguments; ``@FILE`` names a text file with one url a line, blank lines left out."""
    out = spark.createDataFrame([(u,) for u in given if not u.startswith("@")], "url string")
    for name in (u[1:] for u in given if u.startswith("@")):
        out = out.unionByName(spark.read.text(name).select(F.trim("value").alias("url")).where("url <> ''"))
    return out


def numbered(spark: SparkSession, path: str):
    """Documents of an export with ids in the order of their urls."""
    return crawl.numbered(tables.read_documents(spark, path), ["url", "title", "text"], 0).withColumnRenamed("ord", "doc_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.what == "crawl":
        rules = frontier.robots_rules(spark.read.parquet(a.robots), a.agent) if a.robots else None
        pages, rejected = crawl.crawl(seeds_of(spark, a.seeds), spark.read.parquet(a.responses), rules, a.max_depth, a.max_pages)
        total = archive.summary_event(pages, rejected)
        total.show(truncate=False, vertical=True)
        if a.export:
            tables.write_export(pages.select("url", "status", "depth", "title", F.size("links").alias("n_links"), "words", "verdict", "duplicate_of", "error", F.col("main_text").alias("text")), a.export)
        if a.report:
            tables.write_report(total, pages.select("url", "status", "depth", "title", "words", "verdict", "error"), a.report)
        if a.verify:
            want = spark.read.text(a.verify).select(F.trim("value").alias("path")).where("path <> ''")
            found = archive.diff(want, pages.select(F.regexp_extract("url", "^[^:]+://[^/]*([^?#]*)", 1).alias("path")), "$^")
            found.show(truncate=False)
            return int(found.limit(1).count() > 0)
    elif a.what == "index":
        search.Index(numbered(spark, a.documents)).save(a.path)
    else:
        query = {1: " ".join(a.query)}
        if a.saved:
            got = search.SavedIndex(spark, a.source).search(query, a.limit)
        else:
            one = search.Search(search.Index(numbered(spark, a.source)), query, grams=a.hybrid)
            got = search.fused({"bm25": one.bm25(50), "ngram": one.cosine(50)}, a.limit) if a.hybrid else one.bm25(a.limit, explain=a.explain)
        got.orderBy("rank").show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
