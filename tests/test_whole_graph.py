"""Walks over the link graph go as deep as it does."""

from weftline.functions import url as U
from weftline.queries import QUERIES
from weftline.queries_web import FN


def canonical(spark, urls):
    rows = spark.createDataFrame([(u,) for u in sorted(urls)], "u string").select("u", U.canonical_url("u").alias("c")).collect()
    return {r.u: r.c for r in rows if r.c}


def test_url_levels_equal_brute_force(spark, data, duck):
    links = duck.execute("SELECT url, unnest(links) FROM extracted").fetchall()
    seeds = {r[0] for r in duck.execute("SELECT url FROM page WHERE depth = 0 AND url IS NOT NULL").fetchall()}
    name = canonical(spark, {u for e in links for u in e if u} | seeds)
    out = {}
    for a, b in links:
        if name.get(a) and name.get(b):
            out.setdefault(name[a], set()).add(name[b])
    want = {name[u]: 0 for u in seeds if u in name}
    level = set(want)
    while level:
        depth = max(want.values()) + 1
        level = {b for a in level for b in out.get(a, ())} - set(want)
        want |= {u: depth for u in level}
    got = QUERIES["bfs_url_levels"](spark, data).collect()
    assert {r.node: r.depth for r in got} == want and len(got) == len(want)


def test_levels_go_to_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string")
    got = {r.node: r.depth for r in FN.levels(edges, spark.createDataFrame([("n0",)], "node string"), None).collect()}
    assert got == {f"n{i}": i for i in range(10)}


def test_crawl_goes_deeper_than_two(spark, data):
    assert QUERIES["crawl_pages"](spark, data).agg({"depth": "max"}).first()[0] > 2
