"""Operators on small cases: search, duplicates, frontier, freshness, archive, sources, streams."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import archive as A
from weftline.operators import dedup as D
from weftline.operators import freshness as FR
from weftline.operators import frontier as FN
from weftline.operators import search as S

DOC = "doc_id bigint, title string, text string, url string"


def index(spark, *docs):
    return S.Index(spark.createDataFrame([(i, t, x, f"u{i}") for i, (t, x) in enumerate(docs)], DOC))


def hits(ix, q, limit=10):
    return [r.doc_id for r in sorted(ix.search({1: q}, limit).collect(), key=lambda r: r.rank)]


def test_parse_query():
    assert S.parse_query('web "quick brown" fox') == (["web", "fox"], [["quick", "brown"]])
    assert S.parse_query('"crawler"') == (["crawler"], []) and S.parse_query('web "crawler politeness') == (["web", "crawler", "politeness"], [])
    assert S.parse_query('"" crawler') == (["crawler"], []) and S.parse_query(None) == ([], [])


def test_ranking(spark):
    assert hits(index(spark, (None, "crawler " + "padding " * 200), (None, "crawler")), "crawler") == [1, 0]
    assert hits(index(spark, *[(None, "politeness matters")] * 30, (None, "politeness simhash")), "politeness simhash")[0] == 30
    assert hits(index(spark, ("other", "crawlers here"), ("Crawlers", "none")), "crawlers")[0] == 1
    assert hits(index(spark, (None, None), (None, "")), "x") == []


def test_phrases(spark):
    ix = index(spark, (None, "the quick brown fox"), (None, "brown quick the fox"), ("Web Crawler", "Politeness means waiting"))
    assert hits(ix, '"quick brown"') == [0] and hits(ix, '"crawler politeness"') == [] and hits(ix, '"web crawler"') == [2] and hits(ix, '"crawler web"') == []
    assert sorted(hits(ix, "fox")) == [0, 1]


def test_lengths_and_positions(spark):
    ix = index(spark, ("A", "one two three"))
    assert ix.docs.first().len == 5
    assert {(r.term, tuple(r.positions)) for r in ix.postings().collect()} == {("a", (0, 1001)), ("one", (2002,)), ("two", (2003,)), ("three", (2004,))}


def test_bm25_equals_brute_force(spark):
    import math

    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    docs = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(3, 30))) for _ in range(60)]
    ix = index(spark, *[(None, d) for d in docs])
    got = {(r.query_id, r.doc_id): r.score for r in ix.search({1: "w0 w5", 2: "w9"}, 100).collect()}
    toks = [d.split() for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    want = {}
    for q, terms in ((1, ("w0", "w5")), (2, ("w9",))):
        for i, t in enumerate(toks):
            s = 0.0
            for w in terms:
                n = sum(w in x for x in toks)
                if w in t:
                    f = t.count(w)
                    s += math.log(1 + (len(toks) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if s:
                want[q, i] = round(s, 6)
    assert got == want


def test_ngrams(spark):
    docs = spark.createDataFrame([(1, "", "redirects"), (2, "", "crawler"), (3, "", "redirect " * 50)], "doc_id bigint, title string, text string")
    got = {r.doc_id: r.score for r in S.Search(S.Index(docs, url=None), {1: "redirect"}, grams=True).cosine().collect()}
    assert got[3] == 1.0 and 0.8 < got[1] < 1 and 2 not in got


def test_verdicts_equal_a_pass_in_order(spark):
    """Random fingerprints with near and equal ones among them, against the pass itself."""
    rng = random.Random(8)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            x = base
            for b in rng.sample(range(64), rng.choice([0, 0, 2, 4, 5, 7])):
                x ^= 1 << b
            fps.append(x)
    rng.shuffle(fps)
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    records = spark.createDataFrame([(i, f"u{i}", text(i), None) for i in range(len(fps))], "ord bigint, url string, text string, canonical string")
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.ord: (r.verdict, r.duplicate_of, r.distance) for r in D.verdicts(records, spark.createDataFrame(list(enumerate(signed)), "ord bigint, fp bigint")).collect()}
    kept, want = [], {}
    for i, x in enumerate(fps):
        near = [(next(b for b in range(8) if not ((x ^ y) >> 8 * b) & 255), j, (x ^ y).bit_count()) for j, y in kept if (x ^ y).bit_count() <= 6]
        want[i] = ("near_duplicate", f"u{min(near)[1]}", min(near)[2]) if near else ("new", None, None)
        if not near:
            kept.append((i, x))
    assert got == want


def test_blocks_grow_with_the_number_of_fingerprints():
    for n in (10, 10_000, 10**6, 10**9):
        m = D.blocks_for(n)
        assert (m - 6) * (64 // m) >= __import__("math").log2(n)


def test_fusion(spark):
    r = lambda ids: spark.createDataFrame([(1, k + 1, d) for k, d in enumerate(ids)], "query_id int, rank int, doc_id bigint")
    out = sorted(S.fused({"a": r([1, 2]), "b": r([2, 3])}).collect(), key=lambda x: x.rank)
    assert [x.doc_id for x in out] == [2, 1, 3] and out[0].ranks == "a#2, b#1"


def test_greedy_near_duplicates_are_not_components(spark):
    fp = spark.createDataFrame([(1, 0x00), (2, 0x0F), (3, 0xFF)], "ord bigint, fp bigint")
    pairs = D.near_pairs(fp)
    assert sorted((r.a, r.b, r.distance, r.band) for r in pairs.collect()) == [(1, 2, 4, 1), (2, 3, 4, 1)]
    assert {r.ord: r.rep for r in D.classes(fp.union(fp.selectExpr("ord + 10", "fp"))).collect()} == {1: 1, 2: 2, 3: 3, 11: 1, 12: 2, 13: 3}
    assert {r.ord: r.kept for r in D.kept_first(pairs).collect()} == {1: True, 2: False, 3: True}


def test_pairs_within_six_bits_are_all_found(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 8))) for b in base]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in D.near_pairs(spark.createDataFrame(list(enumerate(signed)), "ord bigint, fp bigint")).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if 0 < (prints[i] ^ prints[j]).bit_count() <= 6}


def test_verdicts(spark):
    long = " ".join(f"word{i} more{i * i}" for i in range(60))
    rows = [
        (1, "a", long, None), (2, "b", "  " + long.replace(" ", "\n"), "b"), (3, "a", long, None), (4, "c", long + " tail", "other"), (5, "d", "five words are too few", None),
        (6, "e", "generated filler " * 400, None), (7, "f", "generated filler " * 400 + " tail", None), (8, "g", None, None), (9, "h", "", None), (None, "i", long, None),
    ]
    got = {r.ord: (r.verdict, r.duplicate_of) for r in D.verdicts(spark.createDataFrame(rows, "ord bigint, url string, text string, canonical string")).collect()}
    assert got == {
        1: ("new", None), 2: ("exact_duplicate", "a"), 3: ("already_seen", "a"), 4: ("canonical_alias", "other"), 5: ("new", None), 6: ("new", None), 7: ("new", None),
        8: ("new", None), 9: ("exact_duplicate", "g"),
    }
    prints = spark.createDataFrame([(1, 0)], "ord bigint, fp bigint")
    assert D.verdicts(spark.createDataFrame([], "ord bigint, url string, text string, canonical string"), prints).count() == 0


def test_shape_budget(spark):
    urls = spark.createDataFrame([(i, f"http://h/gen/{i}") for i in range(6)] + [(9, "http://h/other/1"), (10, None)], "ord bigint, url string")
    got = {r.ord: r.reason for r in FN.admitted(urls, 3).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "shape_budget", 4: "shape_budget", 5: "shape_budget", 9: None}


def test_robots(spark):
    body = "User-agent: crawler\nDisallow: /private/\nAllow: /private/public-corner\nDisallow: /files/*.png$\nDisallow: /x\nAllow: /x\n\nUser-agent: *\nDisallow: /files/*.pdf$\nCrawl-delay: 0.2\nCrawl-delay: soon\n"
    files = spark.createDataFrame([("h", 200, body), ("gone", 404, ""), ("down", 503, ""), ("none", None, None)], "host string, status int, body string")
    urls = ["http://h/private/public-corner", "http://h/private/secret", "http://h/files/logo.png", "http://h/x", "http://h/a", "http://gone/a", "http://down/a", "http://none/a", "http://unknown/a"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.allowed for r in FN.robots_allowed(df, FN.robots_rules(files, "Crawler/1.0")).collect()}
    assert [got[u] for u in urls] == [True, False, False, True, True, True, False, False, True]
    other = spark.createDataFrame([("http://h/files/report.pdf",), ("http://h/files/report.pdf.txt",)], "url string")
    assert [r.allowed for r in sorted(FN.robots_allowed(other, FN.robots_rules(files, "otherbot")).collect())] == [False, True]
    pace = spark.createDataFrame([("h", 86400.0), ("g", None)], "host string, crawl_delay double")
    assert {r.host: r.delay for r in FN.delays(pace, 0.1, 0.0, 5.0).collect()} == {"h": 5.0, "g": 0.1}


def test_sitemaps():
    assert FN.parse_sitemap("<urlset><url><loc> a </loc>") == (False, []) and FN.parse_sitemap(None) == (False, [])
    assert FN.parse_sitemap("<urlset><url><loc> a </loc></url><url/></urlset>") == (False, [("a", None)])


def test_levels_and_redirects(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.node: r.depth for r in FN.levels(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a": 0, "b": 1, "c": 2}
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("l", "m"), ("m", "l"), *[(f"n{i}", f"n{i + 1}") for i in range(7)]], "url string, target string")
    got = {r.url: r.final for r in FN.resolve_redirects(hops).collect()}
    assert got["a"] == "c" and got["b"] == "c" and got["l"] is None and got["n0"] is None and got["n2"] == "n7"


EV = "event_id bigint, url string, now_s double, etag string, last_modified string, content_hash string, not_modified boolean, body_bytes bigint, links array<string>"


def plain_fold(events):
    out = {}
    for e in sorted({x[0]: x for x in events}.values(), key=lambda x: (x[2], x[0])):
        _, u, now, etag, mod, digest, same, size, links = e
        p = out.get(u)
        if same:
            saved = p["body"] if p else 0
            etag, mod = etag or (p and p["etag"]), mod or (p and p["mod"])
            digest, size, links, changed = (p["hash"], p["body"], p["links"], False) if p else (None, 0, [], False)
        else:
            saved, changed = 0, bool(p and digest is not None and p["hash"] is not None and digest != p["hash"])
        every = 3600.0 if p is None else min(max(p["every"] / 2 if changed else p["every"] * 2, 60.0), 2592000.0)
        out[u] = {"etag": etag, "mod": mod, "hash": digest, "body": size or 0, "links": links or [], "every": every, "due": now + every, "checks": (p["checks"] if p else 0) + 1, "changes": (p["changes"] if p else 0) + changed, "saved": (p["saved"] if p else 0) + saved}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    events = []
    for i in range(400):
        same = rng.random() < 0.4
        events.append((i, rng.choice("aaab") + str(rng.randint(0, 2)), float(rng.randint(0, 200) * 900), rng.choice([None, "e1", "e2"]), None, None if same or rng.random() < 0.1 else rng.choice("xyz"), same, None if same else rng.randint(0, 99), None if same else ["l"]))
    events += events[:20]
    got = {r.url: r for r in FR.fold(spark.createDataFrame(events, EV), slice_s=7200.0).collect()}
    want = plain_fold(events)
    assert set(got) == set(want)
    for u, w in want.items():
        g = got[u]
        assert (g.etag, g.content_hash, g.body_bytes, g.links, g.interval_s, g.next_due, g.checks, g.changes, g.bytes_saved) == (w["etag"], w["hash"], w["body"], w["links"], w["every"], w["due"], w["checks"], w["changes"], w["saved"])


def test_fold_of_nothing(spark):
    assert FR.fold(spark.createDataFrame([(1, None, 1.0, None, None, None, False, 1, [])], EV)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from weftline.streaming import flows

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = [(i, f"u{i % 3}", float(i * 600), f"e{i}", None, "xy"[(i // 4) % 2], i % 5 == 4, 10, []) for i in range(24)]
    df = spark.createDataFrame(events, EV)
    for k in range(3):
        df.where(f"event_id div 8 = {k}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = flows.freshness(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = A.latest(spark.read.parquet(out), "url", "checks")
    want = {r.url: (r.interval_s, r.checks, r.changes, r.content_hash) for r in FR.fold(df).collect()}
    assert {r.url: (r.interval_s, r.checks, r.changes, r.content_hash) for r in last.collect()} == want


def test_stream_seen_set(spark, tmp_path):
    from weftline.streaming import flows

    src = str(tmp_path / "in")
    for part in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(x,) for x in part], "url string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(src)
    sink = flows.into_table(str(tmp_path / "seen"), "url")
    q = flows.unseen(stream).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "seen")).collect()) == ["a", "b", "c"]


def test_store(spark):
    rows = [(1, "u", 200, b"x", False), (2, "v", 200, b"x", False), (3, "u", 200, b"y", False), (4, "w", 304, b"", False), (5, "w", 500, b"e", False), (6, "t", 200, b"four", True), (7, "n", None, None, None)]
    objects, records, refusals = A.store(spark.createDataFrame(rows, "ord bigint, url string, status int, body binary, truncated boolean"))
    assert objects.count() == 2 and {r.url for r in records.collect()} == {"u", "v"}
    assert {r.reason: r.n for r in refusals.collect()} == {"not_modified": 1, "not_ok": 2, "truncated": 1}


def test_captures(spark):
    rows = [("com,h)/a", "2020", "http://h.com/a"), ("com,h)/a", "2019", "http://h.com/a"), ("com,h)/b", "2021", "http://h.com/b")]
    ix = spark.createDataFrame([(*r, "m", 200, "d") for r in rows], "key string, timestamp string, url string, mime string, status int, digest string")
    assert [r.timestamp for r in A.lookup(ix, "com,h)/a").collect()] == ["2019", "2020"] and A.prefix(ix, "com,h)/").count() == 3
    assert {r.key: r.timestamp for r in A.newest(ix).collect()} == {"com,h)/a": "2020", "com,h)/b": "2021"} and A.merged(ix, ix).count() == 3


def test_warc_round_trip(spark, tmp_path):
    import json

    from weftline.sources import warc

    warc.register(spark)
    at = str(tmp_path / "w")
    rows = [(f"http://h/{i}", 200, "OK", "HTTP/1.1", {"content-type": "text/html", "content-encoding": "gzip"}, b"body \r\n\r\n" + bytes([i])) for i in range(5)] + [("http://h/none", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "url string, status int, reason string, http_version string, headers map<string,string>, body binary")
    df.repartition(2).write.format("warc").mode("append").save(at)
    got = spark.read.format("warc").load(at)
    pages = got.where("warc_type = 'response'").collect()
    assert sorted((r.url, bytes(r.body)) for r in pages) == sorted((r[0], r[5]) for r in rows[:5])
    assert all("content-encoding" not in r.headers and r.headers["content-type"] == "text/html" for r in pages)
    one = pages[0]
    again = spark.read.format("warc").option("records", json.dumps([[one.filename, one.offset, one.length]])).load(at).collect()
    assert len(again) == 1 and again[0].url == one.url and bytes(again[0].body) == bytes(one.body)


def test_text_tables(spark, tmp_path):
    from weftline.sources import tables

    ix = spark.createDataFrame([("k b", "2", "u", "m", 200, "d", 5, 6, "f"), ("a", "1", "u", "m", None, "d", 5, 6, "f")], "key string, timestamp string, url string, mime string, status int, digest string, offset bigint, length bigint, filename string")
    ix = ix.withColumn("key", F.replace("key", F.lit(" "), F.lit("")))
    tables.write_cdxj(ix.unionByName(ix), str(tmp_path / "c"))
    back = tables.read_cdxj(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.select(ix.columns).collect()), key=str) == sorted(map(tuple, ix.collect()), key=str)
    (tmp_path / "d.jsonl").write_text('{"url":"a","final_url":"","text":"t"}\n\n{"url":"b","text":""}\n{"final_url":"c","text":"x","title":"T"}\n')
    assert sorted((r.url, r.text) for r in tables.read_documents(spark, str(tmp_path / "d.jsonl")).collect()) == [("a", "t"), ("c", "x")]


def test_reader(spark):
    from weftline.operators import reader

    page = b"<title>T</title><body><p>Hello <a href='/x'>you</a>"
    responses = [("http://a/1", "http://a/1", 200, "text/html; charset=utf-8", page, None), ("http://a/2", None, 404, "text/html", b"no", None), ("http://a/3", None, 200, "image/png", b"x", None), ("http://a/4", None, None, None, None, "timeout"), ("http://b/1", None, 200, "text/html", page, None)]
    df = spark.createDataFrame(responses, "url string, final_url string, status int, content_type string, body binary, error string")
    asked = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a/1", "http://a/2", "http://a/3", "http://a/4", "http://b/1", "http://c/1", "http://a/1"])], "ord bigint, url string")
    rules = FN.robots_rules(spark.createDataFrame([("b", 503, "")], "host string, status int, body string"), "me")
    got = {r.ord: r for r in reader.read(asked, df, rules).collect()}
    assert len(got) == 7 and got[0].markdown == "Hello [you](http://a/x)" and got[0].words == 2 and got[0].n_links == 1 and got[0].title == "T" and got[6].markdown == got[0].markdown
    assert [got[i].error for i in range(1, 6)] == ["http 404", "not html (image/png)", "timeout", "blocked by robots.txt", "no response"]
    assert all(got[i].markdown is None and got[i].words is None for i in range(1, 6))


def test_sql_functions(spark):
    from weftline.functions import registry

    registry.register(spark)
    row = spark.sql("SELECT url_normalize('HTTP://H:80/a/../b?utm_id=1') AS u, to_markdown(CAST('<body><h1>x</h1>' AS BINARY), 'http://h/', 'text/html') AS m").first()
    assert row.u == "http://h/b" and row.m == "# x"
    assert spark.sql("SELECT * FROM robots_rules(200, 'User-agent: *\\nDisallow: /a', 'me')").first().regex == "^/a"


def test_index_is_saved(spark, tmp_path):
    ix = index(spark, ("A", "one two"), (None, "two"))
    ix.save(str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix" / "postings")).count() == 4 and spark.read.parquet(str(tmp_path / "ix" / "stats")).first().version == 2


def test_crawl(spark):
    from weftline.operators import crawl as C

    page = lambda body, head="": f"<html><head><title>t</title>{head}</head><body>{body}</body></html>".encode()
    words = " ".join(f"word{i}" for i in range(60))
    site = {
        "http://h/": page('<a href="/a">a</a><a href="/b">b</a><a href="/private/x">x</a><a href="http://other/z">z</a><a href="/gone">g</a>' + words),
        "http://h/a": page('<a href="/c">c</a><a href="/a#top">self</a> unlike ' + words[::-1]),
        "http://h/b": page('<a href="/only-from-copy">n</a><a href="/c">c</a>').replace(b"<body>", b"<body>" + b"q " * 9),
        "http://h/c": page("end"),
        "http://h/copy": page("end"),
        "http://h/private/x": page("secret"),
    }
    rows = [(u, u, 200, "text/html", b, None) for u, b in site.items()]
    answers = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body binary, error string")
    seeds = spark.createDataFrame([("HTTP://H:80/",), ("http://h/copy",), ("nonsense",)], "url string")
    rules = FN.robots_rules(spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /private")], "host string, status int, body string"), "me")
    pages, rejected = C.crawl(seeds, answers, rules, max_depth=3)
    got = {r.url: r for r in pages.collect()}
    assert {u: r.depth for u, r in got.items()} == {"http://h/": 0, "http://h/copy": 0, "http://h/a": 1, "http://h/b": 1, "http://h/gone": 1, "http://h/c": 2, "http://h/only-from-copy": 2}
    assert got["http://h/c"].verdict == "exact_duplicate" and got["http://h/c"].duplicate_of == "http://h/copy" and got["http://h/gone"].error == "no response"
    assert sorted(r.ord for r in got.values()) == sorted({r.ord for r in got.values()}) and [(r.url, r.reason) for r in rejected.collect()] == [("http://h/private/x", "robots")]
    few, _ = C.crawl(seeds, answers, rules, max_depth=3, max_pages=3)
    assert few.count() == 3


def test_folding_is_exact_in_the_index(spark):
    ix = index(spark, (None, "the \ufb01le \uff26ull width and \u00bd of it"), ("Stra\u00dfe", "other"))
    found = lambda q: [r.doc_id for r in ix.search({1: q}).collect()]
    assert found("file") == [0] and found("full") == [0] and found("STRASSE") == [1] and found("\ufb01le") == [0]


def test_a_batch_too_large_to_send_is_joined(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(None, " ".join(rng.choices([f"w{i}" for i in range(12)], k=20))) for _ in range(40)]
    ix = index(spark, *docs)
    asked = spark.createDataFrame([(1, "w0 w5"), (2, '"w1 w2" w3'), (3, None), (4, ""), (None, "w1"), (1, "w7")], "query_id int, query string")
    sent = sorted(map(tuple, ix.search(asked, 5).collect()))
    assert {q for q, *_ in sent} == {1, 2}
    monkeypatch.setattr(S, "ASKED_ROWS", 1)
    assert sorted(map(tuple, ix.search(asked, 5).collect())) == sent


def test_search_of_nothing(spark):
    ix = index(spark, ("", ""), (None, None))
    one = S.Search(ix, {1: '"a b" c'}, grams=True)
    assert one.bm25().count() == 0 and one.cosine().count() == 0 and one.phrase_hits().count() == 0
    assert S.Search(index(spark, ("a", "b")), {}).bm25().count() == 0


def test_saved_index_searches_alike(spark, tmp_path):
    ix = index(spark, ("Web Crawler", "the quick brown fox"), (None, "brown quick the fox fox"), ("A", "quick quick"))
    ix.save(str(tmp_path / "ix"))
    asked = {1: "quick fox", 2: '"quick brown"', 3: "nothing"}
    assert sorted(map(tuple, S.SavedIndex(spark, str(tmp_path / "ix")).search(asked).collect())) == sorted(map(tuple, ix.search(asked).collect()))


def test_response_predicates(spark):
    from weftline.functions import response as R

    df = spark.createDataFrame([(200, None, "Text/HTML", b"abcd", {"content-encoding": "gzip"}, "a; charset='X-1'"), (304, None, None, None, None, None), (200, "e", "x", b"", {}, "y")], "status int, error string, ct string, body binary, headers map<string,string>, h string")
    c = F.col
    got = df.select(R.ok(c("status"), c("error")), R.not_modified(c("status")), R.is_html(c("ct")), R.truncated(c("body"), 4), R.content_encoded(c("headers")), R.header_charset(c("h"))).collect()
    assert [tuple(r) for r in got] == [(True, False, True, True, True, "x-1"), (False, True, False, False, False, None), (False, False, False, False, False, None)]
