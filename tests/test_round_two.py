"""Store with bodies, replay, events, sources, streams and the shared frontier."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import archive as A
from weftline.operators import queue as Q
from weftline.operators import store as ST
from weftline.sources import tables, warc

RESP = "ord bigint, url string, status int, body binary, truncated boolean"


def test_content_store_keeps_bodies_once(spark, tmp_path):
    st = ST.ContentStore(spark, "file://" + str(tmp_path / "st"))
    put = lambda n, *rows: {r.reason: r.n for r in st.put(spark.createDataFrame(list(rows), RESP), n).collect()}
    assert put(1, (1, "u", 200, b"x", False), (2, "v", 200, b"x", False), (3, "w", 304, b"", False), (4, "n", None, None, None)) == {"not_modified": 1, "not_ok": 1}
    assert put(2, (5, "u", 200, b"y", False), (6, "t", 200, b"x", False), (7, "big", 200, b"z", True)) == {"truncated": 1}
    put(2, (5, "u", 200, b"y", False), (6, "t", 200, b"x", False), (7, "big", 200, b"z", True))  # tried again
    assert sorted(bytes(r.body) for r in st.objects().collect()) == [b"x", b"y"]
    got = {r.url: bytes(r.body) for r in st.read(spark.createDataFrame([("u",), ("v",), ("none",)], "url string")).collect()}
    assert got == {"u": b"y", "v": b"x"}
    digest = st.records().where("url = 'v'").first().digest
    assert [r.url for r in st.urls_for(digest).collect()] == ["t", "v"]


def test_replay_reads_the_newest_capture(spark, tmp_path):
    warc.register(spark)
    at = str(tmp_path / "w")
    rows = [(f"http://h.example/{i}", 200, "OK", "HTTP/1.1", {"content-type": "text/html" if i else "text/plain"}, f"<a href='/to{i}'>x</a>".encode()) for i in range(4)]
    spark.createDataFrame(rows, "url string, status int, reason string, http_version string, headers map<string,string>, body binary").repartition(2).write.format("warc").mode("append").save(at)
    found = spark.read.format("warc").load(at).where("warc_type = 'response'").select("url", "filename", "offset", "length")
    index = found.withColumn("key", F.col("url")).withColumn("timestamp", F.lit("2020")).unionByName(found.where("url like '%/1'").withColumn("key", F.lit("http://h.example/2")).withColumn("timestamp", F.lit("2019")))
    got = {r.url: r.links for r in ST.replayed(index, at).collect()}
    assert got == {"http://h.example/0": None, **{f"http://h.example/{i}": [f"http://h.example/to{i}"] for i in (1, 2, 3)}}
    one = spark.createDataFrame([("http://h.example/3",), ("http://none/",)], "url string")
    assert [r.url for r in ST.replayed(index, at, one).collect()] == ["http://h.example/3"]


def record(url, body):
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return head + body + b"\r\n\r\n"


def test_plain_and_damaged_warc_files(spark, tmp_path):
    warc.register(spark)
    records = [record(f"http://h/{i}", b"body \r\n\r\nWARC/1.1 " * i) for i in range(5)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    load = lambda n, **o: sorted(r.url for r in spark.read.format("warc").options(**o).load(str(tmp_path / n)).collect())
    assert load("plain.warc") == [f"http://h/{i}" for i in range(5)]
    zipped = [gzip.compress(r) for r in records]
    (tmp_path / "bad.warc.gz").write_bytes(zipped[0] + zipped[1][:30] + b"\0\0junk" + zipped[2] + zipped[3] + zipped[4][:-9])
    assert load("bad.warc.gz") == ["http://h/0", "http://h/2", "http://h/3"]
    with pytest.raises(Exception, match="no record at"):
        load("bad.warc.gz", strict="true")


def test_cdxj_source(spark, tmp_path):
    spark.dataSource.register(tables.CdxjSource)
    rows = [("com,h)/a", "2020", "http://h.com/a", "text/html", 200, "d", 5, 9, "f.warc.gz"), ("com,h)/b", "2021", "http://h.com/b b", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key string, timestamp string, " + tables.CDX)
    df.write.format("cdxj").mode("append").save(str(tmp_path / "ix"))
    (tmp_path / "ix" / "other").write_text("no line\nkey time {bad\n")
    assert sorted(map(tuple, spark.read.format("cdxj").load(str(tmp_path / "ix")).collect())) == rows
    assert sorted(map(tuple, tables.read_cdxj(spark, str(tmp_path / "ix")).where("url is not null").collect())) == rows


def test_events_and_report(spark, tmp_path):
    page = "url string, final_url string, status int, depth int, title string, n_links int, elapsed double, error string, verdict string, duplicate_of string, words int, from_cache boolean"
    df = spark.createDataFrame([("http://a/1", "http://b/2", 200, 0, "T </script>", 3, 0.12345, None, "new", None, 9, False), ("http://a/2", None, None, 1, None, None, None, "timeout", None, None, None, None)], page)
    ev = {r.url: r for r in A.page_event(df).collect()}
    assert ev["http://a/1"].host == "b" and ev["http://a/1"].elapsed == 0.123 and ev["http://a/2"].host == "a" and len(ev["http://a/1"]) == 13
    rejected = spark.createDataFrame([("x", "robots"), ("y", "path_too_deep"), ("z", "path_too_deep")], "url string, reason string")
    s = A.summary_event(df, rejected, ["http://a/1"]).first()
    assert (s.pages, s.errors, s.blocked_by_robots, s.rejected_by_traps, s.dedup, s.seeds) == (1, 1, 1, {"path_too_deep": 2}, {"new": 1}, ["http://a/1"])
    assert A.summary_event(df.limit(0)).first().pages == 0
    tables.write_report(A.summary_event(df, rejected), df.select("url", "title"), str(tmp_path / "r.html"))
    text = (tmp_path / "r.html").read_text()
    data = json.loads(text.split('id="data">')[1].split("</script>")[0].replace("<\\/", "</"))
    assert data["pages"][0]["title"] == "T </script>" and data["summary"]["pages"] == 1


def test_shared_frontier(spark, tmp_path):
    f = Q.SharedFrontier(spark, "file://" + str(tmp_path / "q"), delay_s=5.0)
    req = lambda *rows: spark.createDataFrame(list(rows), "url string, priority double, ord bigint")
    assert f.acquire("w", 0.0) is None and f.finished(0.0)
    f.push(req(("http://a/1", 1.0, 1), ("http://a/2", 0.0, 2), ("http://b/1", 1.0, 3), (None, 0.0, 4)), "w1")
    one = f.acquire("w1", 10.0, 60.0)
    assert sorted(r.url for r in one.collect()) == ["http://a/2", "http://b/1"], "one url of each host, the first in order"
    assert f.acquire("w2", 11.0, 60.0).count() == 0, "hosts with a live lease wait"
    f.release(one.where("url = 'http://a/2'"), "w1")
    assert f.acquire("w2", 12.0, 60.0).count() == 0, "and a host waits for its delay"
    assert [r.url for r in f.acquire("w2", 16.0, 60.0).collect()] == ["http://a/1"]
    # The first worker is gone: its url is free when the lease has run out, and its late report is rejected.
    again = f.acquire("w3", 75.0, 60.0)
    assert [r.url for r in again.collect()] == ["http://b/1"]
    f.release(one, "w1")
    assert not f.finished(80.0)
    f.push(req(("http://a/2", 0.0, 9)), "w3")  # known: not queued again
    f.release(again, "w3")
    f.release(f.acquire("w4", 200.0, 60.0), "w4")
    assert f.finished(300.0)


def test_stream_takes_an_event_once(spark, tmp_path):
    from weftline.streaming import flows

    kind = "event_id bigint, url string, now_s double, etag string, last_modified string, content_hash string, not_modified boolean, body_bytes bigint, links array<string>"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = (1, "u", 5.0, None, None, "h", False, 10, ["http://l/"])
    for rows in ([row], [row], [(2, "u", 9.0, None, None, None, True, None, None)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    q = flows.freshness(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = A.latest(spark.read.parquet(out), "url", "checks").first()
    assert (last.checks, last.interval_s, last.links, last.content_hash) == (2, 7200.0, ["http://l/"], "h")


def test_trap_budget_goes_on_over_batches(spark, tmp_path):
    from weftline.streaming import flows

    sink = flows.admitted_batch(str(tmp_path / "adm"), budget=3)
    df = lambda a, b: spark.createDataFrame([(i, f"http://h/p/{i}") for i in range(a, b)], "ord bigint, url string")
    sink(df(0, 2), 0)
    sink(df(1, 6), 1)
    sink(df(1, 6), 1)  # tried again
    got = {r.ord: r.reason for r in spark.read.parquet(str(tmp_path / "adm")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "shape_budget", 4: "shape_budget", 5: "shape_budget"}


def test_hosts_are_paced(spark, tmp_path):
    from weftline.streaming import flows

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", f"u{i}") for i in range(3)] + [("b", "v")], "host string, url string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("host string, url string").parquet(src)
    q = flows.paced(stream, 0.5).writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    import time

    begun = time.time()
    while time.time() - begun < 60:
        time.sleep(1)
        try:
            if spark.read.parquet(out).count() >= 4:
                break
        except Exception:  # noqa: BLE001 - nothing is written yet
            pass
    q.stop()
    rows = spark.read.parquet(out).collect()
    starts = sorted(r.start_s for r in rows if r.host == "a")
    assert sorted(r.url for r in rows) == ["u0", "u1", "u2", "v"] and all(b - a >= 0.5 - 1e-6 for a, b in zip(starts, starts[1:]))


def test_sql_names(spark):
    from weftline.functions import registry
    from weftline.functions import url as U

    registry.register(spark)
    urls = ["http://WWW.Example.com:8080/a/b?x=1", "https://10.0.0.1/", "http://h", "x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    df.createOrReplaceTempView("some_urls")
    assert {r.url: r.k for r in spark.sql("SELECT url, surt(url) AS k FROM some_urls").collect()} == {r.url: r.k for r in df.select("url", U.surt(F.col("url")).alias("k")).collect()}
    r = spark.sql("SELECT tokens('Straße ﬁle') AS t, shingles('a b c d e') AS s, char_grams('web') AS g, tokens(NULL) AS n").first()
    assert (r.t, r.s, r.g, r.n) == (["strasse", "file"], ["a b c d", "b c d e"], ["^we", "web", "eb$"], [])


def test_command_line(spark, tmp_path, capsys):
    body = b"<html><body><p>Lantern records of the archive.</p><a href='/b'>b</a></body></html>"
    rows = [(f"http://h.example/{x}", f"http://h.example/{x}", 200, "text/html", body.replace(b"Lantern", x.encode()), None) for x in "ab"]
    spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body binary, error string").write.parquet(str(tmp_path / "resp"))
    (tmp_path / "seeds").write_text("http://h.example/a\n\n")
    (tmp_path / "paths").write_text("/a\n/b\n")
    args = ["crawl", f"@{tmp_path}/seeds", "--responses", str(tmp_path / "resp"), "--export", str(tmp_path / "out"), "--report", str(tmp_path / "r.html"), "--verify", str(tmp_path / "paths")]
    assert cli.main(args, spark) == 0
    assert cli.main(["index", str(tmp_path / "out"), str(tmp_path / "ix")], spark) == 0
    assert cli.main(["search", "--saved", str(tmp_path / "ix"), "archive"], spark) == 0
    assert cli.main(["search", str(tmp_path / "out"), "records", "--hybrid"], spark) == 0
    assert cli.main(["search", str(tmp_path / "out"), "records", "--explain"], spark) == 0
    assert "records" in capsys.readouterr().out
