"""Scalars against golden cases and against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import charset, html
from weftline.functions import text as T
from weftline.functions import url as U


@pytest.mark.parametrize(
    "given, want",
    [
        ("HTTP://Example.COM/a", "http://example.com/a"), ("http://example.com:80/a", "http://example.com/a"), ("https://example.com:443/a", "https://example.com/a"),
        ("http://example.com:8080/a", "http://example.com:8080/a"), ("http://example.com./a", "http://example.com/a"), ("http://example.com/a#frag", "http://example.com/a"),
        ("http://example.com/%7Euser", "http://example.com/~user"), ("http://example.com/x//y", "http://example.com/x/y"), ("http://example.com/docs/", "http://example.com/docs/"),
        ("http://h/./a", "http://h/a"), ("http://h/x/../a", "http://h/a"), ("http://h/a?", "http://h/a"), ("http://h/a?b=2&a=1", "http://h/a?a=1&b=2"),
        ("http://h/a?a=1&b=2&", "http://h/a?a=1&b=2"), ("http://h/a?a=1&b=2&utm_source=news", "http://h/a?a=1&b=2"), ("http://h/a?SID=99&a=1&b=2", "http://h/a?a=1&b=2"),
        ("http://u:p@h", "http://h/"), ("http://h/../..", "http://h/"), ("http://h/a/..", "http://h/"), ("http://h/%2F%ff", "http://h//%EF%BF%BD"),
        ("ftp://example.com/a", None), ("mailto:x@y.z", None), ("http://[::bad::]/x", None), ("http://example.com:99999999/a", None), ("", None), (None, None), ("/a", None),
    ],
)
def test_canonical(given, want):
    assert U.canonical(given) == want


def test_url_columns(spark):
    urls = ["http://www.example.com/a", "http://example.com/a", "http://127.0.0.1:8081/a?b=2&c=3", "http://127.0.0.1:8081", "http://h/gen/1/x", None, "nonsense"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select(U.surt(F.col("url")).alias("s"), U.shape(F.col("url")).alias("p"), U.canonical_url("url").alias("c")).collect()
    assert [r.s for r in got][:4] == ["com,example,www)/a", "com,example)/a", "127.0.0.1:8081)/a?b=2&c=3", "127.0.0.1:8081)/"]
    assert got[4].p == "h/gen/<num>/x" and got[5].s is None and got[6].c is None
    assert U.absolute("../up", "http://h/a/b") == "http://h/up" and U.absolute("http://127.0.0.1:8081:/a", "http://h/") is None


def test_traps(spark):
    urls = ["http://h/" + "a" * 2000, "http://h/" + "/".join(map(str, range(13))), "http://h/a/b/a/c/a/a", "http://h/?" + "&".join("abcdefghijklm"), "http://h/a/a/a"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(U.trap(F.col("url"))).collect()] == ["url_too_long", "path_too_deep", "repeated_segment", "too_many_params", None]


@pytest.mark.parametrize(
    "given, want",
    [
        ("Crawler CRAWLER crawler", ["crawler"] * 3), ("RFC 9309 and HTTP/2", ["rfc", "9309", "and", "http", "2"]), ("naïve café 日本語 Ünicode", ["naïve", "café", "日本語", "ünicode"]),
        ("don't it’s", ["don't", "it’s"]), ("x" * 65, []), ("x" * 64, ["x" * 64]), (None, []), ("", []), ("a_b", ["a", "b"]),
    ],
)
def test_terms(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(T.terms(F.col("t"))).first()[0] == want


def test_exact_fold(spark):
    df = spark.createDataFrame([("ﬁle Straße İ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.fold_exact("t")).collect()] == ["file strasse i̇", None]


def test_shingles_and_fingerprints(spark):
    texts = ["one two three four five six", "a b", "", None, "w " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord int, text string")
    got = {r.ord: r.s for r in df.select("ord", T.shingles(T.words(F.col("text"))).alias("s")).collect()}
    assert got[0] == ["one two three four", "two three four five", "three four five six"] and got[1] == ["a b"] and got[2] == got[3] == [] and got[4] == ["w w w"]
    from weftline.operators.dedup import fingerprints

    def brute(t):
        w = re.findall(r"\w+", t.lower())
        runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [int(hashlib.md5(r.encode()).hexdigest()[:16], 16) for r in runs]
        v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        return v - (1 << 64) if v >> 63 else v

    prints = {r.ord: r.fp for r in fingerprints(df).collect()}
    assert prints == {0: brute(texts[0]), 1: brute(texts[1]), 4: brute(texts[4])}
    native = df.select("ord", T.simhash(F.transform(T.shingles(T.words(F.col("text"))), T.hash64)).alias("f")).collect()
    assert {r.ord: r.f for r in native if r.f is not None} == prints


def test_grams(spark):
    df = spark.createDataFrame([("a",), ("word",)], "t string")
    assert [r[0] for r in df.select(T.grams(F.col("t"))).collect()] == [["^a$"], ["^wo", "wor", "ord", "rd$"]]


@pytest.mark.parametrize(
    "body, header, want",
    [
        (b"\xef\xbb\xbfx", "text/html; charset=windows-1252", ("x", "utf-8-sig", "bom")),
        ("é".encode("cp1252"), "text/html; charset=windows-1252", ("é", "windows-1252", "http header")),
        (b'<meta charset="windows-1252">\xe9', "text/html", ('<meta charset="windows-1252">é', "windows-1252", "meta tag")),
        (b"<meta charset=utf-8>\xe9", "text/html; charset=utf-8", ("<meta charset=utf-8>é", "windows-1252", "fallback")),
        ("é".encode(), None, ("é", "utf-8", "utf-8 decoded cleanly")),
        (b" " * 9000 + b"<meta charset=latin-1>", "x; charset=nonsense", (" " * 9000 + "<meta charset=latin-1>", "utf-8", "utf-8 decoded cleanly")),
    ],
)
def test_charset(body, header, want):
    assert charset.decode(body, header) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("<h1>One</h1><h3>Three</h3>", "# One\n\n### Three"), ("<p><a href='../up'>u</a></p>", "[u](https://h.example/up)"), ("<a href='javascript:x'>j</a><a href='#y'>k</a>", "jk"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"), ("<ol><li>x<li>y<li>z</ol>", "1. x\n2. y\n3. z"), ("<pre>a  b\n c</pre>", "```\na  b\n c\n```"),
        ("<table><tr><th>A<th>B<tr><td>a|b</table>", "| A | B |\n| --- | --- |\n| a\\|b |  |"), ("<nav>n</nav><main></main><p>body</p>", "body"), ("<blockquote><p>q</blockquote>", "> q"),
        ("<p>x <strong>b</strong> and <em>i</em> and <code>c</code></p>", "x **b** and *i* and `c`"), ("", ""), ("<hr>", "---"), ("<img alt=A src=/i.png>", "![A](https://h.example/i.png)"),
    ],
)
def test_markdown(given, want):
    assert html.markdown(f"<body>{given}</body>", "https://h.example/a/") == want


def test_extract():
    x = html.extract(
        '<title> T  x</title><link rel="canonical" href="/c"><base href="/b/"><body><nav><a href="x">n</a></nav><p>Hi <b>you<p>there'
        '<script>var a="</p>"</script><div id=root></div><noscript>Enable JavaScript</noscript><a href="MAILTO:a@b">m</a><a href="http://h:x/">bad</a><a href="x#f">n</a>', "http://h.example/d/",
    )
    assert (x["title"], x["links"], x["canonical"]) == ("T x", ["http://h.example/b/x"], "http://h.example/c")
    assert x["main_text"] == "Hi you there m bad n" and x["empty_app_root"] and x["noscript_hint"] and x["script_bytes"] > 0
    assert html.extract("", "")["text"] == ""
