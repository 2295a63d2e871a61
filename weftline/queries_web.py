"""Queries over URLs, the frontier, duplicates, archive and freshness, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .functions import url as U
from .functions import response as R
from .operators import archive as A
from .operators import crawl as C
from .operators import dedup as D
from .operators import freshness as FR
from .operators import frontier as FN
from .plans.shared import cut, spread, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# -- urls ----------------------------------------------------------------------

_SPLIT = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"


def _part(col: str, k: int) -> str:
    return f"regexp_extract({col}, {_SPLIT}, {k})"


_TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)
_SEGS = f"list_filter(string_split({_part('url', 3)}, '/'), lambda s: s <> '')"
_PQ = f"list_filter(string_split({_part('url', 4)}, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({_TRACK}))"
_SHAPE = f"{_part('url', 2)} || array_to_string(list_transform(string_split({_part('url', 3)}, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '<num>' ELSE s END), '/')"
#: All addresses of the crawl: those fetched and those linked to.
_ALL_URLS = "urls AS (SELECT DISTINCT url FROM (SELECT url FROM page UNION ALL SELECT final_url FROM page UNION ALL SELECT unnest(links) FROM extracted) WHERE url IS NOT NULL)"


def _urls(spark, d):
    p, e = table(spark, d, "page"), table(spark, d, "extracted")
    every = p.select("url").unionByName(p.select(F.col("final_url").alias("url"))).unionByName(e.select(F.explode("links").alias("url")))
    return every.where(F.col("url").isNotNull()).distinct()


@query(f"WITH {_ALL_URLS} SELECT url, lower({_part('url', 1)}) AS scheme, {_part('url', 2)} AS authority, {_part('url', 3)} AS path, coalesce({_part('url', 4)}, '') AS query FROM urls")
def url_parts(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", U.scheme(u).alias("scheme"), U.authority(u).alias("authority"), U.path(u).alias("path"), U.query(u).alias("query"))


@query(f"""WITH {_ALL_URLS} SELECT url, lower({_part('url', 1)}) || '://' || regexp_replace(lower({_part('url', 2)}), ':(80|443)$', '') || CASE WHEN {_part('url', 3)} = '' THEN '/' ELSE {_part('url', 3)} END
 || CASE WHEN len({_PQ}) > 0 THEN '?' || array_to_string(list_sort({_PQ}), '&') ELSE '' END AS normalized FROM urls""")
def url_normalize(spark, d):
    return _urls(spark, d).select("url", U.canonical_url("url").alias("normalized"))


@query(f"WITH {_ALL_URLS} SELECT url, array_to_string(list_sort({_PQ}), '&') AS kept FROM urls WHERE {_part('url', 4)} <> ''")
def tracking_params_dropped(spark, d):
    return _urls(spark, d).where(U.query(F.col("url")) != "").select("url", U.kept_query(F.col("url")).alias("kept"))


@query(f"WITH {_ALL_URLS} SELECT {_SHAPE} AS shape, count(*) AS n FROM urls GROUP BY 1")
def url_shape(spark, d):
    return _urls(spark, d).groupBy(U.shape(F.col("url")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


_HOSTKEY = f"regexp_extract(lower({_part('url', 2)}), '(?:[^@]*@)?([^:]*)', 1)"
_SURT = f"""(CASE WHEN regexp_full_match({_HOSTKEY}, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') OR {_HOSTKEY} = '' THEN {_HOSTKEY} ELSE array_to_string(list_reverse(string_split({_HOSTKEY}, '.')), ',') END
 || CASE WHEN regexp_extract({_part('url', 2)}, ':([0-9]+)$', 1) NOT IN ('', '0') THEN ':' || regexp_extract({_part('url', 2)}, ':([0-9]+)$', 1) ELSE '' END
 || ')' || CASE WHEN {_part('url', 3)} = '' THEN '/' ELSE {_part('url', 3)} END || CASE WHEN coalesce({_part('url', 4)}, '') <> '' THEN '?' || {_part('url', 4)} ELSE '' END)"""


@query(f"WITH {_ALL_URLS} SELECT url, {_SURT} AS key FROM urls")
def surt_keys(spark, d):
    return _urls(spark, d).select("url", U.surt(F.col("url")).alias("key"))


@query(f"WITH {_ALL_URLS} SELECT url, key FROM (SELECT url, {_SURT} AS key FROM urls) WHERE starts_with(key, 'example,')")
def surt_prefix_scan(spark, d):
    return A.prefix(_urls(spark, d).select("url", U.surt(F.col("url")).alias("key")), "example,")


_TRAP = f"""CASE WHEN length(url) > 2000 THEN 'url_too_long' WHEN len({_SEGS}) > 12 THEN 'path_too_deep'
 WHEN list_max(list_transform(list_distinct({_SEGS}), lambda x: len(list_filter({_SEGS}, lambda y: y = x)))) > 3 THEN 'repeated_segment'
 WHEN {_part('url', 4)} <> '' AND len(string_split({_part('url', 4)}, '&')) > 12 THEN 'too_many_params' END"""
#: Addresses of a crawl into traps: some of them deep, with a segment that comes back, with many
#: parameters or very long; the others under a directory are one shape, so that the budget binds.
_DEEP, _AGAIN, _MANY = "/".join(f"d{i}" for i in range(13)), "/".join(["same"] * 4), "&".join(f"p{i}={i}" for i in range(13))
_FOUND = f"""found0 AS (SELECT min(ord) AS ord, url AS u FROM page WHERE url IS NOT NULL GROUP BY url),
 found AS (SELECT ord, regexp_replace(u, '[^/]+$', '') || CASE ord % 20 WHEN 1 THEN '{_DEEP}' WHEN 2 THEN '{_AGAIN}' WHEN 3 THEN 'list?{_MANY}' WHEN 4 THEN repeat('long', 500) ELSE CAST(ord % 100 AS VARCHAR) END AS url FROM found0),
 own AS (SELECT ord, url, {_TRAP} AS r, {_SHAPE} AS s FROM found),
 num AS (SELECT ord, url, r, s, row_number() OVER (PARTITION BY s, r IS NULL ORDER BY ord, url) AS k FROM own),
 adm AS (SELECT ord, url, coalesce(r, CASE WHEN k > 5 THEN 'shape_budget' END) AS reason FROM num)"""


def _found(spark, d):
    first = table(spark, d, "page").where(F.col("url").isNotNull()).groupBy("url").agg(F.min("ord").alias("ord"))
    k = F.pmod("ord", F.lit(20))
    tail = F.when(k == 1, _DEEP).when(k == 2, _AGAIN).when(k == 3, f"list?{_MANY}").when(k == 4, "long" * 500).otherwise(F.pmod("ord", F.lit(100)).cast("string"))
    return first.select("ord", F.concat(F.regexp_replace("url", "[^/]+$", ""), tail).alias("url"))


@query(f"WITH {_FOUND} SELECT ord, url, reason FROM adm")
def shape_budget(spark, d):
    return FN.admitted(_found(spark, d))


@query(f"WITH {_FOUND} SELECT reason, count(*) AS n FROM adm WHERE reason IS NOT NULL GROUP BY reason")
def trap_reasons(spark, d):
    return FN.tally(FN.admitted(_found(spark, d)))


# -- links and frontier --------------------------------------------------------

_LINKS = "links AS (SELECT DISTINCT url AS src, unnest(links) AS dst FROM extracted)"


def _links(spark, d):
    return table(spark, d, "extracted").select(F.col("url").alias("src"), F.explode("links").alias("dst")).distinct()


@query(f"WITH {_LINKS} SELECT dst, count(*) AS indegree FROM links GROUP BY dst")
def link_indegree(spark, d):
    return _links(spark, d).groupBy("dst").agg(F.count(F.lit(1)).alias("indegree"))


@query(f"WITH {_LINKS} SELECT dst AS url FROM links WHERE regexp_extract(dst, {_SPLIT}, 2) IN (SELECT regexp_extract(url, {_SPLIT}, 2) FROM page WHERE depth = 0) GROUP BY dst")
def same_host_links(spark, d):
    seeds = table(spark, d, "page").where("depth = 0").select("url")
    return FN.in_scope(_links(spark, d).select(F.col("dst").alias("url")).distinct(), seeds)


@query(f"WITH {_LINKS} SELECT DISTINCT dst AS url FROM links WHERE dst NOT IN (SELECT url FROM page WHERE url IS NOT NULL)")
def unseen_links(spark, d):
    seen = table(spark, d, "page").select("url").distinct()
    return _links(spark, d).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")


_HOSTS = f"""e AS (SELECT DISTINCT regexp_extract(url, {_SPLIT}, 2) AS src, regexp_extract(l, {_SPLIT}, 2) AS dst FROM (SELECT url, unnest(links) AS l FROM extracted)),
 s AS (SELECT min(regexp_extract(url, {_SPLIT}, 2)) AS node FROM extracted)"""


@query(f"""WITH RECURSIVE {_HOSTS}, r(node, depth) AS (SELECT node, 0 FROM s UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 40)
 SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def bfs_levels(spark, d):
    """Levels of all hosts from the first one, to the end of the graph."""
    x = table(spark, d, "extracted")
    edges = x.select(U.authority(F.col("url")).alias("src"), F.explode("links").alias("l")).select("src", U.authority(F.col("l")).alias("dst")).distinct()
    return FN.levels(edges, x.agg(F.min(U.authority(F.col("url"))).alias("node")), None)


@query()
def bfs_url_levels(spark, d):
    """Levels of all urls that links reach from the pages of depth 0, to the end of the graph."""
    links = table(spark, d, "extracted").select(U.canonical_url("url").alias("src"), F.explode("links").alias("l"))
    edges = links.select("src", U.canonical_url("l").alias("dst")).where("src is not null and dst is not null").distinct()
    seeds = table(spark, d, "page").where("depth = 0").select(U.canonical_url("url").alias("node")).where("node is not null")
    return FN.levels(cut(edges), seeds, None)


_QUEUE = f"""req AS (SELECT url, min({{'p': depth::DOUBLE, 'o': ord}}) AS q FROM page WHERE url IS NOT NULL GROUP BY url),
 queue AS (SELECT regexp_extract(url, {_SPLIT}, 2) AS host, url, row_number() OVER (PARTITION BY regexp_extract(url, {_SPLIT}, 2) ORDER BY q.p, q.o, url) AS place FROM req)"""


def _queue(spark, d):
    p = table(spark, d, "page").where(F.col("url").isNotNull())
    return FN.queue_order(p.select("url", F.col("depth").cast("double").alias("priority"), "ord"))


@query(f"WITH {_QUEUE} SELECT host, url, place::INTEGER AS place FROM queue")
def host_queue_order(spark, d):
    return _queue(spark, d)


#: The robots file of the hosts that have one; a host's first letter decides whether it does.
ROBOTS = """User-agent: *
Disallow: /docs/
Allow: /docs/h
Crawl-delay: 7

User-agent: weft
User-agent: other
Disallow: /archive
Disallow: /*-1$
Allow: /archive/
Disallow:
Crawl-delay: 120
Sitemap: http://maps.example/main.xml
"""
AGENT = "weft/1.0"
_STATUS = "CASE ascii(host) % 4 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END"


def _robots(spark, d):
    hosts = table(spark, d, "page").where(F.col("url").isNotNull()).select(U.authority(F.col("url")).alias("host")).distinct()
    k = F.ascii("host") % 4
    return hosts.select("host", F.when(k == 1, 404).when(k == 2, 503).otherwise(200).alias("status"), F.lit(ROBOTS).alias("body"))


_RHOSTS = f"hosts AS (SELECT host, {_STATUS} AS status FROM (SELECT DISTINCT regexp_extract(url, {_SPLIT}, 2) AS host FROM page WHERE url IS NOT NULL))"


@query(f"""WITH {_RHOSTS}, u AS (SELECT DISTINCT url, regexp_extract(url, {_SPLIT}, 2) AS host, {_part('url', 3)} || CASE WHEN coalesce({_part('url', 4)}, '') <> '' THEN '?' || {_part('url', 4)} ELSE '' END AS p FROM page WHERE url IS NOT NULL)
 SELECT url, CASE WHEN status >= 500 THEN false WHEN status >= 400 THEN true WHEN starts_with(p, '/archive/') THEN true
   WHEN starts_with(p, '/archive') THEN false WHEN regexp_full_match(p, '/.*-1') THEN false ELSE true END AS allowed FROM u JOIN hosts USING (host)""")
def robots_allowed(spark, d):
    urls = table(spark, d, "page").where(F.col("url").isNotNull()).select("url")
    return FN.robots_allowed(urls, FN.robots_rules(_robots(spark, d), AGENT))


@query(f"""WITH {_QUEUE}, {_RHOSTS} SELECT host, url, (place - 1) * CASE WHEN status = 200 THEN 30.0::DOUBLE ELSE 0.5::DOUBLE END AS start_s FROM queue JOIN hosts USING (host)""")
def politeness_schedule(spark, d):
    rules = FN.robots_rules(_robots(spark, d), AGENT)
    pace = FN.delays(rules.select("host", F.col("delay").alias("crawl_delay")), default=0.5)
    return FN.schedule(_queue(spark, d), pace)


@query(f"""WITH spans AS (SELECT DISTINCT regexp_extract(url, {_SPLIT}, 2) AS host, epoch_us(fetched_at) AS b, epoch_us(fetched_at) + CAST(round(elapsed * 60000000) AS BIGINT) AS f, ord FROM page WHERE url IS NOT NULL AND fetched_at IS NOT NULL),
 moves AS (SELECT host, t, d, sum(d) AS s FROM (SELECT host, b AS t, 1 AS d FROM spans UNION ALL SELECT host, f, -1 FROM spans) GROUP BY host, t, d)
 SELECT host, max(n)::BIGINT AS peak FROM (SELECT host, sum(s) OVER (PARTITION BY host ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM moves) GROUP BY host""")
def host_peaks(spark, d):
    p = table(spark, d, "page").where(F.col("url").isNotNull() & F.col("fetched_at").isNotNull())
    begin = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    spans = p.select(U.authority(F.col("url")).alias("host"), begin.alias("begin"), (begin + F.round(F.col("elapsed") * 60000000).cast("bigint")).alias("finish"), "ord").distinct()
    return FN.busiest(spans)


@query("""WITH RECURSIVE hop AS (SELECT url, min(final_url) AS target FROM page WHERE final_url <> url AND url IS NOT NULL GROUP BY url),
 walk(url, stop, n) AS (SELECT url, target, 1 FROM hop UNION ALL SELECT w.url, h.target, w.n + 1 FROM walk w JOIN hop h ON h.url = w.stop WHERE w.n < 6),
 ends AS (SELECT url, stop FROM walk WHERE stop NOT IN (SELECT url FROM hop) AND n <= 5)
 SELECT h.url, e.stop AS final FROM hop h LEFT JOIN ends e ON h.url = e.url""")
def redirect_targets(spark, d):
    hops = table(spark, d, "page").where("final_url <> url").select("url", F.col("final_url").alias("target"))
    return FN.resolve_redirects(hops)


def _sitemap_files(spark, d):
    """(url, body): for each host an index, which names itself and one that is broken too, and sitemaps of a
    part of its pages each, with the day of their last fetch."""
    p = table(spark, d, "page").where(F.col("url").isNotNull()).groupBy("url").agg(F.max("fetched_at").alias("at"))
    host, part = U.authority(F.col("url")), F.pmod(F.xxhash64("url"), F.lit(16))
    safe = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    mod = F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("at", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit(""))
    entry = F.concat(F.lit("<url><loc> "), safe, F.lit(" </loc>"), mod, F.lit("</url>"))
    name = F.concat(F.lit("http://"), host, F.lit("/sitemap-"), part.cast("string"), F.lit(".xml"))
    ns = "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"
    wrap = lambda tag, items: F.concat(F.lit(f"<{tag} {ns}>"), F.array_join(F.collect_list(items), ""), F.lit(f"</{tag}>"))
    maps = p.select(host.alias("host"), name.alias("url"), entry.alias("e")).groupBy("host", "url").agg(wrap("urlset", F.col("e")).alias("body"))
    at = lambda c: F.concat(F.lit("<sitemap><loc>"), c, F.lit("</loc></sitemap>"))
    index = F.concat(F.lit("http://"), "host", F.lit("/sitemap.xml"))
    own = maps.groupBy("host").agg(wrap("sitemapindex", at(F.col("url"))).alias("b"))
    more = F.concat(at(index), at(F.concat(F.lit("http://"), "host", F.lit("/broken.xml"))), F.lit("</sitemapindex>"))
    heads = own.select(index.alias("url"), F.concat(F.substring_index("b", "</sitemapindex>", 1), more).alias("body"))
    broken = own.select(F.concat(F.lit("http://"), "host", F.lit("/broken.xml")).alias("url"), F.lit("<urlset><url><loc>http://no.example/").alias("body"))
    return maps.select("url", "body").unionByName(heads).unionByName(broken)


@query("SELECT url, strftime(max(fetched_at), '%Y-%m-%d') AS lastmod FROM page WHERE url IS NOT NULL GROUP BY url")
def sitemap_expand(spark, d):
    """All pages by the sitemaps of their hosts."""
    files = cut(_sitemap_files(spark, d))
    return FN.expand_sitemaps(files.where("url like '%/sitemap.xml'").select("url"), files)


# -- duplicates ----------------------------------------------------------------

_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_MEASURE = f"""m0 AS (SELECT ord, url, main_text, canonical, sha256(trim(regexp_replace(coalesce(main_text, ''), '{_WS}', ' ', 'g'))) AS content_hash,
  regexp_extract_all(lower(coalesce(main_text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM extracted),
 m AS (SELECT *, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS s FROM m0)"""


def _records(spark, d):
    return spread(table(spark, d, "extracted")).select("ord", "url", F.col("main_text").alias("text"), "canonical")


@query(f"WITH {_MEASURE} SELECT ord, content_hash FROM m")
def content_hash(spark, d):
    return _records(spark, d).select("ord", T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


@query(f"WITH {_MEASURE} SELECT ord, url, content_hash, len(w)::INTEGER AS n_words, len(list_distinct(s))::INTEGER AS n_shingles FROM m")
def shingle_counts(spark, d):
    return D.measured(_records(spark, d)).drop("fp")


@query(f"WITH {_MEASURE} SELECT ord FROM m WHERE len(w) >= 25 AND len(list_distinct(s)) >= 20")
def near_dup_eligible(spark, d):
    return D.eligible(D.measured(_records(spark, d))).select("ord")


@query(f"WITH {_MEASURE} SELECT ord, min(ord) OVER (PARTITION BY content_hash) AS first_ord FROM m")
def exact_duplicates(spark, d):
    return D.first_of_content(_records(spark, d))


_PRINTS = f"""{_MEASURE}, sh AS (SELECT ord, ('0x' || substr(md5(x), 1, 16))::UBIGINT AS h FROM (SELECT ord, unnest(s) AS x FROM m)),
 bits AS (SELECT ord, b, sum((h >> b) & 1) * 2 > count(*) AS one FROM sh, range(64) t(b) GROUP BY ord, b),
 fp AS (SELECT ord, sum(CASE WHEN one THEN (1::HUGEINT << b) ELSE 0 END)::UBIGINT AS fp FROM bits GROUP BY ord)"""


@query(f"WITH {_PRINTS} SELECT ord, CASE WHEN fp >= 9223372036854775808 THEN (fp::HUGEINT - 18446744073709551616)::BIGINT ELSE fp::BIGINT END AS fp FROM fp")
def simhash_md5(spark, d):
    return D.fingerprints(_records(spark, d))


_ABLE = "able AS (SELECT f.ord, f.fp FROM fp f JOIN m ON f.ord = m.ord WHERE len(m.w) >= 25 AND len(list_distinct(m.s)) >= 20)"


def _able(spark, d):
    return D.eligible(D.measured(_records(spark, d))).select("ord", "fp")


_HEADS = f"{_PRINTS}, {_ABLE}, heads AS (SELECT min(ord) AS ord, fp FROM able GROUP BY fp)"


@query(f"""WITH {_HEADS} SELECT a.ord AS a, b.ord AS b, bit_count(xor(a.fp, b.fp))::INTEGER AS distance,
  list_min(list_filter(range(8), lambda i: ((xor(a.fp, b.fp) >> (8 * i)::UBIGINT) & 255) = 0))::INTEGER AS band
  FROM heads a JOIN heads b ON a.ord < b.ord WHERE bit_count(xor(a.fp, b.fp)) <= 6""")
def near_dup_pairs(spark, d):
    """Pairs between the first records of different fingerprints; near_dup_classes has the others."""
    return D.near_pairs(_able(spark, d))


@query(f"WITH {_HEADS} SELECT a.ord, h.ord AS rep, (SELECT count(*) FROM heads o WHERE o.ord <> h.ord AND bit_count(xor(o.fp, h.fp)) <= 6) AS n_links FROM able a JOIN heads h ON a.fp = h.fp")
def near_dup_classes(spark, d):
    """Each record with the first one of its fingerprint and that one's number of links."""
    own = cut(_able(spark, d))
    p = D.near_pairs(own).select("a", "b")
    links = p.select(F.col("a").alias("rep")).unionByName(p.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return D.classes(own).join(links, "rep", "left").select("ord", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: The pass in order, one holder after the other, with the list of those it kept.
_VERDICTS = f"""RECURSIVE {_PRINTS}, own AS MATERIALIZED (SELECT m.*, canonical IS NOT NULL AND canonical <> url AS alias FROM m),
 firsts AS (SELECT content_hash, min(ord) AS ford FROM own WHERE NOT alias GROUP BY content_hash),
 rest AS MATERIALIZED (SELECT o.ord, o.url, f.ford, h.url AS furl, len(o.w) >= 25 AND len(list_distinct(o.s)) >= 20 AS able FROM own o JOIN firsts f ON o.content_hash = f.content_hash JOIN own h ON h.ord = f.ford WHERE NOT o.alias),
 held AS MATERIALIZED (SELECT r.ord, r.url, fp.fp, row_number() OVER (ORDER BY r.ord) AS k FROM rest r JOIN fp ON fp.ord = r.ord WHERE r.ord = r.ford AND r.able),
 pass(k, kept, ord, o) AS (
   SELECT 0::BIGINT, []::STRUCT(ord BIGINT, fp UBIGINT)[], NULL::BIGINT, NULL::STRUCT(band INTEGER, a BIGINT, distance INTEGER)
   UNION ALL
   SELECT h.k, CASE WHEN len(n.l) = 0 THEN list_append(p.kept, {{'ord': h.ord, 'fp': h.fp}}) ELSE p.kept END, h.ord, list_min(n.l)
   FROM pass p JOIN held h ON h.k = p.k + 1, LATERAL (SELECT list_transform(list_filter(p.kept, lambda x: bit_count(xor(x.fp, h.fp)) <= 6),
     lambda x: {{'band': list_min(list_filter(range(8), lambda i: ((xor(x.fp, h.fp) >> (8 * i)::UBIGINT) & 255) = 0))::INTEGER, 'a': x.ord, 'distance': bit_count(xor(x.fp, h.fp))::INTEGER}}) AS l) n),
 verdicts AS (SELECT ord, url, 'canonical_alias' AS verdict, canonical AS duplicate_of, NULL::INTEGER AS distance FROM own WHERE alias
   UNION ALL SELECT ord, url, CASE WHEN url IS NOT DISTINCT FROM furl THEN 'already_seen' ELSE 'exact_duplicate' END, furl, NULL FROM rest WHERE ord <> ford
   UNION ALL SELECT r.ord, r.url, CASE WHEN p.o IS NULL THEN 'new' ELSE 'near_duplicate' END, h.url, p.o.distance FROM rest r LEFT JOIN pass p ON p.ord = r.ord LEFT JOIN own h ON h.ord = p.o.a WHERE r.ord = r.ford)"""


@query(f"WITH {_VERDICTS} SELECT ord, url, verdict, duplicate_of, distance FROM verdicts")
def dedup_verdicts(spark, d):
    return D.verdicts(_records(spark, d))


@query(f"WITH {_VERDICTS} SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict")
def verdict_counts(spark, d):
    return D.verdicts(_records(spark, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query()
def simhash_blake2b(spark, d):
    return _records(spark, d).select("ord", T.simhash_exact("text").alias("fp"))


# -- archive -------------------------------------------------------------------

_RESP = """resp AS (SELECT p.ord, p.url, p.status, encode(coalesce(e.main_text, '')) AS body, (p.ord % 50 = 0) AS truncated, fetched_at FROM (SELECT ord, min(url) AS url, min(status) AS status, min(fetched_at) AS fetched_at FROM page GROUP BY ord) p JOIN extracted e ON p.ord = e.ord),
 reason AS (SELECT *, CASE WHEN status = 304 THEN 'not_modified' WHEN status IS NULL OR status NOT BETWEEN 200 AND 299 THEN 'not_ok' WHEN truncated THEN 'truncated' END AS reason, sha256(body) AS digest FROM resp),
 okay AS (SELECT * FROM reason WHERE reason IS NULL), objects AS (SELECT digest, max(octet_length(body)) AS size FROM okay GROUP BY digest),
 records AS (SELECT url, max({'o': ord, 'd': digest}).d AS digest FROM okay GROUP BY url)"""


def _responses(spark, d):
    p = table(spark, d, "page").groupBy("ord").agg(F.min("url").alias("url"), F.min("status").alias("status"), F.min("fetched_at").alias("fetched_at"))
    e = table(spark, d, "extracted").select("ord", F.coalesce("main_text", F.lit("")).cast("binary").alias("body"))
    return p.join(e, "ord").withColumn("truncated", F.pmod("ord", F.lit(50)) == 0)


@query(f"WITH {_RESP} SELECT digest, size::INTEGER AS size FROM objects")
def object_store(spark, d):
    return A.store(_responses(spark, d))[0]


@query(f"WITH {_RESP} SELECT reason, count(*) AS n FROM reason WHERE reason IS NOT NULL GROUP BY reason")
def store_refusals(spark, d):
    return A.store(_responses(spark, d))[2]


@query(f"WITH {_RESP} SELECT digest, count(*) AS n FROM records GROUP BY digest HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return A.duplicate_groups(A.store(_responses(spark, d))[1])


@query(f"WITH {_RESP} SELECT (SELECT sum(size) FROM objects)::BIGINT AS written, ((SELECT sum(octet_length(body)) FROM okay) - (SELECT sum(size) FROM objects))::BIGINT AS deduplicated")
def bytes_saved(spark, d):
    r = _responses(spark, d)
    return A.bytes_written(r, A.store(r)[0])


_CDX = f"{_RESP}, cdx AS (SELECT DISTINCT {_SURT} AS key, strftime(fetched_at, '%Y%m%d%H%M%S') AS timestamp, url, 'text/html' AS mime, status, digest FROM reason WHERE url IS NOT NULL AND fetched_at IS NOT NULL)"


def _cdx(spark, d):
    r = _responses(spark, d).withColumn("digest", F.sha2("body", 256)).withColumn("mime", F.lit("text/html"))
    return A.captures(r)


@query(f"WITH {_CDX} SELECT * FROM cdx")
def cdx_build(spark, d):
    return _cdx(spark, d)


@query(f"WITH {_CDX}, n AS (SELECT key, max({{'t': timestamp, 'u': url, 'd': digest}}) AS c FROM cdx GROUP BY key) SELECT key, c.t AS timestamp, c.u AS url, c.d AS digest FROM n")
def cdx_newest(spark, d):
    return A.newest(_cdx(spark, d))


@query(f"WITH {_CDX} SELECT * FROM cdx UNION SELECT key, '20200101000000', url, mime, status, digest FROM cdx")
def cdx_merge(spark, d):
    c = _cdx(spark, d)
    return A.merged(c, c.withColumn("timestamp", F.lit("20200101000000")))


@query("""SELECT p.*, nullif(left(e.main_text, 200000), '') AS text, e.encoding FROM (SELECT DISTINCT ord, url, final_url, status, depth, title, n_links, words, verdict, duplicate_of, error, from_cache, rendered, round(elapsed, 3) AS elapsed FROM page) p LEFT JOIN extracted e ON p.ord = e.ord""")
def export_record(spark, d):
    return A.export_records(table(spark, d, "page"), table(spark, d, "extracted"))


@query(f"""SELECT count(*) AS pages, count(error) AS errors, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(DISTINCT regexp_extract(url, {_SPLIT}, 2)) AS hosts, count(*) FILTER (rendered) AS rendered, count(*) FILTER (from_cache) AS from_cache,
 count(*) FILTER (verdict IN ('exact_duplicate', 'near_duplicate')) AS duplicates, coalesce(sum(words), 0)::BIGINT AS words, coalesce(sum(n_links), 0)::BIGINT AS links
 FROM (SELECT DISTINCT ord, status, error, verdict, rendered, from_cache, words, n_links, url FROM page)""")
def crawl_summary(spark, d):
    return A.crawl_summary(table(spark, d, "page"))


@query("""WITH x AS (SELECT ord, len(list_filter(regexp_split_to_array(coalesce(main_text, ''), '\\s+'), lambda w: w <> '')) AS words, script_bytes, octet_length(encode(coalesce(text, ''))) + script_bytes AS body, len(links) AS n, empty_app_root, noscript_hint FROM extracted)
 SELECT ord, list_filter([CASE WHEN empty_app_root THEN 'empty_app_root' END, CASE WHEN noscript_hint THEN 'noscript_hint' END,
  CASE WHEN words < 25 AND body > 0 AND script_bytes::DOUBLE / body > 0.3 THEN 'thin_and_script_heavy' END, CASE WHEN coalesce(n, 0) = 0 AND script_bytes > 0 AND words < 25 THEN 'no_links_with_scripts' END], lambda r: r IS NOT NULL) AS reasons FROM x""")
def triage_reasons(spark, d):
    e = table(spark, d, "extracted")
    return A.triage_reasons(e.withColumn("body_bytes", F.octet_length(F.coalesce("text", F.lit(""))) + F.col("script_bytes")))


@query(f"""WITH e AS (SELECT DISTINCT {_part('url', 3)} AS path FROM page WHERE url IS NOT NULL), g AS (SELECT DISTINCT {_part('url', 3)} AS path FROM extracted UNION SELECT '/gen/1' UNION SELECT '/other')
 SELECT path, 'missing' AS kind FROM e WHERE path NOT IN (SELECT path FROM g) UNION ALL SELECT path, CASE WHEN regexp_matches(path, '^/gen/') THEN 'trap' ELSE 'extra' END FROM g WHERE path NOT IN (SELECT path FROM e)""")
def verify_diff(spark, d):
    e = table(spark, d, "page").where(F.col("url").isNotNull()).select(U.path(F.col("url")).alias("path"))
    g = table(spark, d, "extracted").select(U.path(F.col("url")).alias("path")).unionByName(spark.createDataFrame([("/gen/1",), ("/other",)], "path string"))
    return A.diff(e, g, "^/gen/")


@query("SELECT url, final_url, status, verdict, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, ord DESC, final_url DESC NULLS LAST, status DESC NULLS LAST, verdict DESC NULLS LAST) AS k FROM page WHERE url IS NOT NULL) WHERE k = 1")
def latest_records(spark, d):
    p = table(spark, d, "page").where(F.col("url").isNotNull())
    return A.latest(p, "url", "fetched_at", "ord", "final_url", "status", "verdict").select("url", "final_url", "status", "verdict", "fetched_at")


# -- freshness -----------------------------------------------------------------

_FOLD = """ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY url) AS d FROM freshness_events) WHERE d = 1 AND url IS NOT NULL AND now_s IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY now_s, event_id) AS k FROM ev),
 f(url, k, etag, last_modified, content_hash, now_s, interval_s, checks, changes, body_bytes, links, hits, bytes_saved) AS (
  SELECT url, k, etag, last_modified, CASE WHEN not_modified THEN NULL ELSE content_hash END, now_s, 3600.0::DOUBLE, 1::BIGINT, 0::BIGINT, CASE WHEN not_modified THEN 0 ELSE coalesce(body_bytes, 0) END::BIGINT, CASE WHEN not_modified THEN [] ELSE coalesce(links, []) END, CASE WHEN not_modified THEN 1 ELSE 0 END::BIGINT, 0::BIGINT FROM o WHERE k = 1
  UNION ALL
  SELECT o.url, o.k, CASE WHEN o.not_modified THEN coalesce(o.etag, f.etag) ELSE o.etag END, CASE WHEN o.not_modified THEN coalesce(o.last_modified, f.last_modified) ELSE o.last_modified END,
   CASE WHEN o.not_modified THEN f.content_hash ELSE o.content_hash END, o.now_s,
   least(greatest(CASE WHEN NOT o.not_modified AND coalesce(o.content_hash <> f.content_hash, false) THEN f.interval_s / 2 ELSE f.interval_s * 2 END, 60.0), 2592000.0),
   f.checks + 1, f.changes + CASE WHEN NOT o.not_modified AND coalesce(o.content_hash <> f.content_hash, false) THEN 1 ELSE 0 END,
   CASE WHEN o.not_modified THEN f.body_bytes ELSE coalesce(o.body_bytes, 0) END, CASE WHEN o.not_modified THEN f.links ELSE coalesce(o.links, []) END,
   f.hits + CASE WHEN o.not_modified THEN 1 ELSE 0 END, f.bytes_saved + CASE WHEN o.not_modified THEN f.body_bytes ELSE 0 END
  FROM f JOIN o ON o.url = f.url AND o.k = f.k + 1),
 st AS (SELECT f.* EXCLUDE (k, now_s), now_s AS last_checked, now_s + interval_s AS next_due FROM f JOIN (SELECT url, max(k) AS k FROM o GROUP BY url) USING (url, k))"""


def _states(spark, d):
    return FR.fold(table(spark, d, "freshness_events"))


@query(f"WITH RECURSIVE {_FOLD} SELECT * FROM st")
def freshness_fold(spark, d):
    return _states(spark, d)


@query(f"WITH RECURSIVE {_FOLD} SELECT url, next_due FROM st WHERE next_due <= 1773200000 ORDER BY next_due, url LIMIT 1000")
def due_urls(spark, d):
    return FR.due(_states(spark, d), 1773200000.0)


@query(f"WITH RECURSIVE {_FOLD} SELECT url, changes::DOUBLE / checks AS change_rate FROM st")
def change_rate(spark, d):
    return FR.change_rate(_states(spark, d))


@query(f"WITH RECURSIVE {_FOLD} SELECT url, nullif(etag, '') AS if_none_match, nullif(last_modified, '') AS if_modified_since FROM st")
def revalidation_headers(spark, d):
    return FR.validators(_states(spark, d))


# -- pages ---------------------------------------------------------------------


def _html(spark, d):
    """Pages written from the extracted records, with furniture around the text."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    e = spread(table(spark, d, "extracted"))
    title, main = esc(F.coalesce("title", F.lit(""))), esc(F.coalesce("main_text", F.lit("")))
    anchors = F.array_join(F.transform("links", lambda u: F.concat(F.lit('<a href="'), esc(u), F.lit('#x">l</a>'))), " ")
    canonical = F.when(F.col("canonical").isNotNull(), F.concat(F.lit('<link rel="canonical" href="'), esc(F.col("canonical")), F.lit('">'))).otherwise("")
    body = F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), title, F.lit("</title>"), canonical, F.lit("</head><body><nav>menu "), anchors,
        F.lit("</nav><script>var p = '</p>';</script><article><p>"), F.replace(main, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article><footer>end</footer></body></html>"),
    )
    return e.select("ord", "url", "title", "links", "canonical", "main_text", body.cast("binary").alias("body"))


_FLAT = r"trim(regexp_replace(replace(coalesce({}, ''), chr(10), ' '), '[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def _extracted(spark, d):
    from .functions import html

    p = _html(spark, d)
    return p.select("ord", "links", "canonical", html.extracted("body", "url", F.lit("text/html")).alias("x"))


@query(f"SELECT ord, {_FLAT.format('title')} AS title, {_FLAT.format('main_text')} AS main_text, canonical, 'utf-8' AS encoding, 'meta tag' AS encoding_source FROM extracted")
def html_extract(spark, d):
    return _extracted(spark, d).select("ord", "x.title", "x.main_text", "x.canonical", "x.encoding", "x.encoding_source")


@query("SELECT ord, CASE WHEN links IS NULL THEN [] ELSE list_sort(list_distinct(links)) END AS found FROM extracted")
def html_links(spark, d):
    return _extracted(spark, d).select("ord", F.array_sort("x.links").alias("found"))


@query()
def page_markdown(spark, d):
    from .functions import html

    return _html(spark, d).select("ord", html.to_markdown("body", "url", F.lit("text/html")).alias("markdown"))


def _encoded(spark, d):
    """(ord, text, sent, kind, body, content_type): whole texts in several encodings, by turns.

    kind: 0 bare UTF-8, 1 to 4 with a mark (UTF-8, UTF-16 of both orders, UTF-32), 5 UTF-8 by header,
    6 UTF-8 by meta tag, 7 ISO 8859-1 by header, 8 the same bytes with a header that names nothing.
    A text that ISO 8859-1 cannot hold is UTF-8 there, and so is one whose bytes then look like UTF-8.
    ``sent`` is the text with its meta tag.
    """
    e = table(spark, d, "extracted").where("text is not null").select("ord", "text", F.pmod("ord", F.lit(9)).cast("int").alias("kind"))
    k, narrow = F.col("kind"), ~F.col("text").rlike("[^\\x00-\\xff]|[\\xc2-\\xf4][\\x80-\\xbf]")
    e = e.withColumn("kind", F.when((k >= 7) & ~narrow, 5).otherwise(k))
    e = e.withColumn("sent", F.when(k == 6, F.concat(F.lit('<html><meta charset="utf-8">'), "text")).otherwise(F.col("text")))
    mark = lambda h, c: F.concat(F.unhex(F.lit(h)), F.encode("sent", c))
    body = (
        F.when(k == 1, mark("EFBBBF", "UTF-8")).when(k == 2, mark("FFFE", "UTF-16LE")).when(k == 3, mark("FEFF", "UTF-16BE"))
        .when(k == 4, mark("0000FEFF", "UTF-32")).when(k >= 7, F.encode("sent", "ISO-8859-1")).otherwise(F.encode("sent", "UTF-8"))
    )
    header = F.when(k == 5, "text/html; charset=UTF-8").when(k == 7, "text/html; charset=iso-8859-1").when(k == 8, "text/html; charset=utf-8x").otherwise("text/html")
    return e.select("ord", "text", "sent", "kind", body.alias("body"), header.alias("content_type"))


#: What windows-1252 makes of the bytes between 0x80 and 0x9f.
_WINDOWS = bytes(range(0x80, 0xA0)).decode("windows-1252", "replace")


@query(f"""WITH e AS (SELECT ord, text, CAST(ord % 9 AS INTEGER) AS k, NOT regexp_matches(text, '[^\\x00-\\x{{ff}}]|[\\x{{c2}}-\\x{{f4}}][\\x{{80}}-\\x{{bf}}]') AS narrow, regexp_full_match(text, '(?s)[\\x00-\\x7f]*') AS plain FROM extracted WHERE text IS NOT NULL),
 s AS (SELECT ord, text, CASE WHEN k >= 7 AND NOT narrow THEN 5 ELSE k END AS k, plain FROM e)
 SELECT ord, CASE k WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' WHEN 4 THEN 'utf-32-be' WHEN 7 THEN 'iso-8859-1' WHEN 8 THEN CASE WHEN plain THEN 'utf-8' ELSE 'windows-1252' END ELSE 'utf-8' END AS encoding,
  CASE WHEN k BETWEEN 1 AND 4 THEN 'bom' WHEN k IN (5, 7) THEN 'http header' WHEN k = 6 THEN 'meta tag' WHEN k = 8 AND NOT plain THEN 'fallback' ELSE 'utf-8 decoded cleanly' END AS source,
  CASE WHEN k = 6 THEN '<html><meta charset="utf-8">' || text WHEN k IN (2, 3, 4) THEN chr(65279) || text WHEN k = 8 AND NOT plain THEN translate(text, array_to_string(list_transform(range(128, 160), lambda i: chr(CAST(i AS INTEGER))), ''), '{_WINDOWS}') ELSE text END AS text FROM s""")
def charset_texts(spark, d):
    """Whole texts of the records, encoded in several ways and decoded again."""
    from .functions import charset

    e = _encoded(spark, d).select("ord", charset.decoded_body(F.col("body"), F.col("content_type")).alias("x"))
    return e.select("ord", "x.encoding", "x.source", "x.text")


@query("""WITH p AS (SELECT ord, min(verdict) AS verdict FROM page WHERE verdict IN ('new', 'canonical_alias') GROUP BY ord)
 SELECT DISTINCT e.ord, l.link FROM (SELECT ord, unnest(links) AS link FROM extracted) l JOIN extracted e ON e.ord = l.ord JOIN p ON p.ord = e.ord""")
def expandable_links(spark, d):
    return C.expandable_links(table(spark, d, "extracted"), table(spark, d, "page").select("ord", "verdict")).select("ord", "link").distinct()


@query("SELECT DISTINCT ord, url FROM page WHERE url IS NOT NULL ORDER BY ord LIMIT 100")
def crawl_budget(spark, d):
    return C.within_budget(table(spark, d, "page").where(F.col("url").isNotNull()).select("ord", "url").distinct(), 100)


@query("SELECT DISTINCT ord, error IS NULL AND coalesce(status BETWEEN 200 AND 299, false) AS ok, coalesce(status = 304, false) AS not_modified FROM page")
def response_flags(spark, d):
    p = table(spark, d, "page")
    return p.select("ord", R.ok(F.col("status"), F.col("error")).alias("ok"), R.not_modified(F.col("status")).alias("not_modified")).distinct()


@query(f"WITH {_RESP} SELECT r.url, r.digest, o.size::INTEGER AS size FROM records r JOIN objects o ON r.digest = o.digest")
def stored_objects(spark, d):
    objects, records, _ = A.store(_responses(spark, d))
    return records.join(objects, "digest").select("url", "digest", "size")


@query()
def crawl_pages(spark, d):
    """A crawl over pages written from the extracted records, from the first record of each host."""
    h = _html(spark, d)
    answers = h.groupBy(U.canonical_url("url").alias("url")).agg(F.max_by("body", "ord").alias("body"))
    answers = answers.select("url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), "body", F.lit(None).cast("string").alias("error"))
    seeds = h.groupBy(U.authority(F.col("url")).alias("h")).agg(F.min("url").alias("url"))
    pages, _ = C.crawl(seeds, answers, FN.robots_rules(_robots(spark, d), AGENT), max_depth=5)
    return pages.select("ord", "url", "depth", "status", "words", "verdict", "duplicate_of", "distance", "error")
