"""Queries of the corpus operators, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import spread, table
from . import mixture, neardup, pages, pieces, repeats, residue, spam, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_SITES = r"""
    site AS (SELECT ord, nullif(regexp_extract(lower(trim(coalesce(min(final_url), min(url)))), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1), '') AS site
             FROM page WHERE ord IS NOT NULL GROUP BY ord)"""
_SPACE = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = rf"""{_SITES},
    own AS (SELECT e.ord, coalesce(s.site, nullif(regexp_extract(lower(trim(e.url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1), '')) AS site, string_split(e.main_text, chr(10)) AS l
            FROM extracted e LEFT JOIN site s ON e.ord = s.ord WHERE e.main_text IS NOT NULL),
    each AS (SELECT ord, site, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM own WHERE site IS NOT NULL),
    keyed AS (SELECT ord, site, line_no, regexp_replace(regexp_replace(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g'), '[0-9]+', '0', 'g') AS key FROM each),
    kept AS (SELECT site, key FROM keyed WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT ord) >= 8)"""


@query(f"WITH {_LINES} SELECT ord, line_no FROM keyed JOIN kept USING (site, key)")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.found_lines(table(spark, sf_dir, "extracted"), table(spark, sf_dir, "page")).select("ord", "line_no")


@query(
    f"""WITH {_LINES}, gone AS (SELECT ord, line_no FROM keyed JOIN kept USING (site, key)),
    left_ AS (SELECT k.ord, string_agg(k.line, chr(10) ORDER BY k.line_no) AS clean FROM each k ANTI JOIN gone g ON k.ord = g.ord AND k.line_no = g.line_no GROUP BY k.ord)
    SELECT e.ord, CASE WHEN e.main_text IS NULL THEN NULL ELSE coalesce(l.clean, CASE WHEN e.ord IN (SELECT ord FROM gone) THEN '' ELSE e.main_text END) END AS clean
    FROM extracted e LEFT JOIN left_ l ON e.ord = l.ord"""
)
def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_lines(table(spark, sf_dir, "extracted"), table(spark, sf_dir, "page"))


@query(f"""WITH RECURSIVE {_LINES}, n AS (SELECT site, key, count(DISTINCT ord) AS support FROM keyed JOIN kept USING (site, key) GROUP BY site, key),
    seq AS (SELECT ord, site, key, row_number() OVER (PARTITION BY ord ORDER BY line_no) AS i FROM keyed WHERE key <> ''),
    pair AS (SELECT DISTINCT a.ord, a.site, a.key AS a, b.key AS b FROM seq a JOIN seq b ON a.ord = b.ord AND b.i = a.i + 1 AND a.key <> b.key),
    edge AS (SELECT site, a, b FROM pair JOIN kept x ON x.site = pair.site AND x.key = a JOIN kept y ON y.site = pair.site AND y.key = b GROUP BY pair.site, a, b HAVING count(*) >= 8),
    both_ AS (SELECT site, a, b FROM edge UNION SELECT site, b, a FROM edge),
    reach(site, key, other) AS (SELECT site, key, key FROM n UNION SELECT r.site, r.key, e.b FROM reach r JOIN both_ e ON e.site = r.site AND e.a = r.other),
    least AS (SELECT site, key, min(other) AS block FROM reach GROUP BY site, key)
    SELECT n.site, n.key AS line, n.support, l.block FROM n JOIN least l ON n.site = l.site AND n.key = l.key""".replace("SELECT site, a, b FROM pair JOIN", "SELECT pair.site, a, b FROM pair JOIN"))
def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boilerplate blocks of each site: their lines with support."""
    return repeats.site_blocks(table(spark, sf_dir, "extracted"), table(spark, sf_dir, "page"))


@query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(spread(table(spark, sf_dir, "documents")))


@query()
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.Mixture(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")).taken()


@query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.Mixture(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")).shares()


@query("""WITH here AS (SELECT source, count(*) AS n FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY source)
    SELECT t.source, true AS within_cap, true AS even_copies, CASE WHEN h.n IS NOT NULL AND target_share > 0 AND max_repeats > 0 THEN true END AS share_met
    FROM (SELECT source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY source) t LEFT JOIN here h ON h.source = t.source""")
def p9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: whether its repeats stay within the cap, no document has two copies more than
    another, and its share is met (to less than one document; null where it has none or no share)."""
    mix = mixture.Mixture(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))
    every = mix.sized.select("source", "doc_id").join(mix.taken().groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")), ["source", "doc_id"], "left")
    copies = every.groupBy("source").agg(F.max(F.coalesce("n", F.lit(0))).alias("hi"), F.min(F.coalesce("n", F.lit(0))).alias("lo"))
    cap = spark.createDataFrame([(s, c, float(mix.quotas.get(s, 0.0))) for s, (_, c) in mix.targets.items()], "source string, cap int, quota double")
    largest = mix.sized.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    lacks = F.col("quota") - F.col("tokens_taken")
    met = (lacks > -1) & (lacks <= F.col("largest"))
    rows = mix.shares().join(cap, "source").join(copies, "source", "left").join(largest, "source", "left")
    return rows.select(
        "source", (F.col("most_copies") <= F.col("cap")).alias("within_cap"), (F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)) <= 1).alias("even_copies"),
        F.when((F.col("tokens_available") > 0) & (F.col("target_share") > 0) & (F.col("cap") > 0), met).alias("share_met"),
    )


@query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(spread(table(spark, sf_dir, "documents")), with_text=False).where("piece_no = 1").select("doc_id")


@query()
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(spread(table(spark, sf_dir, "documents")))


_NEAR = r"""w AS (SELECT ord, regexp_extract_all(lower(main_text), '[\p{L}\p{N}_]+') AS w FROM extracted WHERE main_text IS NOT NULL),
    g AS (SELECT DISTINCT ord, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) >= 25),
    n AS (SELECT ord, count(*) AS n FROM g GROUP BY ord),
    p AS (SELECT a.ord AS a, b.ord AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.ord < b.ord GROUP BY a.ord, b.ord),
    pairs AS (SELECT p.a AS ord_a, p.b AS ord_b FROM p JOIN n x ON x.ord = p.a JOIN n y ON y.ord = p.b WHERE 10 * p.c >= 6 * (x.n + y.n - p.c))"""


@query(f"WITH {_NEAR} SELECT ord_a, ord_b FROM pairs")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neardup.NearDuplicates(table(spark, sf_dir, "extracted"))
    return near.pairs().select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


@query(f"""WITH RECURSIVE {_NEAR}, sets AS (SELECT ord, md5(string_agg(g, '|' ORDER BY g)) AS h FROM g GROUP BY ord), cls AS (SELECT ord, min(ord) OVER (PARTITION BY h) AS rep FROM sets),
    both_ AS (SELECT ord_a AS a, ord_b AS b FROM pairs UNION SELECT ord_b, ord_a FROM pairs),
    reach(ord, other) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT r.ord, e.b FROM reach r JOIN both_ e ON e.a = r.other)
    SELECT r.ord, any_value(c.rep) AS class_ord, min(r.other) AS group_ord FROM reach r JOIN cls c ON c.ord = r.ord GROUP BY r.ord""")
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neardup.NearDuplicates(table(spark, sf_dir, "extracted"))
    return near.groups().select(F.col("id").alias("ord"), F.col("rep").alias("class_ord"), F.col("grp").alias("group_ord"))


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.damaged_records(spread(table(spark, sf_dir, "extracted")))


@query()
def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.restored_lines(spread(table(spark, sf_dir, "extracted")))


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.dropped_lines(spread(table(spark, sf_dir, "extracted")))


@query()
def p6_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_body(spread(table(spark, sf_dir, "extracted")))


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, hint = pages.with_status(spread(table(spark, sf_dir, "extracted")), table(spark, sf_dir, "page"))
    return spam.found(pages.Judge(records, "main_text", hint=hint))


@query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, hint = pages.with_status(spread(table(spark, sf_dir, "extracted")), table(spark, sf_dir, "page"))
    return residue.found(pages.Judge(records, "main_text", hint=hint))
