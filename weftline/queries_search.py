"""Queries over the index operators, and their SQL twins."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from .operators import search as S
from .plans.shared import spread, table

QUERIES: dict = {}
SQL: dict = {}

def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_TERM = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"


def _fold(col: str) -> str:
    """NFKC and case folding in SQL, for text of the blocks below beside plain letters."""
    out = f"lower(nfc_normalize(coalesce({col}, '')))"
    for c in map(chr, [*range(0xA0, 0x250), *range(0x2070, 0x209D), *range(0x2153, 0x2160), *range(0xFB00, 0xFB07)]):
        exact = unicodedata.normalize("NFKC", c).casefold()
        if exact != c.lower():
            out = f"replace({out}, '{c.lower()}', '{exact}')"
    return out


def _terms(col: str) -> str:
    return f"list_filter(regexp_extract_all({_fold(col)}, '{_TERM}'), lambda t: length(t) <= 64)"


_BASE = f"""
 src0 AS (SELECT doc_id, {_terms('title')} AS t FROM documents),
 src AS (SELECT doc_id, coalesce(url, '') AS url, title, {_terms('title')} AS t, {_terms('text')} AS b FROM documents WHERE length(text) > 0),
 docs AS (SELECT doc_id, url, coalesce(title, '') AS title, 2 * len(t) + len(b) AS len FROM src),
 occ AS (SELECT doc_id, unnest(list_concat(t, list_concat(t, b))) AS term,
         unnest(list_concat(list_transform(range(len(t)), lambda i: i), list_concat(list_transform(range(len(t)), lambda i: len(t) + 1000 + i), list_transform(range(len(b)), lambda i: 2 * len(t) + 2000 + i)))) AS pos FROM src),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term),
 st AS (SELECT count(*) AS n, coalesce(sum(len), 0) AS total FROM docs)"""


#: The batch of queries: the titles of all documents whose id is divisible by 50.
_ASKED = "asked AS (SELECT DISTINCT doc_id AS query_id, unnest(t) AS term FROM src0 WHERE doc_id % 50 = 0)"
#: The batch with phrases: the first two words of those titles as a phrase, and their last word.
_PHRASED = f"""ph0 AS (SELECT doc_id AS query_id, {_terms("array_to_string(string_split(replace(title, chr(34), ''), ' ')[1:2], ' ')")} AS p, {_terms("string_split(replace(title, chr(34), ''), ' ')[-1]")} AS l
   FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
 asked AS (SELECT DISTINCT query_id, unnest(list_concat(p, l)) AS term FROM ph0),
 runs AS (SELECT query_id, 0 AS phrase_no, CAST(unnest(range(len(p))) AS INTEGER) AS ofs, unnest(p) AS term, len(p) AS size FROM ph0 WHERE len(p) > 1)"""


_PARTS = """
 df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
 parts AS (SELECT a.query_id, f.doc_id, f.term,
   ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * d.len / (st.total / st.n))) AS part
   FROM asked a JOIN tf f ON a.term = f.term JOIN df ON df.term = f.term JOIN docs d ON d.doc_id = f.doc_id, st)"""
_HITS = """
 starts AS (SELECT r.query_id, r.phrase_no, r.size, o.doc_id, o.pos - r.ofs AS start, count(DISTINCT r.ofs) AS n FROM occ o JOIN runs r ON o.term = r.term GROUP BY ALL),
 whole AS (SELECT DISTINCT query_id, phrase_no, doc_id FROM starts WHERE n = size),
 hits AS (SELECT query_id, doc_id FROM whole w GROUP BY query_id, doc_id HAVING count(*) = (SELECT count(DISTINCT phrase_no) FROM runs r WHERE r.query_id = w.query_id))"""


def _ranked(source: str, k: int = 10, decimals: int = 6) -> str:
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM (SELECT query_id, doc_id, round(score, {decimals}) AS score FROM {source})) WHERE rank <= {k}"""


_SUM = "scored AS (SELECT query_id, doc_id, sum(part) AS score FROM parts GROUP BY query_id, doc_id)"


def _index(spark, d):
    return S.Index(spread(table(spark, d, "documents")))


def _titles(spark, d):
    docs = table(spark, d, "documents").where(F.col("doc_id") % 50 == 0)
    return docs.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _phrases(spark, d):
    plain = F.replace("query", F.lit('"'), F.lit(""))
    quoted = F.concat(F.lit('"'), F.substring_index(plain, " ", 2), F.lit('" '), F.substring_index(plain, " ", -1))
    return _titles(spark, d).select("query_id", quoted.alias("query"))


@query(f"WITH {_BASE}, {_ASKED}, {_PARTS}, {_SUM} {_ranked('scored')}")
def bm25_topk(spark, d):
    return _index(spark, d).search(_titles(spark, d))


@query(f"""WITH {_BASE}, {_PHRASED}, {_PARTS}, {_HITS},
 {_SUM}, kept AS (SELECT * FROM scored s WHERE (SELECT count(*) FROM runs r WHERE r.query_id = s.query_id) = 0 OR EXISTS (SELECT 1 FROM hits h WHERE h.query_id = s.query_id AND h.doc_id = s.doc_id))
 {_ranked('kept')}""")
def phrase_filtered_bm25(spark, d):
    return _index(spark, d).search(_phrases(spark, d))


@query(f"WITH {_BASE}, {_PHRASED}, {_HITS} SELECT query_id, doc_id FROM hits")
def phrase_match(spark, d):
    return S.Search(_index(spark, d), _phrases(spark, d)).phrase_hits()


@query(f"""WITH {_BASE}, {_ASKED}, {_PARTS}, {_SUM}, top AS ({_ranked('scored', 3)}),
 lines AS (SELECT query_id, doc_id, string_agg(format('{{}} {{:.3f}}', term, p), ' + ' ORDER BY p DESC, term) AS l FROM (SELECT query_id, doc_id, term, round(part, 6) AS p FROM parts) GROUP BY ALL)
 SELECT t.query_id, t.rank, t.doc_id, t.score, format('{{:.3f}} = ', t.score) || l.l AS explanation FROM top t JOIN lines l ON t.query_id = l.query_id AND t.doc_id = l.doc_id""")
def bm25_explain(spark, d):
    return S.Search(_index(spark, d), _titles(spark, d)).bm25(3, explain=True)


@query(f"WITH {_BASE} SELECT term, doc_id, list_sort(list(pos)) AS positions FROM occ GROUP BY term, doc_id")
def postings_positions(spark, d):
    """The postings of all terms."""
    return _index(spark, d).postings().withColumn("positions", F.col("positions").cast("array<bigint>"))


@query(f"WITH {_BASE} SELECT doc_id, url, title, len FROM docs")
def document_lengths(spark, d):
    return _index(spark, d).docs.withColumn("len", F.col("len").cast("bigint"))


@query(f"WITH {_BASE} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_occurrences FROM tf GROUP BY doc_id")
def token_counts(spark, d):
    sizes = _index(spark, d).vectors().where(F.size("items") > 0)
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return sizes.select("doc_id", F.size("items").cast("bigint").alias("n_terms"), total.alias("n_occurrences"))


@query(f"WITH {_BASE} SELECT term, count(*) AS df, round(ln(1 + (any_value(st.n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf, st GROUP BY term")
def doc_frequency_idf(spark, d):
    ix = _index(spark, d)
    df = ix.counts().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = ix.plain.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.select("term", "df", F.round(S.idf(n, F.col("df")), 6).alias("idf"))


@query(f"""WITH {_BASE} SELECT (SELECT n FROM st) AS documents, (SELECT count(DISTINCT term) FROM tf) AS terms, (SELECT count(*) FROM tf) AS postings,
 (SELECT count(*) FROM occ) AS positions, round((SELECT total / n FROM st), 1) AS avg_length""")
def index_stats(spark, d):
    ix = _index(spark, d)
    # Sums by term first, and one row for each document that has none: everything from one pass.
    each = ix.vectors().select("len", F.explode_outer("items").alias("i"), F.size("items").alias("k"))
    by = each.groupBy("i.term").agg(F.count("i.term").alias("postings"), F.sum("i.n").alias("positions"), F.sum(F.when(F.col("k") > 0, F.lit(1.0) / F.col("k")).otherwise(1.0)).alias("d"))
    c = by.agg(F.count("term").alias("terms"), F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"), F.coalesce(F.sum("positions"), F.lit(0)).alias("positions"), F.coalesce(F.round(F.sum("d")), F.lit(0)).cast("bigint").alias("documents"))
    return c.select("documents", "terms", "postings", "positions", F.round(F.col("positions") / F.col("documents"), 1).alias("avg_length"))


_GRAMS = f"""
 g0 AS (SELECT doc_id, unnest({_terms("concat_ws(' ', coalesce(title, ''), text)")}) AS term FROM documents WHERE length(text) > 0),
 g1 AS (SELECT doc_id, '^' || term || '$' AS p, count(*) AS k FROM g0 GROUP BY ALL),
 g2 AS (SELECT doc_id, k, unnest(CASE WHEN length(p) <= 3 THEN [p] ELSE list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3)) END) AS gram FROM g1),
 vec AS (SELECT doc_id, gram, sum(k)::BIGINT AS cnt FROM g2 GROUP BY doc_id, gram)"""


_GASKED = f"""ga0 AS (SELECT doc_id AS query_id, '^' || unnest(t) || '$' AS p FROM src0 WHERE doc_id % 50 = 0),
 ga AS (SELECT query_id, unnest(CASE WHEN length(p) <= 3 THEN [p] ELSE list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3)) END) AS gram FROM ga0),
 gq AS (SELECT query_id, gram, count(*) AS q FROM ga GROUP BY ALL)"""


_COS = """
 qn AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM gq GROUP BY query_id),
 dn AS (SELECT doc_id, sqrt(sum(cnt * cnt)) AS dn FROM vec GROUP BY doc_id),
 cosine AS (SELECT q.query_id, v.doc_id, sum(v.cnt * q.q) / (any_value(qn.qn) * any_value(dn.dn)) AS score FROM vec v JOIN gq q ON v.gram = q.gram JOIN qn ON qn.query_id = q.query_id JOIN dn ON dn.doc_id = v.doc_id GROUP BY q.query_id, v.doc_id)"""


@query(f"WITH {_GRAMS} SELECT gram, count(*) AS documents, sum(cnt)::BIGINT AS total FROM vec GROUP BY gram")
def char_grams(spark, d):
    each = _index(spark, d).vectors(grams=True).select(F.explode("items").alias("i"))
    return each.groupBy(F.col("i.term").alias("gram")).agg(F.count(F.lit(1)).alias("documents"), F.sum("i.n").alias("total"))


@query(f"WITH {_GRAMS} SELECT doc_id, round(sqrt(sum(cnt * cnt)), 6) AS norm FROM vec GROUP BY doc_id")
def gram_norms(spark, d):
    squares = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["n"] * x["n"])
    return _index(spark, d).vectors(grams=True).where(F.size("items") > 0).select("doc_id", F.round(F.sqrt(squares.cast("double")), 6).alias("norm"))


@query(f"WITH {_BASE}, {_GRAMS}, {_GASKED}, {_COS} {_ranked('cosine')}")
def ngram_cosine_topk(spark, d):
    return S.Search(_index(spark, d), _titles(spark, d), grams=True).cosine()


def _both(spark, d, limit):
    asked = S.Search(_index(spark, d), _titles(spark, d), grams=True)
    return asked.bm25(limit), asked.cosine(limit)


@query(f"""WITH {_BASE}, {_ASKED}, {_PARTS}, {_SUM}, {_GRAMS}, {_GASKED}, {_COS},
 a AS ({_ranked('scored', 50)}), b AS ({_ranked('cosine', 50)}),
 u AS (SELECT query_id, doc_id, rank, 'bm25' AS name FROM a UNION ALL SELECT query_id, doc_id, rank, 'ngram' FROM b),
 f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(name || '#' || rank, ', ' ORDER BY name) AS ranks FROM u GROUP BY ALL),
 r AS ({_ranked('f', 10, 9)}) SELECT r.*, f.ranks FROM r JOIN f ON r.query_id = f.query_id AND r.doc_id = f.doc_id""")
def rrf_fusion(spark, d):
    a, b = _both(spark, d, 50)
    return S.fused({"bm25": a, "ngram": b})


@query(f"""WITH {_BASE}, {_ASKED}, {_PARTS}, {_SUM}, {_GRAMS}, {_GASKED}, {_COS},
 a AS ({_ranked('scored')}), b AS ({_ranked('cosine')})
 SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'only_first' WHEN a.doc_id IS NULL THEN 'only_second' ELSE 'both' END AS side
 FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id""")
def retriever_compare(spark, d):
    return S.compared(*_both(spark, d, 10))


@query(f"WITH {_GRAMS} SELECT (SELECT count(DISTINCT doc_id) FROM vec) AS documents, (SELECT count(DISTINCT gram) FROM vec) AS grams, (SELECT count(*) FROM vec) AS postings")
def ngram_stats(spark, d):
    own = _index(spark, d).vectors(grams=True).where(F.size("items") > 0)
    by = own.select(F.size("items").alias("k"), F.explode("items").alias("i")).groupBy("i.term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1.0) / F.col("k")).alias("d"))
    return by.agg(F.coalesce(F.round(F.sum("d")), F.lit(0)).cast("bigint").alias("documents"), F.count(F.lit(1)).alias("grams"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
