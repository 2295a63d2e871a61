"""Inverted index, BM25, phrases, character n-grams and rank fusion over DataFrames.

The index is three tables: ``postings(term, doc_id, positions)``, ``docs(doc_id, url, title, len)``
and ``stats(n_docs, total_len)``. Queries come as a table ``(query_id, query)`` of any number.

A batch of queries is answered in one pass over the texts: the distinct terms, phrases and n-grams
of all its queries are numbered, and each document keeps of itself only its length and what the
batch asks for (``matched``, written to the shared folder). Document frequencies and statistics are
sums over that narrow table; scores are added up document by document inside a task, which sends on
the best of each query alone. Nothing of a common term is ever gathered in one row. Batches whose
terms are too many to be sent to every task are answered by joins on the term instead.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import cut, small

K1, B, FIELD_GAP, TITLE_WEIGHT = 1.2, 0.75, 1000, 2
#: Rows of a batch of queries (a term, phrase or n-gram of a query each) up to which all tasks get it.
ASKED_ROWS = 1_000_000
#: Documents that are scored at once against a batch.
SCORED = 512
_QUOTED = re.compile(r'"([^"]*)"')


def parse_query(query: str | None) -> tuple[list[str], list[list[str]]]:
    """(loose terms, phrases): quoted groups of two terms or more are phrases.

    A quoted single term is loose and comes last, empty quotes count for nothing, and an unclosed
    quote is ordinary text.
    """
    quoted = [T.term_list(m) for m in _QUOTED.findall(query or "")]
    single = [t for q in quoted if len(q) == 1 for t in q]
    return T.term_list(_QUOTED.sub(" ", query or "")) + single, [q for q in quoted if len(q) > 1]


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, kind, term, n): what each query asks for; kind is t for a term (those of its
    phrases too), p for a phrase (its terms with spaces between) and g for an n-gram."""

    def run(batches):
        grams = T.Grams()
        for b in batches:
            ids, kinds, terms, ns = [], [], [], []
            for q, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                loose, phrases = parse_query(text)
                words = list(dict.fromkeys([*loose, *(t for p in phrases for t in p)]))
                found = [("t", w, 1) for w in words] + [("p", p, 1) for p in dict.fromkeys(" ".join(p) for p in phrases)]
                found += [("g", g, n) for g, n in T.gram_counts(T.term_list(text), grams).items()]
                for kind, term, n in found:
                    ids.append(q), kinds.append(kind), terms.append(term), ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(terms, pa.string()), pa.array(ns, pa.int64())], names=["query_id", "kind", "term", "n"])

    own = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("bigint").alias("query_id"), "query")
    return own.mapInArrow(run, "query_id bigint, kind string, term string, n bigint")


class Batch:
    """A batch of queries that every task gets: terms, phrases and n-grams by number."""

    def __init__(self, rows: pa.Table):
        rows = rows.to_pydict()
        self.ids = sorted(set(rows["query_id"]))
        place = {q: k for k, q in enumerate(self.ids)}
        self.number: dict[str, dict[str, int]] = {"t": {}, "p": {}, "g": {}}
        uses: dict[str, list] = {"t": [], "p": [], "g": []}
        for q, kind, term, n in zip(*(rows[c] for c in ("query_id", "kind", "term", "n"))):
            k = self.number[kind].setdefault(term, len(self.number[kind]))
            if k == len(uses[kind]):
                uses[kind].append(([], []))
            uses[kind][k][0].append(place[q])
            uses[kind][k][1].append(n)
        #: Of each term, phrase and n-gram the queries that hold it, and how often.
        self.uses = {kind: [(np.array(q), np.array(n, "f8")) for q, n in u] for kind, u in uses.items()}
        self.phrases_needed = np.zeros(len(self.ids), "i8")
        for q, _ in self.uses["p"]:
            self.phrases_needed[q] += 1
        self.gram_norm = np.zeros(len(self.ids))
        for q, n in self.uses["g"]:
            self.gram_norm[q] += n * n
        self.gram_norm = np.sqrt(self.gram_norm)
        # Phrases by their first two terms; each is then followed term by term.
        terms, m = self.number["t"], len(self.number["t"])
        self.runs = [[terms[t] for t in p.split(" ")] for p in self.number["p"]]
        codes = np.array([r[0] * m + r[1] for r in self.runs], "i8")
        self.by_code = np.argsort(codes, kind="stable")
        self.codes = codes[self.by_code]

    def phrases_in(self, fields: list[np.ndarray]) -> list[int]:
        """Numbers of the phrases that stand in a document; fields: numbers of its terms, -1 others."""
        found: set[int] = set()
        m = len(self.number["t"])
        for f in fields if len(self.runs) else ():
            pair = np.where((f[:-1] >= 0) & (f[1:] >= 0), f[:-1] * m + f[1:], -1)
            lo, hi = np.searchsorted(self.codes, pair), np.searchsorted(self.codes, pair, "right")
            for i in np.flatnonzero(hi > lo):
                for p in self.by_code[lo[i] : hi[i]]:
                    run = self.runs[p]
                    if len(run) == 2 or f[i : i + len(run)].tolist() == run:
                        found.add(int(p))
        return sorted(found)


_MATCHED = "doc_id bigint, len bigint, terms array<int>, tfs array<int>, phrases array<int>, grams array<int>, cnts array<bigint>, norm double"


class Index:
    """An index over (doc_id, text) with optional title and url columns.

    Documents with null or empty text are not indexed; a null title is empty. Title terms stand
    twice, each field ends with a gap no phrase can cross.
    """

    def __init__(self, documents: DataFrame, title: str | None = "title", url: str | None = "url"):
        has = lambda c: c is not None and c in documents.columns
        self.plain = documents.where(F.length("text") > 0).select(
            "doc_id", (F.col(url) if has(url) else F.lit("")).alias("url"),
            F.coalesce(F.col(title) if has(title) else F.lit(""), F.lit("")).alias("title"), F.col("text").alias("_text"),
        )
        self.source = self.plain.withColumn("_t", T.terms_exact("title")).withColumn("_b", T.terms_exact("_text"))
        self.docs = self.source.select("doc_id", "url", "title", (F.size("_t") * TITLE_WEIGHT + F.size("_b")).alias("len"))

    def occurrences(self) -> DataFrame:
        """(doc_id, term, pos): one row per occurrence; a title's terms have two."""
        n = F.size("_t")
        at = lambda arr, shift: F.transform(arr, lambda t, i: F.struct(t.alias("term"), (i + shift).alias("pos")))
        every = F.concat(
            at(F.col("_t"), F.lit(0)), at(F.col("_t"), n + FIELD_GAP), at(F.col("_b"), n * TITLE_WEIGHT + TITLE_WEIGHT * FIELD_GAP)
        )
        return self.source.select("doc_id", F.explode(every).alias("o")).select("doc_id", "o.term", "o.pos")

    def vectors(self, grams: bool = False) -> DataFrame:
        """(doc_id, len, items array<struct<term,n>>): a document's terms, or the n-grams of its title
        and text, with counts. Each is counted where it is read."""
        names = ["doc_id", "len", "items"]

        def run(batches):
            known = T.Grams()
            for b in batches:
                for at in range(0, b.num_rows, SCORED):
                    part = b.slice(at, SCORED)
                    sizes, counts = [], []
                    for title, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        t, x = T.term_list(title), T.term_list(text)
                        sizes.append(TITLE_WEIGHT * len(t) + len(x))
                        counts.append(T.gram_counts(t + x, known) if grams else Counter(t * TITLE_WEIGHT + x))
                    items = pa.StructArray.from_arrays(
                        [pa.array([k for c in counts for k in c], pa.string()), pa.array([v for c in counts for v in c.values()], pa.int64())], names=["term", "n"]
                    )
                    ends = pa.array(np.cumsum([0, *map(len, counts)], dtype="i4"))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, items)], names=names)

        kind = self.plain.schema["doc_id"].dataType.simpleString()
        return self.plain.select("doc_id", "title", "_text").mapInArrow(run, f"doc_id {kind}, len bigint, items array<struct<term:string,n:bigint>>")

    def counts(self) -> DataFrame:
        """(doc_id, term, tf, len)."""
        return self.vectors().select("doc_id", "len", F.explode("items").alias("i")).select("doc_id", "len", "i.term", F.col("i.n").alias("tf"))

    def postings(self) -> DataFrame:
        """(term, doc_id, positions): a document's positions of a term, in order."""
        return self.occurrences().groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))

    def stats(self) -> DataFrame:
        return self.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))

    def save(self, path: str) -> None:
        """Postings clustered by term, documents and stats as tables under ``path``, version 2."""
        self.postings().repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.stats().withColumn("version", F.lit(2)).write.mode("overwrite").parquet(f"{path}/stats")

    def search(self, queries: DataFrame | dict[int, str], limit: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score): the best documents by BM25; all phrases must match."""
        return Search(self, queries).bm25(limit)


class Search:
    """A batch of queries over an index; each of its answers comes from the one pass of ``matched``.

    Null queries and those without terms have no answers; a query_id that is given twice asks for
    the terms of both.
    """

    def __init__(self, index: Index, queries: DataFrame | dict[int, str], grams: bool = False):
        spark = index.plain.sparkSession
        if isinstance(queries, dict):
            queries = spark.createDataFrame(sorted(queries.items()), "query_id int, query string")
        self.index, self.grams = index, grams
        every = asked(queries).groupBy("query_id", "kind", "term").agg(F.sum("n").alias("n"))
        every = cut(every if grams else every.where("kind <> 'g'"))
        self.asked = every
        self.sent = every.limit(ASKED_ROWS + 1).count() <= ASKED_ROWS
        if self.sent:
            self.batch = Batch(every.toArrow())
            self.shared = spark.sparkContext.broadcast(self.batch)
            self.matched = cut(index.plain.select(F.col("doc_id").cast("bigint").alias("doc_id"), "title", "_text").mapInArrow(self._match(), _MATCHED))

    def _match(self):
        shared, with_grams = self.shared, self.grams

        def run(batches):
            batch, known = shared.value, T.Grams()
            term, gram = batch.number["t"].get, batch.number["g"].get
            for b in batches:
                for at in range(0, b.num_rows, SCORED):
                    part = b.slice(at, SCORED)
                    cols: list[list] = [[] for _ in range(7)]
                    for title, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        t, x = T.term_list(title), T.term_list(text)
                        nt, nx = [term(w, -1) for w in t], [term(w, -1) for w in x]
                        tf = Counter(nt * TITLE_WEIGHT + nx)
                        tf.pop(-1, None)
                        phrases = batch.phrases_in([np.array(nt, "i8"), np.array(nx, "i8")]) if batch.runs else []
                        g, c, norm = [], [], 0.0
                        if with_grams:
                            counts = T.gram_counts(t + x, known)
                            norm = float(sum(v * v for v in counts.values())) ** 0.5
                            got = [(k, v) for w, v in counts.items() if (k := gram(w)) is not None]
                            g, c = [k for k, _ in got], [v for _, v in got]
                        for out, v in zip(cols, (TITLE_WEIGHT * len(t) + len(x), list(tf), list(tf.values()), phrases, g, c, norm)):
                            out.append(v)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(cols[0], pa.int64()), *(T.lists(cols[k], pa.int32()) for k in (1, 2, 3, 4)), T.lists(cols[5], pa.int64()), pa.array(cols[6], pa.float64())],
                        names=["doc_id", "len", "terms", "tfs", "phrases", "grams", "cnts", "norm"],
                    )

        return run

    def bm25(self, limit: int = 10, explain: bool = False) -> DataFrame:
        """(query_id, rank, doc_id, score): the best by BM25 of the documents with all phrases.

        With ``explain``, also (explanation): the parts of the score.
        """
        if not self.sent:
            return self._joined(limit)
        stats = self.matched.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
        df = np.zeros(len(self.batch.number["t"]))
        for r in self.matched.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r.t] = r.df  # a row for each term of the batch
        idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
        average = stats.total / stats.n if stats.n and stats.total else 1.0
        words = np.array(list(self.batch.number["t"]), object) if explain else None
        shared = self.shared

        def parts(docs):
            batch = shared.value
            lens = docs.column("len").to_numpy().astype("f8")
            doc, t, tf = _flat(docs, "terms", "tfs")
            part = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc] / average))
            scores = _added(len(lens), batch, "t", doc, t, part, ones=True)
            if batch.runs:
                have = np.zeros(scores.shape, "i2")
                d, p = _flat(docs, "phrases")
                for k in range(len(d)):
                    have[d[k], batch.uses["p"][p[k]][0]] += 1
                scores[have < batch.phrases_needed] = 0
            return scores, (doc, t, part)

        out = ranked(self.matched.mapInArrow(_best(shared, parts, limit, 6, words), _BEST), limit)
        return out.drop("parts") if not explain else out.select("query_id", "rank", "doc_id", "score", explanation("score", "parts").alias("explanation"))

    def cosine(self, limit: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score): the greatest cosines of n-gram counts."""
        shared = self.shared

        def parts(docs):
            batch = shared.value
            doc, g, n = _flat(docs, "grams", "cnts")
            dot = _added(docs.num_rows, batch, "g", doc, g, n)
            norm = docs.column("norm").to_numpy()
            return dot / np.maximum(norm[:, None] * batch.gram_norm[None, :], 1e-300), None

        return ranked(self.matched.mapInArrow(_best(shared, parts, limit, 6, None), _BEST), limit).drop("parts")

    def phrase_hits(self) -> DataFrame:
        """(query_id, doc_id): documents with every phrase of the query, of queries that have any."""
        need = self.asked.where("kind = 'p'").groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
        number = self.asked.sparkSession.createDataFrame(
            [(k, int(self.batch.ids[q])) for k, (qs, _) in enumerate(self.batch.uses["p"]) for q in qs], "p int, query_id bigint"
        )
        have = self.matched.select("doc_id", F.explode("phrases").alias("p")).join(small(number, ASKED_ROWS), "p").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("have"))
        return have.join(small(need, ASKED_ROWS), "query_id").where("have = need").select("query_id", "doc_id")

    def _joined(self, limit: int) -> DataFrame:
        """The answers by joins on the term, for a batch of any size.

        Documents are partitioned before they are scored, so scores add up without another shuffle.
        """
        words = self.asked.where("kind = 't'").select("query_id", "term")
        tf = self.index.counts().join(words.select("term").distinct(), "term", "left_semi").repartition("doc_id")
        scores = contributions(tf, self.index.stats(), words, lambda w: small(cut(w))).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
        runs = cut(self.asked.where("kind = 'p'").select(
            "query_id", F.col("term").alias("phrase"), F.posexplode(F.split("term", " ")).alias("offset", "term")
        ).withColumn("size", F.size(F.split("phrase", " "))))
        if runs.limit(1).count():
            plain = scores.join(runs.select("query_id").distinct(), "query_id", "left_anti")
            scores = scores.join(phrase_hits(self.index.occurrences(), runs), ["query_id", "doc_id"], "left_semi").unionByName(plain)
        return ranked(scores, limit)


_BEST = "query_id bigint, doc_id bigint, score double, parts array<struct<p:double,t:string>>"
_PARTS = pa.list_(pa.struct([("p", pa.float64()), ("t", pa.string())]))


def _flat(docs: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """(place of the document, values...) of list columns of equal lengths."""
    cols = [docs.column(n) for n in names]
    size = np.diff(cols[0].offsets.to_numpy())
    return [np.repeat(np.arange(docs.num_rows), size), *(c.flatten().to_numpy() for c in cols)]


def _added(n: int, batch: Batch, kind: str, doc: np.ndarray, term: np.ndarray, value: np.ndarray, ones: bool = False) -> np.ndarray:
    """(documents, queries): the sums of value times the query's weight, term by term."""
    out = np.zeros((n, len(batch.ids)))
    order = np.argsort(term, kind="stable")
    doc, term, value = doc[order], term[order], np.asarray(value, "f8")[order]
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else []
    for a, b in zip(starts, [*starts[1:], len(term)]):
        q, w = batch.uses[kind][term[a]]
        # a term stands once in a document's list
        out[doc[a:b, None], q[None, :]] += value[a:b, None] if ones else value[a:b, None] * w[None, :]
    return out


def _best(shared, parts, limit: int, decimals: int, words):
    """Scores documents in portions and yields the ``limit`` best of each query in each."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SCORED):
                docs = b.slice(at, SCORED)
                scores, why = parts(docs)
                ids = docs.column("doc_id").to_numpy()
                k = min(limit, len(scores))
                if not k:
                    continue
                near = np.round(scores, decimals)
                least = np.partition(near, len(near) - k, axis=0)[len(near) - k]
                d, q = np.nonzero((near >= least) & (scores > 0))
                order = np.lexsort((ids[d], -near[d, q], q))  # ties by document
                d, q = d[order], q[order]
                first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, "i8")
                place = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]))
                d, q = d[place < k], q[place < k]
                told = None
                if words is not None:
                    of: dict[int, list] = {}
                    for x, t, p in zip(*(v.tolist() for v in why)):
                        of.setdefault(x, []).append((t, p))
                    has = [set(map(int, u)) for u, _ in shared.value.uses["t"]]
                    told = [[{"p": p, "t": str(words[t])} for t, p in of[x] if y in has[t]] for x, y in zip(d.tolist(), q.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(shared.value.ids, "i8")[q]), pa.array(ids[d]), pa.array(scores[d, q]), pa.array(told if told is not None else [None] * len(d), _PARTS)],
                    names=["query_id", "doc_id", "score", "parts"],
                )

    return run


def explanation(score: str, parts: str) -> Column:
    """A score and its parts as text, the greatest part first."""
    line = F.array_sort(F.transform(parts, lambda x: F.struct((-F.round(x["p"], 6)).alias("p"), x["t"].alias("t"))))
    return F.concat(F.format_string("%.3f = ", score), F.array_join(F.transform(line, lambda x: F.format_string("%s %.3f", x["t"], -x["p"])), " + "))


class SavedIndex:
    """An index that was saved; a batch of queries reads the postings of its own terms.

    The postings are sorted by term, so few terms reach the row groups that can hold them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = lambda name: spark.read.parquet(f"{path}/{name}")
        if [r.version for r in self.table("stats").select("version").distinct().collect()] != [2]:
            raise ValueError("the index was saved in another version")

    def search(self, queries: DataFrame | dict[int, str], limit: int = 10) -> DataFrame:
        docs, stats = self.table("docs"), self.table("stats")
        spark = docs.sparkSession
        if isinstance(queries, dict):
            queries = spark.createDataFrame(sorted(queries.items()), "query_id int, query string")
        every = cut(asked(queries).where("kind <> 'g'"))
        terms = [r.term for r in every.where("kind = 't'").select("term").distinct().limit(1001).collect()]
        hit = self.table("postings")
        hit = hit.where(F.col("term").isin(terms)) if len(terms) <= 1000 else hit.join(small(cut(every.select("term").distinct())), "term", "left_semi")
        tf = hit.select("doc_id", "term", F.size("positions").alias("tf")).join(docs.select("doc_id", "len"), "doc_id")
        words = every.where("kind = 't'").select("query_id", "term").distinct()
        scores = contributions(tf, stats, words, lambda w: small(cut(w))).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
        runs = every.where("kind = 'p'").select("query_id", F.col("term").alias("phrase")).distinct()
        if runs.limit(1).count():
            runs = cut(runs.select("query_id", "phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term")).withColumn("size", F.size(F.split("phrase", " "))))
            occ = hit.join(small(cut(runs.select("term").distinct())), "term", "left_semi").select("doc_id", "term", F.explode("positions").alias("pos"))
            plain = scores.join(runs.select("query_id").distinct(), "query_id", "left_anti")
            scores = scores.join(phrase_hits(occ, runs), ["query_id", "doc_id"], "left_semi").unionByName(plain)
        return ranked(scores, limit)


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))


def contributions(tf: DataFrame, stats: DataFrame, words: DataFrame, placed) -> DataFrame:
    """(query_id, doc_id, term, part): what each query term adds to each document's BM25 score.

    tf: (doc_id, term, tf, len), at least for the terms of the queries. ``placed`` marks the weights
    (query_id, term, idf) for their join.
    """
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avg = stats.select("n_docs").scalar(), stats.select(F.coalesce(F.try_divide("total_len", "n_docs"), F.lit(1.0))).scalar()
    weight = words.join(df, "term").select("query_id", "term", idf(n, F.col("df")).alias("idf"))
    scored = tf.join(placed(weight), "term")  # one row per query and term
    length = F.when(avg > 0, F.col("len") / avg).otherwise(F.col("len").cast("double"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    return scored.select("query_id", "doc_id", "term", part.alias("part"))


def phrase_hits(occ: DataFrame, runs: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents with every phrase of the query.

    runs: (query_id, phrase, offset, term, size). A phrase of m terms stands where m occurrences share
    position minus offset, so matching is one sum over the occurrences of the phrases' terms.
    """
    at = occ.join(small(runs), "term").groupBy("query_id", "phrase", "size", "doc_id", (F.col("pos") - F.col("offset")).alias("start"))
    whole = at.agg(F.countDistinct("offset").alias("n")).where("n = size").select("query_id", "phrase", "doc_id").distinct()
    need = runs.groupBy("query_id").agg(F.countDistinct("phrase").alias("need"))
    return (
        whole.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("have")).join(need, "query_id").where("have = need").select("query_id", "doc_id")
    )


def ranked(scores: DataFrame, limit: int, decimals: int = 6) -> DataFrame:
    """(query_id, rank, doc_id, score, ...): the ``limit`` best of each query, ties by document."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    s = scores.withColumn("score", F.round("score", decimals))
    more = [c for c in scores.columns if c not in ("query_id", "doc_id", "score")]
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score", *more)


def fused(rankings: dict[str, DataFrame], limit: int = 10, k: int = 60) -> DataFrame:
    """(query_id, rank, doc_id, score, ranks): reciprocal rank fusion of named rankings."""
    every = None
    for name, r in sorted(rankings.items()):
        one = r.select("query_id", "doc_id", F.col("rank").alias("r"), F.lit(name).alias("name"))
        every = one if every is None else every.unionByName(one)
    got = every.groupBy("query_id", "doc_id").agg(
        F.sum(1 / (F.lit(float(k)) + F.col("r"))).alias("score"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("#", "name", F.col("r").cast("string")))), ", ").alias("ranks"),
    )
    return ranked(got, limit, 9)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, doc_id, side): which of two rankings holds each document."""
    x = a.select("query_id", "doc_id", F.lit(1).alias("x"))
    y = b.select("query_id", "doc_id", F.lit(1).alias("y"))
    side = F.when(F.col("y").isNull(), "only_first").when(F.col("x").isNull(), "only_second").otherwise("both")
    return x.join(y, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", side.alias("side"))
