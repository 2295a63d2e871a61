"""Records judged line by line: restored once, then labelled and reported.

``Judge`` counts character pairs over all records, restores every text once into a table of the
shared folder, counts words and line templates over all of it, and fits the weights of the line
classifiers on all of its lines. Every task has the weights, the words of a share of the records,
and the file of pair scores. Each record is then judged by itself, with the lines that its site
repeats at hand.
"""

from __future__ import annotations

import functools
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, small, stage
from . import body, encoding, residue, templates, weights
from .repeats import site_of


#: Bytes of a short text.
SHORT_BYTES = 1000
_STAGED = "row bigint, key bigint, site string, title string, packed string, ends binary, text string, tokens string, marks binary, hint boolean"


class Judge:
    """Models for the pages of one table of records (ord, url, title, text column).

    ``text`` is the column that is judged, ``whole`` the one with all of a page, from which the
    models are fitted. ``hint`` tells, unreliably, that a record holds no real content; by default it
    is what the columns empty_app_root and noscript_hint say, if they are there.
    """

    def __init__(self, records: DataFrame, text: str = "text", key: str = "ord", whole: str = "text", hint: Column | None = None):
        self.records, self.text, self.key = records, text, key
        spark = records.sparkSession
        filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
        self.pairs, rows = encoding.count_pairs(records.where(filled(whole)), whole)
        shared = spark.sparkContext.broadcast(self.pairs)
        own = records.where(filled(whole) | filled(text)).select(
            F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("key"), site_of(F.col("url")).alias("site"), "title",
            F.col(whole).alias("whole"), F.col(text if text != whole else whole).alias("text"),
            F.coalesce(hinted(records) if hint is None else hint, F.lit(False)).alias("hint"),
        )
        self.staged = stage(own.mapInArrow(_restore(shared, text == whole), _STAGED))
        self.same = text == whole
        counts = templates.Counts(self.staged.where(filled("packed")).select("row", "site", "title", F.col("packed").alias("t"), "ends"), rows)
        self.repeated = counts.repeated
        self.body = weights.fit(counts)
        self.models = spark.sparkContext.broadcast(self.body)

    @functools.cached_property
    def content(self) -> DataFrame:
        """(key, own, sound, every, short, hint) of each judged text, labelled once for what goes over it
        several times: its content lines, those of them that are not damaged (null: all), all lines
        where the content has no words, whether it is short (``SHORT_BYTES``), and the hint."""

        def emit(keys, pages, hints, texts):
            for k, lines, h, t in zip(keys, pages, hints, texts):
                own = [x[0] for x in lines if not x[3] and x[0].strip()]
                sound = [x[0] for x in lines if not x[3] and x[2] and x[0].strip()]
                every = None if any(map(has_words, own)) else "\n".join(x[0] for x in lines if x[0])
                yield k, "\n".join(own), None if len(sound) == len(own) else "\n".join(sound), every, len(t) <= SHORT_BYTES and len(t.encode()) <= SHORT_BYTES, h

        return stage(self.judged(emit, "key bigint, own string, sound string, every string, short boolean, hint boolean", together=True, whole=True))

    def judged(self, emit, schema: str, together: bool = False, whole: bool = False) -> DataFrame:
        """Rows that ``emit(key, lines)`` yields for each record; key first in ``schema``. With
        ``together``, that ``emit(keys, lines of each)`` yields for some records at once, and with
        ``whole``, ``emit(keys, lines of each, hints, texts)``.

        lines: (text, damaged, whole, furniture) of each line. Null keys, null and empty texts are
        not judged.
        """
        models = self.models
        names = [c.strip().split()[0] for c in schema.split(",")]

        def run(batches):
            model = models.value
            for b in batches:
                for start, stop in encoding.portions(b.column(3)):
                    keys, sites, titles, texts, tokens, marks, known, hints = (c.to_pylist() for c in b.slice(start, stop - start).columns)
                    docs = [[(l, m & 1 == 1, m & 2 == 2) for l, m in zip(t.split("\n"), k)] for t, k in zip(texts, marks)]
                    labelled = body.label_lines(docs, titles, model, [(s, set(x or ())) for s, x in zip(sites, known)], tokens)
                    rows = list(emit(keys, labelled, *((hints, texts) if whole else ()))) if together else [r for k, lines in zip(keys, labelled) for r in emit(k, lines)]
                    yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(names, zip(*rows))} if rows else {n: [] for n in names}, schema=kinds)

        kinds = arrow_schema(schema)
        own = self.staged.where(F.col("key").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
        own = own.join(self.repeated.where(F.size("keys") > 0), "row", "left")
        packed = "packed" if self.same else "tokens"
        return own.select("key", "site", "title", "text", packed, "marks", "keys", "hint").mapInArrow(run, schema)


def has_words(line: str) -> bool:
    kinds = residue.kinds()
    return any(kinds[min(ord(c), 0xFFFF)] for c in line)


def hinted(records: DataFrame) -> Column:
    out = F.lit(False)
    for c in ("empty_app_root", "noscript_hint"):
        if c in records.columns:
            out = out | F.coalesce(F.col(c), F.lit(False))
    return out


def with_status(records: DataFrame, page: DataFrame, key: str = "ord") -> tuple[DataFrame, Column]:
    """(records, hint): hints by the records' own flags and by a status of 400 or more in ``page``.

    Only the keys of such pages are joined, broadcast if they have been counted as few.
    """
    bad = cut(page.where(F.col("status") >= 400).select(F.col(key).alias("_bad")).where("_bad is not null").distinct())
    both = records.join(small(bad), F.col(key) == F.col("_bad"), "left")
    return both, hinted(records) | F.col("_bad").isNotNull()


def _restore(pairs, same: bool):
    """Restores whole and text of each record at once; their equal lines are restored once."""

    def run(batches):
        for b in batches:
            for start, stop in encoding.portions(b.column(4)):
                part = b.slice(start, stop - start)
                whole, text = part.column(4).to_pylist(), part.column(5).to_pylist()
                if same:
                    joined = [w or "" for w in whole]
                else:
                    joined = []
                    for w, t in zip(whole, text):
                        seen = set(w.split("\n")) if w else set()
                        more = [l for l in dict.fromkeys((t or "").split("\n")) if l not in seen]
                        joined.append("\n".join([w or "", *more]))
                fixed = encoding.repair_texts(joined, pairs.value)
                packed, ends, texts, toks, marks = [], [], [], [], []
                every = iter(body.pack_lines([x[0].strip() for lines in fixed for x in lines]))
                for w, t, j, lines in zip(whole, text, joined, fixed):
                    n = w.count("\n") + 1 if w else 0
                    tokens = list(islice(every, len(lines)))
                    packed.append("\n".join(filter(None, tokens[:n])) if w else w)
                    ends.append(bytes([body.ends(x[0]) for x, k in zip(lines[:n], tokens) if k]))
                    if not same:
                        by = dict(zip(j.split("\n"), zip(lines, tokens)))
                        own = [by[l] for l in t.split("\n")] if t else []
                        lines = [x for x, _ in own]
                        toks.append("\n".join(filter(None, (k for _, k in own))) if t else None)
                    else:
                        toks.append(None)
                    texts.append("\n".join(x[0] for x in lines) if t else t)
                    marks.append(bytes([d + 2 * k for _, d, k in lines]) if t else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(packed, pa.string()), pa.array(ends, pa.binary()), pa.array(texts, pa.string()), pa.array(toks, pa.string()), pa.array(marks, pa.binary()), *part.columns[6:]],
                    names=["row", "key", "site", "title", "packed", "ends", "text", "tokens", "marks", "hint"],
                )

    return run


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split() for c in schema.split(","))])


def dropped_lines(records: DataFrame, text: str = "text") -> DataFrame:
    """(ord, line_no): the non-blank lines of ``text`` that are furniture, counted from 1.

    Null and empty texts have none; repeated rows are judged each and given once; other columns are
    ignored; an empty table gives no rows.
    """
    judge = Judge(records, text)
    return judge.judged(lambda k, lines: [(k, i) for i, x in enumerate(lines, 1) if x[3]], "ord bigint, line_no int").dropDuplicates()


def main_body(records: DataFrame, text: str = "text") -> DataFrame:
    """(ord, body): each record's content lines, restored where they were damaged."""
    judge = Judge(records, text)
    return judge.judged(lambda k, lines: [(k, "\n".join(x[0] for x in lines if not x[3]))], "ord bigint, body string")


def damaged_records(records: DataFrame, text: str = "text") -> DataFrame:
    """(ord): records with a damaged line in their own content, restorable or not."""
    judge = Judge(records, text)
    found = judge.judged(lambda k, lines: [(k,)] if any(x[1] and not x[3] for x in lines) else [], "ord bigint")
    return found.distinct()


def restored_lines(records: DataFrame, text: str = "text") -> DataFrame:
    """(ord, line_no, restored, whole): damaged content lines, restored as far as they can be.

    ``whole`` is false where characters are lost; ``restored`` then holds what is left.
    """
    judge = Judge(records, text)
    return judge.judged(
        lambda k, lines: [(k, i, x[0], x[2]) for i, x in enumerate(lines, 1) if x[1] and not x[3]],
        "ord bigint, line_no int, restored string, whole boolean",
    )
