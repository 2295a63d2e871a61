"""What recurs in the pages of a whole corpus: words, line templates, sidebar headings, bylines.

All counts are Spark aggregations over all records, with partial sums in each batch. Templates are
counted twice: across sites with rare words masked, where support is a share of all records, and
within each site with digits alone masked, where ``body.MANY`` records are enough if they are
``SITE_SHARE`` of the site. Nothing is collected but the words of templates (at least
``body.KNOWN_SHARE`` of the records hold each, so their number does not grow) and the starts of
bylines (as few by ``body.MANY_SHARE``).
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, few, small
from . import body, encoding

#: Counts of words a task holds before it sends them on.
HELD = 200_000
#: Share of a site's records that must hold a template counted within the site.
SITE_SHARE = 0.1
_WORDS = "token string, site string, n bigint, plain bigint"
_LINES = "row bigint, codes binary, ends binary, site string, longest bigint, hosted int, after int, start bigint, lines array<struct<c:bigint,f:bigint,ok:boolean,own:boolean,n:int,long:boolean>>"
_LINE = pa.struct([("c", pa.int64()), ("f", pa.int64()), ("ok", pa.bool_()), ("own", pa.bool_()), ("n", pa.int32()), ("long", pa.bool_())])
_PAGE = pa.schema([("row", pa.int64()), ("codes", pa.binary()), ("ends", pa.binary()), ("site", pa.string()), ("longest", pa.int64()), ("hosted", pa.int32()), ("after", pa.int32()), ("start", pa.int64()), ("lines", pa.list_(_LINE))])


def _portions(batches):
    """The columns of portions of batches of (row, site, title, text and more)."""
    for b in batches:
        for start, stop in encoding.portions(b.column(3)):
            yield [c.to_pylist() for c in b.slice(start, stop - start).columns]


class _WordCounts:
    """In how many texts each word stands, in how many of them in lower case, and in how many of each site
    it is always written with a capital."""

    def __init__(self):
        self.words, self.sites = body.Spellings(), {}
        self.n, self.plain = np.zeros((2, 0), "i8")
        self.capital = np.zeros(0, "u8"), np.zeros(0, "i8")

    def __len__(self) -> int:
        return len(self.words) + len(self.capital[0])

    def add(self, sites: list[str | None], texts: list[str]) -> None:
        page, word, lower = self.words.pages(texts)
        count = lambda own, before: np.bincount(own, minlength=len(self.words.words)) + np.pad(before, (0, len(self.words.words) - len(before)))
        self.n, self.plain = count(word, self.n), count(word[lower], self.plain)
        site = np.array([-1 if s is None else self.sites.setdefault(s, len(self.sites)) for s in sites], "i8")[page]
        use = ~lower & (site >= 0) & np.array(self.words.long, bool)[word]
        key = np.concatenate([self.capital[0], (site[use].astype("u8") << np.uint64(32)) | word[use].astype("u8")])
        each, of = np.unique(key, return_inverse=True)
        self.capital = each, np.bincount(of, np.concatenate([self.capital[1], np.ones(int(use.sum()), "i8")]), len(each)).astype("i8")

    def counted(self) -> pa.RecordBatch:
        """(token, site, n, plain), with a null site for all texts."""
        words, sites, hit = self.words.words, list(self.sites), np.flatnonzero(self.n)
        key, n = self.capital
        token = [words[k] for k in hit.tolist()] + [words[k] for k in (key & np.uint64(0xFFFFFFFF)).tolist()]
        site = [None] * len(hit) + [sites[k] for k in (key >> np.uint64(32)).tolist()]
        cols = token, site, np.concatenate([self.n[hit], n]), np.concatenate([self.plain[hit], np.zeros(len(n), "i8")])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["token", "site", "n", "plain"])


def known_words(pages: DataFrame, rows: int) -> dict[str, int]:
    """The words that templates keep, numbered from 2. pages: (row, site, title, text), restored and packed."""

    def run(batches):
        held = _WordCounts()
        for _, sites, _, texts, *_ in _portions(batches):
            held.add(sites, texts)
            if len(held) > HELD:
                yield held.counted()
                held = _WordCounts()
        yield held.counted()

    # Rows without a site count a word in all records, those with one the records of that site in
    # which it is always written with a capital.
    each = pages.mapInArrow(run, _WORDS).groupBy("token", "site").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"))
    all_, own = F.col("site").isNull(), F.col("site").isNotNull()
    df = each.groupBy("token").agg(F.sum(F.when(all_, F.col("n"))).alias("df"), F.sum(F.when(all_, F.col("plain"))).alias("plain"), F.max(F.when(own, F.col("n"))).alias("top"))
    # Words of one site that are written with a capital are its names; templates hold on many sites.
    name = (F.length("token") > 1) & (F.col("plain") < 0.2 * F.col("df")) & (F.coalesce("top", F.lit(0)) > 0.7 * F.col("df"))
    alone = pages.select(F.coalesce("site", F.lit(""))).distinct().limit(3).count() < 3
    kept = df.where(F.col("df") >= max(3, body.KNOWN_SHARE * rows))
    kept = kept if alone else kept.where(~name)
    return {t: i + 2 for i, t in enumerate(sorted(r.token for r in kept.select("token").collect()))}


def code_kind(words: dict) -> str:
    """Of the numbers of a line's words."""
    return "u2" if len(words) < 65_000 else "i4"


def page_lines(pages: DataFrame, words) -> DataFrame:
    """One row per record: the numbers of its words in a row, keys and form of its non-blank lines."""

    def run(batches):
        numbers, kind_ = body.Numbers(words.value), code_kind(words.value)
        for rows, sites, titles, texts, stops in _portions(batches):
            out = [body.keyed(site, title, text, numbers) for site, title, text in zip(sites, titles, texts)]
            flat = lambda f, kind: pa.array([v for k in out for v in f(k)], kind)  # noqa: B023, E731
            ends = np.cumsum([0, *(len(k.toks) for k in out)], dtype="i4")
            line = pa.StructArray.from_arrays([
                flat(lambda k: k.cross, pa.int64()), flat(lambda k: k.within, pa.int64()), flat(lambda k: k.counts, pa.bool_()),
                flat(lambda k: k.own, pa.bool_()), flat(lambda k: map(len, k.toks), pa.int32()), flat(lambda k: k.long, pa.bool_()),
            ], fields=list(_LINE))
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), pa.array([np.fromiter(chain.from_iterable(k.codes), kind_).tobytes() for k in out], pa.binary()), pa.array(stops, pa.binary()),
                pa.array(sites, pa.string()), pa.array([k.longest for k in out], pa.int64()), pa.array([k.hosted for k in out], pa.int32()),
                pa.array([k.after for k in out], pa.int32()), pa.array([k.start for k in out], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), line),
            ], schema=_PAGE)

    return pages.mapInArrow(run, _LINES)


_ONCE = "key bigint, wide boolean, longest bigint, n bigint, h bigint, lo bigint, hi bigint"


def _once(lines: DataFrame, key: str, use: str, by_longest: bool = False) -> DataFrame:
    """How many pages show each key of those lines that ``use`` tells, and whether it is a long line: the
    pages ``n``, the sum ``h`` of their ``hosted`` (the greatest by the pages' longest line), and the least
    and greatest hash of their sites; the partial results of each batch."""

    def run(batches):
        for b in batches:
            edge = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False))])
            keys, used, wide = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            page = np.repeat(np.arange(b.num_rows), np.diff(edge))[used]
            keys, wide = keys[used], wide[used] >= 14
            site, hosted, longest = (b.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(3))
            group = longest[page] if by_longest else np.zeros(len(page), "i8")
            order = np.lexsort((page, group, wide, keys))
            page, keys, wide, group = page[order], keys[order], wide[order], group[order]
            new = np.ones(len(page), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (wide[1:] != wide[:-1]) | (group[1:] != group[:-1])
            once = new.copy()
            once[1:] |= page[1:] != page[:-1]
            start, page = np.flatnonzero(new[once]), page[once]
            keys, wide, group = keys[new], wide[new], group[new]
            if not len(start):
                continue
            n = np.diff(np.append(start, len(page)))
            h = (np.maximum if by_longest else np.add).reduceat(hosted[page].astype("i8"), start)
            lo, hi = (f.reduceat(site[page], start) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, wide, group, n, h, lo, hi)], names=[c.split()[0] for c in _ONCE.split(", ")])

    return lines.select(F.xxhash64(F.coalesce("site", F.lit(""))).alias("site"), "hosted", "longest", f"lines.{key}", f"lines.{use}", "lines.n").mapInArrow(run, _ONCE)


def _states(lines: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(c, s) and (f, s): what recurs across sites and within one; s is 1 for furniture, -1 for content."""
    many = max(body.MANY, body.MANY_SHARE * rows)

    def least(x: float | Column) -> Column:
        # Long lines recur in edited copies of one page too.
        return F.when(F.col("wide"), 3 * F.lit(x) if isinstance(x, (int, float)) else 3 * x).otherwise(x)

    cross = _once(lines, "c", "ok").groupBy("key", "wide").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cross = cross.where(F.col("n") >= least(many)).select(F.col("key").alias("c"), F.when(F.col("h") >= body.HOSTED * F.col("n"), 1).when(F.col("lo") != F.col("hi"), -1).alias("s")).where("s is not null")
    sited = lines.where("site is not null")
    size = sited.groupBy(F.xxhash64("site").alias("lo")).agg(F.count(F.lit(1)).alias("pages"))
    # Edited copies of one page, told by their longest line, support a template once.
    within = _once(sited, "f", "own", True).groupBy("lo", F.col("key").alias("f"), "wide", "longest").agg(F.max("h").alias("hosted"), F.sum("n").alias("n"))
    within = within.groupBy("lo", "f", "wide").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("hosted").alias("h"))
    within = within.where(F.col("k") >= least(body.MANY)).join(size, "lo").where((F.col("n") >= SITE_SHARE * F.col("pages")) & (F.col("h") >= body.HOSTED * F.col("k")))
    return cross.dropDuplicates(["c"]), within.select("f", F.lit(1).alias("s")).dropDuplicates(["f"])


def flat_lines(column: pa.Array, *names: str) -> tuple[list[int], list[list]]:
    """(where each page's lines start and the last ones end, each field of all lines in a row) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lines = column.flatten()
    edge = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype("i8"))])
    return edge.tolist(), [lines.field(n).to_numpy(zero_copy_only=False).tolist() for n in names]


class Table:
    """Numbers other than 0 by key, for arrays of keys; 0 for all other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype("i4")

    @classmethod
    def of(cls, df: DataFrame, key: str) -> "Table":
        """A counted table (key, s)."""
        got = df.select(key, "s").toArrow()
        return cls(got[key].to_numpy(), got["s"].to_numpy())

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), "i4")
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0)


_JUDGED = "row bigint, after int, start bigint, codes binary, ends binary, lines array<struct<i:int,key:bigint,n:int,long:boolean,s:int>>, keys array<bigint>"


def _judged(lines: DataFrame, cross: Table, within: Table) -> DataFrame:
    """``Counts.judged`` by tables that every task holds: no line leaves its page."""
    states = lines.sparkSession.sparkContext.broadcast((cross, within))

    def run(batches):
        across, inside = states.value
        for b in batches:
            own = b.column("lines").flatten()
            c, f = (own.field(k).to_numpy(zero_copy_only=False) for k in "cf")
            edge = np.array(flat_lines(b.column("lines"))[0])
            page = np.repeat(np.arange(b.num_rows), np.diff(edge))
            sc, sf = across[c], inside[f]
            line = pa.StructArray.from_arrays(
                [pa.array(np.arange(len(c)) - edge[page], pa.int32()), pa.array(np.where(sc != 0, c, f)), own.field("n"), own.field("long"), pa.array(np.where(sc != 0, sc, sf), pa.int32())],
                names=["i", "key", "n", "long", "s"],
            )
            use = np.flatnonzero(sf == 1)
            use = use[np.lexsort((f[use], page[use]))]
            once = use[np.concatenate([[True], (f[use][1:] != f[use][:-1]) | (page[use][1:] != page[use][:-1])])[: len(use)]]
            keys = pa.ListArray.from_arrays(pa.array(np.searchsorted(page[once], np.arange(b.num_rows + 1)), pa.int32()), pa.array(f[once], pa.int64()))
            rest = [b.column(k) for k in ("row", "after", "start", "codes", "ends")]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), line), keys], names=["row", "after", "start", "codes", "ends", "lines", "keys"])

    return lines.select("row", "after", "start", "codes", "ends", "lines").mapInArrow(run, _JUDGED)


def _runs(batches):
    """(kind, key, below, follows): headings above short runs below the text, and starts of bylines."""
    for b in batches:
        below, follows, starts = Counter(), Counter(), Counter()
        edge, (keys, sizes, longs, states) = flat_lines(b.column(2), "key", "n", "long", "s")
        for p, (after, start) in enumerate(zip(*(c.to_pylist() for c in b.columns[:2]))):
            own = slice(edge[p], edge[p + 1])
            s = states[own]
            long = [lg and x != 1 for lg, x in zip(longs[own], s)]
            for i, j in body.sidebar_runs(s, long, sizes[own]):
                key = keys[edge[p] + i]
                below[key] += 1
                if j:
                    follows[key] += 1
            if start is not None and after < len(s) and not long[after]:
                starts[start] += 1
        keys = [(0, k) for k in below] + [(1, k) for k in starts]
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([k for k, _ in keys], pa.int32()), "key": pa.array([k for _, k in keys], pa.int64()),
            "below": pa.array([*below.values(), *starts.values()], pa.int64()), "follows": pa.array([follows[k] if not kind else 0 for kind, k in keys], pa.int64()),
        })


class Counts:
    """What all ``pages`` (row, site, title, text, ends) show, texts restored and packed; ends: a byte for
    each non-blank line, 1 if it ends a sentence.

    ``lines``: ``page_lines``; ``cross``, ``within``: ``_states``; ``judged``: (row, after, start, codes,
    ends, lines, keys), the lines with their state; ``heads``: (key) of headings of sidebars; ``starts``: of bylines;
    ``repeated``: (row, keys), for each page the keys of those of its lines that are its site's own
    furniture by count.
    """

    def __init__(self, pages: DataFrame, rows: int):
        spark = pages.sparkSession
        self.words = known_words(pages, rows)
        self.lines = lines = cut(page_lines(pages, spark.sparkContext.broadcast(self.words)))
        self.cross, self.within = (cut(x) for x in _states(lines, rows))
        if few(self.cross) and few(self.within):
            self.judged = cut(_judged(lines, Table.of(self.cross, "c"), Table.of(self.within, "f")))
        else:
            self.judged = cut(self._joined())
        found = cut(self.judged.select("after", "start", "lines").mapInArrow(_runs, "kind int, key bigint, below bigint, follows bigint").groupBy("kind", "key").agg(F.sum("below").alias("below"), F.sum("follows").alias("follows")))
        self.heads = found.where("kind = 0 and follows > 0 and follows >= 0.5 * below").select("key")
        self.starts = {r.key for r in found.where((F.col("kind") == 1) & (F.col("below") >= 2 * max(body.MANY, body.MANY_SHARE * rows))).collect()}
        self.repeated = self.judged.select("row", "keys")

    def _joined(self) -> DataFrame:
        """``judged`` where more recurs than every task may hold."""
        each = self.lines.select("row", "after", "start", F.posexplode("lines").alias("i", "l")).select("row", "after", "start", "i", "l.c", "l.f", "l.n", "l.long")
        each = each.join(small(self.cross.withColumnRenamed("s", "sc")), "c", "left").join(small(self.within.withColumnRenamed("s", "sf")), "f", "left")
        line = F.struct("i", F.when(F.col("sc").isNotNull(), F.col("c")).otherwise(F.col("f")).alias("key"), "n", "long", F.coalesce("sc", "sf", F.lit(0)).alias("s"))
        own = F.collect_set(F.when(F.col("sf") == 1, F.col("f"))).alias("keys")
        pages = each.groupBy("row", "after", "start").agg(F.array_sort(F.collect_list(line)).alias("lines"), own)
        return pages.join(self.lines.select("row", "codes", "ends"), "row").select("row", "after", "start", "codes", "ends", "lines", "keys")


def count(pages: DataFrame, rows: int, few: list[tuple]) -> tuple[body.Corpus, DataFrame]:
    """What all ``pages`` (row, site, title, text) show, as far as the lines of a few (site, title, text)
    need it, and ``Counts.repeated``."""
    spark = pages.sparkSession
    counts = Counts(pages if "ends" in pages.columns else pages.withColumn("ends", F.lit(None).cast("binary")), rows)
    keyed = [body.keyed(site, title, body.pack(text), counts.words) for site, title, text in few]
    mine_ = sorted({v for k in keyed for v in (*k.cross, *k.within) if v is not None})
    asked = spark.createDataFrame(pa.table({"key": pa.array(mine_, pa.int64())}))
    mine = lambda df, key: df.join(F.broadcast(asked.withColumnRenamed("key", key)), key, "left_semi").collect()
    state = {r.c: r.s for r in mine(counts.cross, "c")}
    site_state = {r.f: r.s for r in mine(counts.within, "f")}
    return body.Corpus(counts.words, state, site_state, {r.key for r in mine(counts.heads, "key")}, counts.starts, keyed), counts.repeated
