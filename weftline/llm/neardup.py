"""Near-duplicate records: exact similarity join of word-sequence sets by set-relation skipping.

A record is the set of its distinct runs of ``k`` words. All pairs of sets with a Jaccard
similarity of at least ``t`` are found, exactly up to 58-bit hashes of the sequences:

1. *Global order.* Batches of records send their distinct sequences, packed, to hash buckets, which
   count in how many batches and records each stands and send one byte for each back. Sequences are
   ordered from rare to common. One that stands in a third of all records is one entry per batch.
2. *Classes.* Equal sets are one class; only its first record goes on.
3. *Index with skipping.* Sets that need an overlap of ``o`` share ``l`` of their first
   ``n - o + l`` sequences, for any ``l`` up to ``o`` (``SHARED``). The lists of the index are sorted
   by set size; a set skips those entries that are too small for it, and those too large for what it
   holds from this sequence on. What pairs are found is counted, and only those that share enough
   are compared: one rare sequence in common is chance, and such pairs grow with the square of the data.
4. *Answers from answers.* Each set of a candidate pair gets a leader, the first set among its
   candidates, and is compared with it once, which leaves two short differences. The overlap of two
   sets of one leader is derived from their differences alone. Only pairs across leaders compare
   whole sets.

Nothing is capped: every pair that could reach ``t`` is compared. Groups need no pairs: sets that are
linked already are not compared with each other again (``linked``).
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, default_parallelism, small
from .repeats import components

#: Bytes of text in a batch, and packed sequences in a bucket, about.
BATCH_BYTES, BUCKET_ITEMS = 8 << 20, 1 << 20
#: Ratio between the set sizes that bound an index block.
BLOCK = 1.3
#: Sequences that a pair must share among the first ones, and pairs that are looked at at once.
SHARED, AT_ONCE = 8, 1 << 20

_words = re.compile(r"\w+").findall
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "u8")


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) > 500_000:
            self.clear()
        self[w] = h
        return h


_hashes = _Hashes()


def sequences(text: str | None, k: int, least_words: int) -> np.ndarray | None:
    """Sorted distinct 58-bit hashes of all runs of k words; None below ``least_words`` words."""
    if not text:
        return None
    words = _words(text.lower())
    if len(words) < max(least_words, k):
        return None
    h = np.fromiter(map(_hashes.__getitem__, words), "u8", len(words))
    m = len(h) - k + 1
    x = np.zeros(m, "u8")
    for i in range(k):
        x += h[i : i + m] * (_MIX[i % len(_MIX)] + np.uint64(2 * i))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.unique(x >> np.uint64(6))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _array(x) -> np.ndarray:
    return np.frombuffer(x, "u8") if x is not None else np.zeros(0, "u8")


def _dealt(sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct items, in how many sets each stands, order by bucket, bucket of each in that order)."""
    flat, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, "u8"), np.zeros(0, "i8"))
    to = (flat % np.uint64(buckets)).astype("i8")
    order = np.argsort(to, kind="stable")
    return flat, n, order, to[order]


def _pack(items: np.ndarray, buckets: int) -> bytes:
    """Sorted items of one bucket by their differences, byte by byte, without the bytes that are all 0."""
    d = np.diff(items // np.uint64(buckets), prepend=np.uint64(0))
    planes = d.astype("<u8").view("u1").reshape(-1, 8).T
    return planes[: (int(d.max()).bit_length() + 7) // 8].tobytes() if len(d) else b""


def _unpack(packed: bytes, n: int, bucket: int, buckets: int) -> np.ndarray:
    each = np.zeros((n, 8), "u1")
    planes = np.frombuffer(packed, "u1").reshape(-1, n)
    each[:, : len(planes)] = planes.T
    return np.cumsum(each.view("<u8").ravel(), dtype="u8") * np.uint64(buckets) + np.uint64(bucket)


def signatures(records: DataFrame, key: str, text: str, k: int, t: Fraction, least_words: int) -> DataFrame:
    """(id, cls, n, w): the sets that may have partners.

    n is the set's size, cls a hash of the whole set, w its sequences that stand in other sets too,
    as packed order values from rare to common. A set whose first sequences are all unique has no
    partner and no row.
    """
    spark = records.sparkSession
    own = records.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(default_parallelism(spark), size // BATCH_BYTES + 1)
    buckets = max(default_parallelism(spark), size // (6 * BUCKET_ITEMS) + 1)
    base = own.select(F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch"), "id", "text")

    def sets(table):
        for i, s in zip(table.column("id").to_pylist(), table.column("text").to_pylist()):
            x = sequences(s, k, least_words)
            if x is not None and len(x):
                yield i, x

    def distinct(grp, table):
        flat, n, order, to = _dealt([x for _, x in sets(table)], buckets)
        flat, n = flat[order], np.minimum(n[order], 255).astype("u1")
        names, start = np.unique(to, return_index=True)
        ends = [*start[1:], len(to)]
        return pa.table(
            {
                "bucket": pa.array(names, pa.int64()), "batch": pa.array([grp[0].as_py()] * len(names), pa.int64()),
                "items": pa.array([_pack(flat[a:b], buckets) for a, b in zip(start, ends)], pa.binary()),
                "counts": pa.array([n[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()),
            }
        )

    def count(grp, table):
        bucket = grp[0].as_py()
        counts = [np.frombuffer(x, "u1") for x in table.column("counts").to_pylist()]
        items = [_unpack(x, len(n), bucket, buckets) for x, n in zip(table.column("items").to_pylist(), counts)]
        every, at = np.unique(np.concatenate(items), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(every))
        rank = np.minimum(np.ceil(2 * np.log2(total)), 63).astype("u1")[at]  # 0: unique
        ends = np.cumsum([0, *map(len, counts)])
        return pa.table({
            "batch": table.column("batch"), "bucket": pa.array([bucket] * len(counts), pa.int64()),
            "ranks": pa.array([rank[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
        })

    def sign(grp, left, right):
        # The ranks come in the order in which the items went.
        own = list(sets(left))
        known, _, order, _ = _dealt([x for _, x in own], buckets)
        got = [x for _, x in sorted(zip(right.column("bucket").to_pylist(), right.column("ranks").to_pylist()))]
        rank = np.empty(len(known), "u8")
        rank[order] = np.frombuffer(b"".join(got), "u1")
        rows = []
        for i, x in own:
            r = rank[np.searchsorted(known, x)]
            hit = r > 0
            w = np.sort((r[hit] << np.uint64(58)) | x[hit])
            n = len(x)
            if n - len(w) < n - _ceil(t * n) + 1:
                rows.append((i, xxhash.xxh3_128_digest(x.tobytes()), n, w.tobytes()))
        i, c, n, w = map(list, zip(*rows)) if rows else ([], [], [], [])
        return pa.table({"id": pa.array(i, pa.int64()), "cls": pa.array(c, pa.binary()), "n": pa.array(n, pa.int32()), "w": pa.array(w, pa.binary())})

    shared = base.repartition("batch")
    packed = shared.groupBy("batch").applyInArrow(distinct, "bucket bigint, batch bigint, items binary, counts binary")
    ranks = packed.groupBy("bucket").applyInArrow(count, "batch bigint, bucket bigint, ranks binary")
    both = shared.groupBy("batch").cogroup(ranks.groupBy("batch"))
    return cut(both.applyInArrow(sign, "id bigint, cls binary, n int, w binary"))


def _ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


def postings(signed: DataFrame, t: Fraction, shared: int) -> DataFrame:
    """(id, tok, n, rest): the sets' first sequences, as many as partners must share ``shared`` of;
    rest is how many sequences the set has from this one on, itself included."""

    def prefix(batches):
        for b in batches:
            ids, toks, ns, rests = [], [], [], []
            for i, n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = _array(w)
                m = min(len(w) - _ceil(t * n) + shared, len(w))
                ids.append(np.full(m, i, "i8"))
                toks.append(w[:m].astype("i8"))
                ns.append(np.full(m, n, "i4"))
                rests.append(np.arange(len(w), len(w) - m, -1, dtype="i4"))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (ids, toks, ns, rests)], names=["id", "tok", "n", "rest"]
                )

    return signed.select("id", "n", "w").mapInArrow(prefix, "id bigint, tok bigint, n int, rest int")


def buckets(signed: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(probe, index): the entries of the sets' first sequences, by sequence and size block.

    index: (tok, block, b, nb, rb); probe: (tok, block, a, na, ra), one entry for each block that
    can hold partners from the probe's position on.
    """
    num, den = t.numerator, t.denominator
    step = float(np.log(BLOCK))
    posts = postings(signed, t, 1)
    block = lambda size: F.floor(F.log(size.cast("double")) / F.lit(step)).cast("int")
    index = posts.select("tok", block(F.col("n")).alias("block"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    # A partner of size m needs overlap >= t / (1 + t) (n + m), so m is at most rest (1 + t) / t - n.
    reach = F.least(F.col("n"), F.floor(F.col("rest") * F.lit(num + den) / F.lit(num)).cast("int") - F.col("n"))
    least = F.ceil(F.col("n") * F.lit(num) / F.lit(den)).cast("int")
    probe = (
        posts.select("tok", "id", "n", "rest", least.alias("lo"), reach.alias("hi"))
        .where("hi >= lo")
        .select("tok", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))).alias("block"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    )
    return probe, index


def _fits(t: Fraction):
    """Whether a probe and an index entry of one bucket can reach ``t``; the probe is the larger set."""
    num, den = t.numerator, t.denominator
    need = (F.col("na") + F.col("nb")) * F.lit(num) <= F.least("ra", "rb") * F.lit(num + den)
    smaller = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    near = F.col("nb") * F.lit(den) >= F.col("na") * F.lit(num)
    return smaller & near & need


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(signed: DataFrame, t: Fraction) -> DataFrame:
    """(a, b): pairs of sets that share enough of their first sequences, at positions from which ``t``
    is in reach; a < b."""
    num, den = t.numerator, t.denominator

    def match(batches):
        held = [np.zeros(0, k) for k in ("i8", "i8", "i8", "i8")]
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns]
            tok, n, rest, ids = (np.concatenate(x) for x in zip(held, new))
            if not len(tok):
                continue
            at = np.arange(len(held[0]), len(tok))
            run = np.cumsum(np.concatenate([[0], tok[1:] != tok[:-1]]))
            wide = int(n.max()) + 2
            place = run * wide + n  # in order: entries are sorted by sequence and size
            least = -(-n[at] * num // den)
            # A partner of size m needs overlap >= t / (1 + t) (n + m), all but SHARED - 1 of it from here on.
            most = np.minimum(n[at], (rest[at] + SHARED - 1) * (num + den) // num - n[at])
            lo = np.searchsorted(place, run[at] * wide + least)
            hi = np.minimum(np.searchsorted(place, run[at] * wide + np.maximum(most, least - 1), "right"), at)
            count = np.maximum(hi - lo, 0)
            ends = np.cumsum(count)
            done, total = 0, int(ends[-1]) if len(ends) else 0
            while done < total:  # pairs by number, so that a long list is looked at in parts
                k = np.arange(done, min(done + AT_ONCE, total))
                done += len(k)
                i = np.searchsorted(ends, k, "right")
                a, b = at[i], lo[i] + k - (ends[i] - count[i])
                need = -(-(n[a] + n[b]) * num // (num + den))
                shared = np.minimum(need, SHARED)
                fits = np.minimum(rest[a], rest[b]) + shared - 1 >= need
                a, b, shared = ids[a[fits]], ids[b[fits]], shared[fits]
                a, b = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((b, a))
                a, b, shared = a[order], b[order], shared[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, "i8")
                times = np.diff(np.append(first, len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(times.astype("i4")), pa.array(shared[first].astype("i4"))], names=["a", "b", "times", "shared"])
            keep = (tok == tok[-1]) & (n * den >= n[-1] * num)
            held = [x[keep] for x in (tok, n, rest, ids)]

    posts = postings(signed, t, SHARED).select("tok", "n", "rest", "id").repartition("tok").sortWithinPartitions("tok", "n", "id")
    found = posts.mapInArrow(match, "a bigint, b bigint, times int, shared int").groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("shared").alias("shared"))
    return found.where("a <> b and times >= shared").select("a", "b")


def linked(signed: DataFrame, t: Fraction) -> DataFrame:
    """(key, block): each set that has a link, with the least set of those it hangs together with.

    Exact, without all pairs of a group: each entry of a bucket is first compared with the bucket's
    smallest set alone, which joins variants of one page in as many comparisons as they have
    entries. Pairs of a bucket are then compared only across the parts this leaves.
    """
    probe, index = (cut(x) for x in buckets(signed, t))
    head = index.groupBy("tok", "block").agg(F.min(F.struct("nb", "b", "rb")).alias("h")).select("tok", "block", "h.*")
    star = verify(_ordered(probe.join(head, ["tok", "block"]).where(_fits(t))), signed, t).select("a", "b")
    star = cut(star)
    part = cut(components(star))
    of = lambda df, id_, name: df.join(small(part.select(F.col("key").alias(id_), F.col("block").alias("_p"))), id_, "left").withColumn(name, F.coalesce("_p", id_)).drop("_p")
    probe, index = of(probe, "a", "pa"), of(index, "b", "pb")
    both = probe.select("tok", "block", F.col("pa").alias("p")).unionByName(index.select("tok", "block", F.col("pb").alias("p")))
    mixed = cut(both.groupBy("tok", "block").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo <> hi").select("tok", "block"))
    probe, index = (cut(x.join(small(mixed), ["tok", "block"], "left_semi")) for x in (probe, index))
    across = probe.select("tok", "block", "pa").distinct().join(index.select("tok", "block", "pb").distinct(), ["tok", "block"]).where("pa <> pb")
    rest = probe.join(across, ["tok", "block", "pa"]).join(index, ["tok", "block", "pb"]).where(_fits(t))
    more = verify(_ordered(rest), signed, t).select("a", "b")
    return components(star.unionByName(more))


def _enough(o, n, m, t: Fraction):
    return o * t.denominator >= t.numerator * (n + m - o)


def verify(pairs: DataFrame, signed: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, overlap, na, nb): the candidate pairs that reach ``t``; a < b."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("b").alias("id"), F.col("a").alias("o")).unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("o")))
    lead = cut(ends.groupBy("id").agg(F.min("o").alias("leader")))
    own = cut(signed.join(small(lead), "id").select("id", "leader", "n", "w"))
    # Each set against its leader, once: what either has and the other has not.
    heads = own.join(small(lead.select(F.col("leader").alias("id")).distinct()), "id", "left_semi").select(
        F.col("id").alias("leader"), F.col("n").alias("ln"), F.col("w").alias("lw")
    )

    def differ(batches):
        for b in batches:
            rows = []
            for w, lw in zip(b.column("w").to_pylist(), b.column("lw").to_pylist()):
                x, y = _array(w), _array(lw)
                rows.append((np.setdiff1d(x, y, True).tobytes(), np.setdiff1d(y, x, True).tobytes(), len(y)))
            more, less, full = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("leader"), b.column("n"), pa.array(more, pa.binary()), pa.array(less, pa.binary()), pa.array(full, pa.int32())],
                names=["id", "leader", "n", "more", "less", "full"],
            )

    delta = cut(own.join(heads, "leader").select("id", "leader", "n", "w", "lw").mapInArrow(
        differ, "id bigint, leader bigint, n int, more binary, less binary, full int"
    ))
    side = lambda c: delta.select(F.col("id").alias(c), *[F.col(x).alias(x + "_" + c) for x in ("leader", "n", "more", "less", "full")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def derive(batches):
        for b in batches:
            col = lambda c: b.column(c).to_pylist()  # noqa: B023, E731
            over = [
                full - len(la) // 8 - len(lb) // 8 + _common(_array(la), _array(lb)) + _common(_array(ma), _array(mb))
                for full, ma, la, mb, lb in zip(col("full_a"), col("more_a"), col("less_a"), col("more_b"), col("less_b"))
            ]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("a", "b", "n_a", "n_b")], pa.array(over, pa.int32())], names=["a", "b", "na", "nb", "overlap"])

    kind = "a bigint, b bigint, na int, nb int, overlap int"
    same = both.where("leader_a = leader_b").mapInArrow(derive, kind)
    rest = cut(both.where("leader_a <> leader_b").select("a", "b"))
    whole = lambda c: own.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col("w").alias("w" + c))

    def compare(batches):
        for b in batches:
            over = [_common(_array(x), _array(y)) for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("a", "b", "na", "nb")], pa.array(over, pa.int32())], names=["a", "b", "na", "nb", "overlap"])

    cross = rest.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(compare, kind)
    return same.unionByName(cross).where(_enough(F.col("overlap"), F.col("na"), F.col("nb"), t))


class NearDuplicates:
    """All near-duplicates among records.

    ``members``: (id, rep) of all records that may have partners, with the first record of their
    set. Records with a null key or text, or fewer than ``least_words`` words, take no part; a key
    that is repeated with different texts is several records of one id, of which pairs with itself
    are dropped. Pairs are only found where they are asked for.
    """

    def __init__(self, records: DataFrame, key: str = "ord", text: str = "main_text", k: int = 4, threshold: float = 0.6, least_words: int = 25):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        self.threshold = Fraction(str(threshold))
        signed = signatures(records, key, text, k, self.threshold, least_words)
        self.members = cut(
            signed.select("id", "cls").join(signed.groupBy("cls").agg(F.min("id").alias("rep")), "cls").select("id", "rep").distinct()
        )
        others = small(cut(self.members.where("id <> rep").select("id")))
        self.first = signed.join(others, "id", "left_anti")
        self._links: DataFrame | None = None

    @property
    def links(self) -> DataFrame:
        """(a, b, overlap, na, nb): all pairs of class representatives."""
        if self._links is None:
            self._links = cut(verify(candidates(self.first, self.threshold), self.first, self.threshold))
        return self._links

    def pairs(self) -> DataFrame:
        """(a, b) with a < b: all pairs of records, those of equal sets too."""
        # Only classes that have a link or several members take part in the joins below.
        many = self.members.where("id <> rep").select("rep").distinct()
        linked_ = self.links.select(F.col("a").alias("rep")).unionByName(self.links.select(F.col("b").alias("rep"))).distinct()
        own = self.members.join(small(cut(many.unionByName(linked_).distinct())), "rep", "left_semi")
        x, y = own.select(F.col("rep").alias("ra"), F.col("id").alias("x")), own.select(F.col("rep").alias("rb"), F.col("id").alias("y"))
        across = self.links.select(F.col("a").alias("ra"), F.col("b").alias("rb")).join(x, "ra").join(y, "rb")
        within = own.join(cut(many), "rep", "left_semi")
        within = within.select("rep", F.col("id").alias("x")).join(within.select("rep", F.col("id").alias("y")), "rep").where("x < y")
        return (
            across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .unionByName(within.select(F.col("x").alias("a"), F.col("y").alias("b")))
            .where("a <> b")
        )

    def groups(self) -> DataFrame:
        """(id, rep, grp): each record with a partner, its class and its group; both are named by the
        least record among their classes' first ones. One row per record, whatever the groups' size."""
        comp = linked(self.first, self.threshold)
        kept = self.members.join(comp.select(F.col("key").alias("rep"), F.col("block").alias("grp")), "rep", "left")
        many = self.members.where("id <> rep").select("rep").distinct().withColumn("_many", F.lit(True))
        return kept.join(many, "rep", "left").where("grp is not null or _many").select("id", "rep", F.coalesce("grp", "rep").alias("grp"))
