"""Duplicate verdicts in discovery order: aliases, exact copies, near copies by fingerprint.

The verdicts are those of a sequential pass that keeps what it has seen. In batch:

1. a record whose canonical address is another one is an alias and takes no further part;
2. of equal content the first record holds; the others are copies of it, or seen already;
3. holders with enough words and shingles get a 64-bit fingerprint;
4. records of one fingerprint are one class. Pairs of classes within ``RADIUS`` bits are found by
   blocks: of m blocks of a fingerprint, six different bits leave at least m - 6 equal, so two
   classes within the radius share one of the combinations of m - 6 blocks. There are as many blocks
   as it takes for a combination to have the logarithm of the number of classes in bits, so a
   key is shared by chance about once per class, at any size;
5. a record is a near copy if an earlier kept one lies within the radius, else it is kept. This is
   decided class by class in rounds: a class whose earlier neighbours are all decided is decided. A
   later record of a class is never kept.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import cut

LEAST_WORDS, LEAST_SHINGLES, RADIUS = 25, 20, 6


def measured(records: DataFrame) -> DataFrame:
    """(ord, url, content_hash, n_words, n_shingles, fp): per record; null text counts as empty.

    fp is the fingerprint by MD5 of all shingles, repeats counted; null where there is none.
    """
    m = records.select("ord", "url", T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), T.measures("text").alias("m"))
    return m.select("ord", "url", "content_hash", "m.*")


def eligible(measures: DataFrame) -> DataFrame:
    return measures.where((F.col("n_words") >= LEAST_WORDS) & (F.col("n_shingles") >= LEAST_SHINGLES))


def fingerprints(records: DataFrame) -> DataFrame:
    """(ord, fp): fingerprints by MD5 of all shingles of ``text``; records without words have none."""
    return records.select("ord", T.measures("text").alias("m")).select("ord", "m.fp").where("fp is not null")


def classes(prints: DataFrame) -> DataFrame:
    """(ord, fp, rep): each record with the first record of its fingerprint."""
    return prints.join(prints.groupBy("fp").agg(F.min("ord").alias("rep")), "fp").select("ord", "fp", "rep")


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks, of which ``radius`` may differ, whose rest has log2(n) bits."""
    m = radius + 2
    while m < 64 and (m - radius) * (64 // m) < log2(max(n, 2)):
        m += 1
    return m


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance, band): first records a < b of different fingerprints within the radius, with
    the first byte they share (null if there is none, for a radius above 7).

    prints: (ord, fp); further records of a fingerprint are left to ``classes``.
    """
    heads = cut(prints.groupBy("fp").agg(F.min("ord").alias("ord")))
    m = blocks_for(heads.count(), radius)
    shift = lambda x, k: F.call_function("shiftrightunsigned", x, F.lit(k))
    edges = [round(i * 64 / m) for i in range(m + 1)]
    masks = []
    for c in combinations(range(m), m - radius):
        value = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in c)
        masks.append(value - (1 << 64) if value >> 63 else value)
    # A key is the bits of some blocks in place, and which blocks they are.
    keys = F.transform(F.array(*[F.lit(x).cast("bigint") for x in masks]), lambda x, i: F.struct(i.alias("k"), F.col("fp").bitwiseAND(x).alias("v")))
    side = heads.select("ord", "fp", F.explode(keys).alias("key")).select("ord", "fp", "key.k", "key.v")
    # The join's rows are those of one key; the first key two classes share reports them.
    a, b = side.select(F.col("ord").alias("oa"), F.col("fp").alias("fa"), "k", "v"), side.select(F.col("ord").alias("ob"), F.col("fp").alias("fb"), "k", "v")
    x = F.col("fa").bitwiseXOR(F.col("fb"))
    hit = a.join(b, ["k", "v"]).where("oa < ob").where(F.bit_count(x) <= radius).select(F.col("oa").alias("a"), F.col("ob").alias("b"), x.alias("x")).distinct()
    band: Column = F.lit(None)
    for i in reversed(range(8)):
        band = F.when(shift(F.col("x"), 8 * i).bitwiseAND(F.lit(255)) == 0, F.lit(i)).otherwise(band)
    return hit.select("a", "b", F.bit_count("x").alias("distance"), band.alias("band"))


def kept_first(pairs: DataFrame) -> DataFrame:
    """(ord, kept): for records with neighbours, whether a pass in order keeps each."""
    pairs = cut(pairs.select("a", "b"))
    ends = pairs.select(F.col("a").alias("ord")).unionByName(pairs.select(F.col("b").alias("ord"))).distinct()
    done = cut(ends.join(pairs.select(F.col("b").alias("ord")), "ord", "left_anti").withColumn("kept", F.lit(True)))
    while True:
        open_ = pairs.join(done.select(F.col("ord").alias("b")), "b", "left_anti")
        look = open_.join(done.select(F.col("ord").alias("a"), "kept"), "a", "left").groupBy("b").agg(
            F.max(F.coalesce("kept", F.lit(False))).alias("by"), F.min(F.when(F.col("kept").isNull(), 0).otherwise(1)).alias("all")
        )
        new = cut(look.where("by or all = 1").select(F.col("b").alias("ord"), (~F.col("by")).alias("kept")))
        if not new.limit(1).count():
            return done
        done = cut(done.unionByName(new))


def verdicts(records: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """(ord, url, verdict, duplicate_of, distance) of records (ord, url, text, canonical).

    ``prints`` (ord, fp) replaces the fingerprints by MD5, for instance by the exact ones. Records
    without an ord are left out; one ord is one record, the one with the least url.
    """
    own = records.where(F.col("ord").isNotNull()).select("ord", "url", "text", "canonical")
    alias = F.col("canonical").isNotNull() & (F.col("canonical") != F.col("url"))
    rest = own.where(~alias)
    m = cut(measured(rest))
    first = m.groupBy("content_hash").agg(F.min(F.struct("ord", "url")).alias("f")).select("content_hash", F.col("f.ord").alias("ford"), F.col("f.url").alias("furl"))
    seen = m.join(first, "content_hash")
    copies = seen.where("ord <> ford").select(
        "ord", "url", F.when(F.col("url").eqNullSafe(F.col("furl")), "already_seen").otherwise("exact_duplicate").alias("verdict"),
        F.col("furl").alias("duplicate_of"), F.lit(None).cast("int").alias("distance"),
    )
    holders = cut(seen.where("ord = ford").select("ord", "url", "n_words", "n_shingles", "fp"))
    able = eligible(holders).select("ord", "fp")
    fp = able if prints is None else prints.join(able.select("ord"), "ord", "left_semi")
    cls_ = cut(classes(fp))
    pairs = cut(near_pairs(cls_.select("ord", "fp")))
    state = kept_first(pairs)
    # The first records that a pass keeps: those without neighbours, and those kept among the others.
    free = cls_.where("ord = rep").select("ord").join(state.select("ord"), "ord", "left_anti").withColumn("kept", F.lit(True))
    kept = cut(state.unionByName(free).where("kept").select("ord"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance", "band"))
    same = cls_.where("ord = rep").select(F.col("ord").alias("a"), F.col("ord").alias("b"), F.lit(0).alias("distance"), F.lit(0).alias("band"))
    near_of = both.unionByName(same).join(kept.select(F.col("ord").alias("a")), "a").withColumnRenamed("b", "rep")
    # Of a record: the kept ones before it within the radius of its fingerprint.
    lost = cls_.join(kept, "ord", "left_anti").select("ord", "rep")
    of = lost.join(near_of, "rep").where("a < ord").groupBy("ord").agg(F.min(F.struct("band", "a", "distance")).alias("o"))
    urls = holders.select(F.col("ord").alias("_a"), F.col("url").alias("_of"))
    near = of.select("ord", F.col("o.a").alias("_a"), F.col("o.distance").alias("_d")).join(urls, "_a")
    held = holders.join(near, "ord", "left").select(
        "ord", "url", F.when(F.col("_a").isNull(), "new").otherwise("near_duplicate").alias("verdict"), F.col("_of").alias("duplicate_of"), F.col("_d").alias("distance")
    )
    aliases = own.where(alias).select("ord", "url", F.lit("canonical_alias").alias("verdict"), F.col("canonical").alias("duplicate_of"), F.lit(None).cast("int").alias("distance"))
    return held.unionByName(copies).unionByName(aliases)


def first_of_content(records: DataFrame) -> DataFrame:
    """(ord, first_ord): the earliest record with the same content.

    An aggregation and a join: content of a third of all records is split as a skewed join.
    """
    m = measured(records).select("ord", "content_hash")
    return m.join(m.groupBy("content_hash").agg(F.min("ord").alias("first_ord")), "content_hash").select("ord", "first_ord")
