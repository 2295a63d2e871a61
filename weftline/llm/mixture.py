"""Mixing sources to target weights.

Sizes are tokens. The total is the largest at which every source present reaches its share within
its cap on repeats; shares of sources that are absent are spread over the others in proportion.
A source's quota is met by whole copies, then by blocks of one more copy in a permuted order, then
by single documents of one last block; a block is a fixed share of a source's permuted documents.

Shards are filled by a splitting tree: the number of blocks of every source is split among the
shards' halves by a multivariate hypergeometric draw, again and again, until each shard has its
exact quota of blocks by source; the shards then draw disjoint runs of each source's permuted blocks
and shuffle their documents locally. The tree sees counts of blocks only: about ``UNITS`` in all, whatever
the size of the data; more sources have fewer blocks each. There are as many shards as the tokens
taken fill at ``SHARD_TOKENS`` each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, default_parallelism, running_sum, small
from . import lexicon as lx
from .tokens import count_tokens

#: Blocks a source's documents are hashed into at most, blocks and copies of a mixture at about which
#: sources get fewer, and tokens of a shard.
BLOCKS, UNITS, SHARD_TOKENS = 1024, 1_000_000, 20_000_000


def split_tree(units: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): exact quotas of each source's units, by repeated halving."""
    out = np.zeros((shards, len(units)), "i8")

    def halve(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        left = int(round(counts.sum() * (mid - lo) / (hi - lo)))
        part = rng.multivariate_hypergeometric(counts, left, method="marginals") if counts.sum() else counts
        halve(part, lo, mid)
        halve(counts - part, mid, hi)

    halve(np.asarray(units, "i8"), 0, shards)
    return out


def plan_quotas(available: dict[str, int], targets: dict[str, tuple[float, int]], wanted: float | None = None) -> dict[str, float]:
    """Tokens to take of each source: the largest total at which all shares hold within the caps.

    With a total that is ``wanted``, that one: a source whose cap lies below its share of it gives all
    its cap allows, and what it lacks is left out.
    """
    present = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and available.get(s, 0) > 0}
    norm = sum(share for share, _ in present.values())
    most = {s: float(available[s] * cap) for s, (_, cap) in present.items()}
    total = min((most[s] / (share / norm) for s, (share, _) in present.items()), default=0.0) if wanted is None else float(wanted)
    return {s: min(total * share / norm, most[s]) for s, (share, _) in present.items()}


class Mixture:
    """The plan of one mixture: ``taken()`` gives its rows, ``shares()`` what it reached.

    documents: (doc_id, text, source); targets: (source, target_share, max_repeats). Documents of
    sources that are not in targets, of a null source, or without tokens are left out; a repeated
    source in targets counts with its greatest share; null shares and caps count as none. Equal
    documents and repeated rows are separate items.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 7,
        name: str = "byte_bpe_50k", folder: str = lx.TOKENIZERS, total_tokens: int | None = None,
    ):
        spark = documents.sparkSession
        self.seed = seed
        rows = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).where(
            F.col("source").isNotNull()
        ).select("source", "t.*").collect()  # a row for each source
        self.targets = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows}
        per = max(1, min(BLOCKS, UNITS // max(1, sum(max(cap, 0) for _, cap in self.targets.values()))))
        named = documents.join(small(targets.select("source").where(F.col("source").isNotNull()).distinct()), "source", "left_semi").select("doc_id", "source", "text")
        sized = count_tokens(named, "text", name, folder).where("n_tokens > 0")
        place = F.xxhash64(F.lit(seed), "source", "doc_id")
        self.sized = cut(sized.withColumn("_place", place).withColumn("_block", F.pmod(F.shiftright("_place", 20), F.lit(per)).cast("int")))
        totals = self.sized.groupBy("source", "_block").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("d")).collect()
        sizes: dict[str, dict[int, int]] = {}
        self.documents: dict[str, int] = {}
        for r in totals:  # at most ``per`` rows a source
            sizes.setdefault(r.source, {})[r._block] = r.n
            self.documents[r.source] = self.documents.get(r.source, 0) + r.d
        self.available = {s: sum(b.values()) for s, b in sizes.items()}
        self.quotas = plan_quotas(self.available, self.targets, total_tokens)
        taken = sum(self.quotas.values())
        self.shards = shards = shards or max(default_parallelism(spark), int(taken // SHARD_TOKENS) + 1)
        rng = np.random.default_rng(seed)
        whole: list[tuple[str, int, int]] = []  # source, block, copy
        self.last: list[tuple[str, int, int, int]] = []  # source, block, copy, tokens wanted of it
        for s in sorted(self.quotas):
            have, want = self.available[s], self.quotas[s]
            full = min(int(want // have), self.targets[s][1])
            order = rng.permutation(sorted(sizes[s]))
            whole += [(s, int(b), c) for c in range(1, full + 1) for b in order]
            rest = want - full * have
            if full < self.targets[s][1] and rest >= 1:
                left = []
                for b in map(int, order):  # blocks that don't fit what is left are passed over
                    if sizes[s][b] > rest:
                        left.append(b)
                    else:
                        whole.append((s, b, full + 1))
                        rest -= sizes[s][b]
                if left and rest >= 1:  # of one more block, the documents that fit
                    self.last.append((s, max(left, key=sizes[s].get), full + 1, int(rest)))
        units = whole + [(s, b, c) for s, b, c, _ in self.last]
        names = sorted(self.quotas)
        own = {s: [u for u in units if u[0] == s] for s in names}
        quota = split_tree(np.array([len(own[s]) for s in names], "i8"), shards, rng)
        placed = []
        for k, s in enumerate(names):
            order = rng.permutation(len(own[s]))
            ends = np.cumsum(quota[:, k])
            for at, u in enumerate(order):
                placed.append((*own[s][u], int(np.searchsorted(ends, at, "right"))))
        kinds = {"source": pa.string(), "_block": pa.int32(), "copy": pa.int32(), "shard": pa.int32(), "_want": pa.int64()}
        rows_of = lambda rows, *names: spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)}))
        self.placed = rows_of(placed, "source", "_block", "copy", "shard")
        self.cuts = rows_of(self.last, "source", "_block", "copy", "_want")

    def taken(self) -> DataFrame:
        """(shard, rank, doc_id, source, copy, n_tokens): the mixture, shuffled within each shard."""
        picked = self.sized.join(small(self.placed), ["source", "_block"])
        cuts = small(self.cuts)  # a row for each source at most
        ends = picked.join(cuts, ["source", "_block", "copy"])
        # Of the last block, documents in a permuted order while they fit; a block is spread over tasks.
        ends = running_sum(ends, "source", ["_place", "doc_id"], F.col("n_tokens"), "_sum")
        part = ends.where("_sum <= _want").drop("_sum", "_want")
        rows = picked.join(cuts, ["source", "_block", "copy"], "left_anti").unionByName(part)
        rank = F.xxhash64(F.lit(self.seed + 1), "shard", "doc_id", "copy")
        return rows.select("shard", rank.alias("rank"), "doc_id", "source", "copy", "n_tokens").repartition(self.shards, "shard").sortWithinPartitions("shard", "rank", "doc_id", "copy")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, tokens_available, tokens_taken, documents, most_copies).

        One row per source of the targets, of absent ones too.
        """
        spark = self.sized.sparkSession
        got = self.taken().groupBy("source").agg(
            F.sum("n_tokens").alias("tokens_taken"), F.count(F.lit(1)).alias("documents"), F.max("copy").alias("most_copies")
        )
        base = spark.createDataFrame(
            [(s, share, int(self.available.get(s, 0))) for s, (share, _) in sorted(self.targets.items())],
            "source string, target_share double, tokens_available bigint",
        )
        total = got.agg(F.sum("tokens_taken").alias("_all")).scalar()
        zero = lambda c: F.coalesce(c, F.lit(0))
        return base.join(got, "source", "left").select(
            "source", "target_share",
            F.round(zero("tokens_taken") / total, 6).alias("actual_share"),
            "tokens_available", zero("tokens_taken").alias("tokens_taken"), zero("documents").alias("documents"),
            zero("most_copies").cast("int").alias("most_copies"),
        )
