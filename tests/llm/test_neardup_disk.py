"""What the near-duplicate join leaves on disk: chance pairs are not compared, shuffles don't pile up."""

import random
from fractions import Fraction

import numpy as np

from weftline.llm import neardup
from weftline.plans.shared import cut


def _records(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord bigint, main_text string")


def _brute(texts, t, least=25):
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, x in enumerate(texts) if len(w := x.split()) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_one_sequence_in_common_is_no_candidate(spark):
    # 40 sets of 100 sequences, of which all have the rarest in common, by chance.
    rows = [(i, 100, np.array([0, *range(100 * i + 1, 100 * i + 100)], "u8").tobytes()) for i in range(40)]
    signed = spark.createDataFrame(rows, "id bigint, n int, w binary")
    assert neardup.candidates(signed, Fraction(3, 5)).count() == 0


def test_pairs_equal_brute_force_at_any_size(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.choice([25, 26, 40, 120, 300]))]
        for _ in range(rng.randrange(1, 5)):
            own = list(base[: max(25, int(len(base) * rng.uniform(0.6, 1)))])
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(400)}"
            texts.append(" ".join(own))
    # Sets of one to five sequences.
    texts += [" ".join([a] * 30) for a in ("x", "x", "y")] + [" ".join(["p", "q"] * 20), " ".join(["q", "p"] * 20), " ".join(["p", "q", "r"] * 12), " ".join(["p", "q", "r"] * 12 + ["p"])]
    for t in (0.3, 0.6, 0.9):
        got = [(r.a, r.b) for r in neardup.NearDuplicates(_records(spark, texts), threshold=t).pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(texts, t)


def test_long_lists_are_matched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "AT_ONCE", 50)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(60)]
    texts = [" ".join([*base[:k], f"n{rng.randrange(10**6)}", *base[k:]]) for k in range(40)]
    got = {(r.a, r.b) for r in neardup.NearDuplicates(_records(spark, texts)).pairs().collect()}
    assert got == _brute(texts, 0.6)


def test_packed_items_come_back():
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 1 << 58, 5000, dtype="u8"))
    for bucket in range(3):
        own = x[x % np.uint64(3) == bucket]
        assert (neardup._unpack(neardup._pack(own, 3), len(own), bucket, 3) == own).all()
    assert list(neardup._unpack(neardup._pack(np.zeros(1, "u8"), 1), 1, 0, 1)) == [0]


def test_cut_leaves_no_shuffle_behind(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    out = cut(spark.range(10_000).selectExpr("id % 100 as k", "id").groupBy("k").sum("id"))
    assert not shuffles() - before
    assert out.count() == 100
