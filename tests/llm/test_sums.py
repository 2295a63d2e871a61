"""Vectors that tasks add up: only what is not 0 is sent where that is shorter."""

import numpy as np
import pytest

from weftline.llm import residue

SIZE = 3 * residue._CHUNK + 17


def _vector(rng):
    v = np.zeros(SIZE)
    v[: residue._CHUNK] = rng.normal(size=residue._CHUNK)  # full, then empty, then two numbers, then a short end
    v[[2 * residue._CHUNK, 3 * residue._CHUNK - 1]] = 2.5, -1
    v[-1] = 7
    return v


@pytest.mark.parametrize("kind", ["f4", "f8"])
def test_parts_with_few_numbers_are_sent_without_their_zeros(kind):
    v = _vector(np.random.default_rng(1))
    sent, out = residue._sent(v, kind), np.zeros(SIZE)
    assert sent.column("k").to_pylist() == [0, 2 * residue._CHUNK, 3 * residue._CHUNK]
    assert [len(x) // np.dtype(kind).itemsize for x in sent.column("v").to_pylist()] == [residue._CHUNK, 2, 1]
    for part in zip(*(c.to_pylist() for c in sent.columns)):
        residue._put(out, *part, kind)
    assert (out == v.astype(kind)).all()


@pytest.mark.parametrize("direct", [0, 1 << 30])
def test_sums_are_the_same_either_way(spark, monkeypatch, direct):
    monkeypatch.setattr(residue, "_DIRECT", direct)

    def add(total, b):
        for n in b.column(0).to_pylist():
            total[n % SIZE] += n
            total[: residue._CHUNK] += 1

    want = np.zeros(SIZE)
    np.add.at(want, np.arange(0, 40_000, 400) % SIZE, np.arange(0, 40_000, 400))
    want[: residue._CHUNK] += 100
    assert (residue.sums(spark.range(0, 40_000, 400, 5), SIZE, add) == want).all()
    assert not residue.sums(spark.range(0), SIZE, add).any()
