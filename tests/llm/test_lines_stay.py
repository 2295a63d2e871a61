"""The states of lines are looked up where their pages are, and different pairs of words are listed once."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import body, pages, templates, weights
from weftline.plans import shared


def _shown(counts):
    rows = counts.judged.collect()
    assert all(x.i == i for r in rows for i, x in enumerate(r.lines))
    return {r.row: (r.after, r.start, bytes(r.codes), bytes(r.ends), [(x.key, x.n, x.long, x.s) for x in r.lines], set(r["keys"])) for r in rows}


def test_lines_are_judged_without_a_shuffle_as_by_joins(spark, data, monkeypatch):
    monkeypatch.setattr(body, "STEPS", (3, 2))
    records = spark.read.parquet(data + "/extracted.parquet").select("ord", "url", "title", "text", "main_text")
    judge = pages.Judge(records.repartition(3))
    own = judge.staged.where("packed <> ''").select("row", "site", "title", F.col("packed").alias("t"), "ends")
    many = own.count()
    counts = templates.Counts(own, many)
    looked = _shown(counts)
    held = weights.fit(counts)
    plans = []
    real = templates.cut
    monkeypatch.setattr(templates, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    templates.Counts(own, many)
    assert not any(re.search("Generate|Join", p) for p in plans if "keys" in p.split("\n")[0])
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    joined = templates.Counts(own, many)
    assert _shown(joined) == looked and any(v[5] for v in looked.values()) and {s for v in looked.values() for *_, s in v[4]} >= {0, 1}
    other = weights.fit(joined)
    assert held.heading.any() and np.allclose(held.furniture, other.furniture, atol=1e-4) and np.allclose(held.heading, other.heading, atol=1e-4)


@pytest.mark.parametrize("code", ["u2", "i4"])
def test_pairs_of_words_are_listed_once(monkeypatch, code):
    monkeypatch.setattr(weights, "AT_ONCE", 300)
    rng = np.random.default_rng(6)
    n = rng.integers(1, 30, 200)
    flat = rng.integers(0, 9, n.sum()).astype(code)
    more = [n.astype("i4").tobytes(), bytes(200), *(rng.random(200).astype("f4").tobytes() for _ in range(2))]
    rows = weights._paired(pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *(pa.array([x], pa.binary()) for x in (flat.tobytes(), *more))], names=weights._NAMES), code)
    got, slots = [], []
    for word, pair, place in zip(*(rows.column(k).to_pylist() for k in ("word", "pair", "place"))):
        word, pair, place = np.frombuffer(word, code), np.frombuffer(pair, "u4"), np.frombuffer(place, "u2")
        assert len(word) <= 90 < len(place)
        got.append(word[place])
        slots.append(pair[place])
    want = body._mix(flat.astype("i8"), np.append(flat[1:], 0).astype("i8"), 2)
    want[np.cumsum(n) - 1] = body._SLOTS
    assert rows.num_rows > 1 and (np.concatenate(got) == flat).all() and (np.concatenate(slots) == want).all()
    assert b"".join(rows.column("sizes").to_pylist()) == more[0]
