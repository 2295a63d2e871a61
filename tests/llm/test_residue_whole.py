"""Residue models count all records, whatever the size of the sample that the line classifier has."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import body, pages, residue

NEW = ["Diese Ansicht konnte nicht geladen werden. Kennung {n}", "Please switch on scripts in {w} to read on", "Sorry, {w} took a nap. Come back in {n} minutes", "Brak dostępu do zasobu {w}"]


def _records(spark):
    rng = random.Random(3)
    nouns = [f"noun{a}{b}" for a in "abcdef" for b in "ghijkl"]
    sentence = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} sees a {rng.choice(nouns)} and after that it was with the {rng.choice(nouns)} for {rng.randint(2, 99)} days."
    rows = [(rng.choice(NEW).format(n=rng.randint(1, 999), w=rng.choice(nouns)), rng.random() < 0.5) for _ in range(120)]
    rows += [(sentence(), rng.random() < 0.05) for _ in range(300)] + [("\n".join(sentence() for _ in range(12)), False) for _ in range(150)]
    made = [(i, f"http://s{i % 9}.example/{i}", None, t, t, h) for i, (t, h) in enumerate(rows)]
    return spark.createDataFrame(made, "ord bigint, url string, title string, text string, main_text string, hint boolean").repartition(5)


def test_notices_are_found_beside_sound_pages(spark):
    records = _records(spark).withColumn("empty_app_root", F.lit(False))
    got = {r.ord for r in residue.found(pages.Judge(records, "main_text", hint=F.col("hint"))).collect()}
    assert len(got & set(range(120))) >= 114 and not any(i >= 120 for i in got)


def test_the_model_does_not_hang_on_the_sample(spark, monkeypatch):
    records = _records(spark).withColumn("empty_app_root", F.lit(False)).cache()
    made = []
    begin = residue.ResidueModel.__init__
    monkeypatch.setattr(residue.ResidueModel, "__init__", lambda self, tables: (made.append(tables), begin(self, tables))[1])
    for n in (20, 3000):
        monkeypatch.setattr(body, "SAMPLE", n)
        residue.found(pages.Judge(records, "main_text", hint=F.col("hint")))
    one, all_ = (made[len(made) // 2 - 1], made[-1])
    assert all(np.allclose(x, y, atol=1e-5) for kind, other in zip(one, all_) for x, y in zip(kind, other))


def test_pages_are_parted_as_by_all_words_at_once(spark):
    rows = [(r.ord, r.text, r.hint) for r in _records(spark).collect()]
    content = spark.createDataFrame([(t, len(t) <= 1000, h) for _, t, h in rows], "own string, short boolean, hint boolean").repartition(4)
    short = [(h, t.split("\n")) for _, t, h in rows if len(t) <= 1000]
    parting = residue.Parting.fit(content)
    p = parting.notices(np.array([h for h, _ in short]), [residue.Parting.slots(x) for _, x in short])
    assert sorted(x for (_, lines), v in zip(short, p) if v > residue.LEARNED for x in lines) == sorted(residue.notices_of(short))
    assert residue.Parting.fit(content.where("not hint")) is None and residue.Parting.fit(content.where("false")) is None


def test_sums_over_tasks(spark):
    def add(total, b):
        np.add.at(total, b.column(0).to_numpy() * 100, 1)

    got = residue.sums(spark.range(0, 90, 1, 7), 10_001, add)
    assert got.sum() == 90 and (got[:9000:100] == 1).all() and not residue.sums(spark.range(0), 5, add).any()
