"""The weights of the line classifiers and the languages rest on all records, however large a sample may be."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import body, pages, spam, templates, weights


def _records(spark, data):
    return spark.read.parquet(data + "/extracted.parquet").select("ord", "url", "title", "text", "main_text")


def test_weights_are_those_of_all_lines_at_once(spark, data, monkeypatch):
    monkeypatch.setattr(body, "SAMPLE", 20)
    records = _records(spark, data)
    judge = pages.Judge(records.repartition(5))
    kept = judge.staged.where("text <> ''").select("row", "site", "title", "text").collect()
    packed = spark.createDataFrame([(r.row, r.site, r.title, body.pack(r.text)) for r in kept], "row bigint, site string, title string, t string")
    few = [(r.site, r.title, r.text) for r in kept]
    corpus, _ = templates.count(packed, len(few), few)
    all_ = body.fit(few, corpus)
    assert all_.furniture.any() and all_.heading.any() and judge.body.words == all_.words
    assert np.allclose(judge.body.furniture, all_.furniture, atol=1e-4) and np.allclose(judge.body.heading, all_.heading, atol=1e-4)


def test_pages_found_do_not_hang_on_the_sample(spark, data, monkeypatch):
    found = []
    for n in (20, 3000):
        monkeypatch.setattr(body, "SAMPLE", n)
        found.append({r.ord for r in spam.found(pages.Judge(_records(spark, data), "main_text")).collect()})
    assert found[0] == found[1] and found[0]


def test_languages_are_those_of_all_texts_at_once(spark, data):
    texts = [r.main_text for r in _records(spark, data.replace("sf0.001", "sf0.01")).collect() if r.main_text]
    known = dict.fromkeys({w for t in texts for w in t.lower().split() if len(w) < 5}, 2)
    content = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "t string").repartition(3)
    one, all_ = spam.Languages.fit(content, known), spam.Languages([t.split("\n") for t in texts], known)
    assert len(all_.function) > 1 and one.function == all_.function and one.place == all_.place
    assert np.allclose(one.weight, all_.weight, atol=1e-3) and np.allclose(one.holding, all_.holding, atol=1e-3)
    assert not spam.Languages.fit(content.where(F.lit(False)), known).function


def test_the_drivers_garbage_is_collected_between_the_steps(spark, data, monkeypatch):
    swept = []
    monkeypatch.setattr(weights, "sweep", lambda s: swept.append(s))
    pages.Judge(_records(spark, data).limit(50))
    assert len(swept) == max(body.STEPS) // weights.SWEEP
