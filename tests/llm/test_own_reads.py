"""Passes read a staged table's files by themselves, and templates are counted in each batch, without a row per line."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import body, residue, templates, weights
from weftline.plans import shared

PAGES = [
    ("a", 1, 7, [(1, 11, True, True, 3), (1, 11, True, True, 3), (2, 12, True, False, 20), (3, 13, False, True, 5)]),
    ("a", 0, 7, [(1, 11, True, True, 3), (2, 12, True, True, 20)]),
    ("a", 1, 8, [(1, 11, True, True, 3), (1, 11, True, True, 14)]),
    ("b", 1, 9, [(1, 21, True, True, 3)]),
    (None, 0, 5, [(1, 31, True, False, 3)]),
    ("c", 0, None, []),
]


def test_tasks_read_the_files_of_a_table_by_themselves(spark, monkeypatch):
    def add(total, b):
        seen = np.array(b.column(0).to_pylist(), "i8")
        np.add.at(total, seen % 50, seen)

    with shared.staging(spark.range(0, 1000, 1, 5)) as rows:
        files = shared.dealt_files(rows, 3)
        assert len(files) == 3 and sum(map(len, files)) == 5 and all(files)
        plans, real = [], type(rows).toArrow
        monkeypatch.setattr(type(rows), "toArrow", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
        want = residue.sums(rows, 50, add)
        got = residue.sums(rows, 50, add, files=spark.sparkContext.broadcast(files))
    assert want.sum() == 499_500 and (got == want).all()
    assert "parquet" in plans[0] and "parquet" not in plans[1]

    class Elsewhere:
        def inputFiles(self):
            return ["hdfs://host/x.parquet"]

    assert shared.dealt_files(Elsewhere(), 3) is None


def test_the_fit_is_the_same_through_the_jvm(spark, data, monkeypatch):
    from weftline.llm import pages

    monkeypatch.setattr(body, "STEPS", (3, 2))
    records = spark.read.parquet(data + "/extracted.parquet").select("ord", "url", "title", "text").limit(120)
    asked, real = [], weights.sums
    monkeypatch.setattr(weights, "sums", lambda *a: asked.append(len(a)) or real(*a))
    own = pages.Judge(records).body
    monkeypatch.setattr(weights, "dealt_files", lambda df, hands: None)
    other = pages.Judge(records).body
    assert asked == [5] * 3 + [4] * 3 and own.furniture.any()
    assert np.allclose(own.furniture, other.furniture, atol=1e-4) and np.allclose(own.heading, other.heading, atol=1e-4)


def test_templates_are_counted_once_a_page(spark):
    lines = spark.createDataFrame(PAGES, "site string, hosted int, longest bigint, lines array<struct<c:bigint,f:bigint,ok:boolean,own:boolean,n:int>>").repartition(2)
    cross = templates._once(lines, "c", "ok").groupBy("key", "wide").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), (F.min("lo") != F.max("hi")).alias("sites"))
    assert {tuple(r) for r in cross.collect()} == {(1, False, 5, 3, True), (1, True, 1, 1, False), (2, True, 2, 1, False)}
    within = templates._once(lines.where("site is not null"), "f", "own", True).groupBy("key", "wide", "longest").agg(F.max("h").alias("h"), F.sum("n").alias("n"))
    assert {tuple(r) for r in within.collect()} == {(11, False, 7, 1, 2), (11, False, 8, 1, 1), (11, True, 8, 1, 1), (12, True, 7, 0, 1), (13, False, 7, 1, 1), (21, False, 9, 1, 1)}


def test_states_need_no_row_for_each_line(spark):
    lines = spark.createDataFrame(PAGES, "site string, hosted int, longest bigint, lines array<struct<c:bigint,f:bigint,ok:boolean,own:boolean,n:int>>")
    for df in templates._states(lines, 6):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "SortAggregate" not in plan
