"""The whole postings table: every occurrence of every term stands in it once."""

from pyspark.sql import functions as F

from weftline.queries import QUERIES


def test_postings_hold_every_occurrence(spark, data):
    got = QUERIES["postings_positions"](spark, data)
    totals = got.agg(F.countDistinct("term"), F.count(F.lit(1)), F.sum(F.size("positions"))).first()
    stats = QUERIES["index_stats"](spark, data).select("terms", "postings", "positions").first()
    assert tuple(totals) == tuple(stats) and totals[0] > 4
