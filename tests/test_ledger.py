"""The work-item ledger: states, leases, fencing, failures, retries."""

import pytest

from weftline.operators import ledger as L

EV = "event_id bigint, url string, now_s double, content_hash string, extra int"
FR = "url string, run_id int, content_hash string, last_checked double, event_id string"
RU = "run_id int, job string, status string"


def run(spark, events, known, runs):
    got = L.next_run(spark.createDataFrame(events, EV), spark.createDataFrame(known, FR), spark.createDataFrame(runs, RU))
    return sorted((r.url, r.content_hash) for r in got.collect())


def test_new_changed_and_unchanged(spark):
    runs = [(1, "freshness", "ok"), (2, "freshness", "failed"), (3, "other", "ok")]
    events = [
        (1, "new", 5.0, "h", None), (1, "new", 5.0, "h", None), (2, "same", 9.0, "a", None), (3, "changed", 9.0, "b", None),
        (4, "old", 1.0, "z", None), (5, "back", 8.0, "x", None), (6, "back", 9.0, "a", None), (7, "nohash", 9.0, None, None),
        (8, "nullstate", 1.0, "q", None), (9, "failedrun", 9.0, "n", None), (10, None, 9.0, "n", None), (11, "tie", 9.0, "t1", None), (12, "tie", 9.0, "t2", None),
    ]
    known = [(u, 1, "a", 5.0, None) for u in ("same", "changed", "old", "back")] + [("nullstate", 1, None, 5.0, None), ("failedrun", 2, "n", 9.0, None), ("failedrun", 3, "n", 9.0, None), ("changed", 2, "b", 9.0, None), ("same", 1, "a", 5.0, None)]
    assert run(spark, events, known, runs) == [("changed", "b"), ("failedrun", "n"), ("new", "h"), ("nullstate", "q"), ("tie", "t2")]


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [(1, "u", 1.0, "h", 1)], [], []) == [("u", "h")]


def wanted(spark, *items):
    return spark.createDataFrame(list(items), "url string, content_hash string")


def states(ledger):
    return sorted((r.url, r.content_hash, r.state) for r in ledger.states().collect())


def test_lease_complete_and_expire(spark, tmp_path):
    led = L.WorkLedger(spark, "file://" + str(tmp_path / "ledger"))
    assert led.head() == 0 and led.states() is None and led.lease("w", 0.0, 10.0) is None
    assert led.sync(wanted(spark, ("a", "1"), ("b", "1"), (None, "1"), ("a", "1")), "w1")
    one = led.lease("w1", 100.0, 50.0)
    assert sorted(r.url for r in one.collect()) == ["a", "b"]
    # A second worker finds nothing while the lease holds.
    assert led.lease("w2", 120.0, 50.0).count() == 0
    # The first fails; its lease runs out, and the second gets the items under a higher token.
    two = led.lease("w2", 160.0, 50.0)
    tokens = {r.fence for r in two.collect()}
    assert sorted(r.url for r in two.collect()) == ["a", "b"] and tokens > {r.fence for r in one.collect()} or max(tokens) > max(r.fence for r in one.collect())
    # The first comes back late: its token is stale and nothing is done.
    assert led.complete(one.select("url", "content_hash", "fence"), "w1")
    assert {s for _, _, s in states(led)} == {"leased"}
    assert led.complete(two.where("url = 'a'").select("url", "content_hash", "fence"), "w2")
    assert states(led) == [("a", "1", "done"), ("b", "1", "leased")]
    # A new version of a done item is pending again, the same version is not.
    assert led.sync(wanted(spark, ("a", "2"), ("b", "1")), "w3")
    assert states(led) == [("a", "2", "pending"), ("b", "1", "leased")]


def test_one_of_two_writers_wins_and_a_retry_meets_its_own_work(spark, tmp_path):
    led = L.WorkLedger(spark, "file://" + str(tmp_path / "ledger"))
    first, second = wanted(spark, ("a", "1")), wanted(spark, ("z", "9"))
    from pyspark.sql import functions as F

    full = lambda d: d.select("url", "content_hash", F.lit("pending").alias("state"), F.lit(None).cast("bigint").alias("fence"), F.lit(None).cast("double").alias("lease_until"))
    assert led.commit(full(first), 1, "w1")
    assert not led.commit(full(second), 1, "w2")
    assert led.commit(full(first), 1, "w1")
    assert led.head() == 1 and states(led) == [("a", "1", "pending")]


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", ["data", "marker", "number"])
def test_a_step_that_dies_leaves_the_ledger_as_it_was(spark, tmp_path, monkeypatch, at):
    led = L.WorkLedger(spark, "file://" + str(tmp_path / "ledger"))
    assert led.sync(wanted(spark, ("a", "1"), ("b", "1")), "w1")

    def die(*a, **k):
        raise Killed

    with monkeypatch.context() as m:
        if at == "data":  # the changes are written, nothing else
            m.setattr(led, "_number", die)
        elif at == "marker":  # the marker is there, half written
            m.setattr(L.json, "dumps", die)
        else:  # the marker is whole but has no number
            m.setattr(L.os, "link", die)
        with pytest.raises(Killed):
            led.lease("w1", 0.0, 10.0)
    again = L.WorkLedger(spark, led.folder)
    assert again.head() == 1 and {s for _, _, s in states(again)} == {"pending"}
    assert again.lease("w2", 1.0, 10.0).count() == 2
    assert led.lease("w1", 2.0, 10.0).count() == 0, "no item is given twice"


def test_a_lease_that_dies_after_its_commit_is_given_again(spark, tmp_path):
    led = L.WorkLedger(spark, "file://" + str(tmp_path / "ledger"))
    led.sync(wanted(spark, ("a", "1")), "w1")
    first, head = led.lease("w1", 5.0, 10.0).collect(), led.head()
    assert led.lease("w1", 5.0, 10.0).collect() == first and led.head() == head


def test_an_error_is_not_taken_for_another_writer(spark, tmp_path, monkeypatch):
    led = L.WorkLedger(spark, "file://" + str(tmp_path / "ledger"))

    def full(*a):
        raise OSError(28, "No space left on device")

    monkeypatch.setattr(L.os, "link", full)
    with pytest.raises(OSError):
        led.sync(wanted(spark, ("a", "1")), "w1")


def test_changes_are_compacted_and_versions_take_leases_away(spark, tmp_path):
    led = L.WorkLedger(spark, "file://" + str(tmp_path / "ledger"))
    led.sync(wanted(spark, ("a", "0"), ("b", None)), "w")
    for k in range(1, L.COMPACT + 2):
        led.sync(wanted(spark, ("a", str(k)), ("b", None)), "w")
    assert states(led) == [("a", str(L.COMPACT + 1), "pending"), ("b", None, "pending")]
    assert len(led._marker(led.head())["tables"]) <= L.COMPACT
    held = led.lease("w", 0.0, 100.0)
    led.sync(wanted(spark, ("a", "new")), "w")
    assert led.complete(held, "w")
    assert states(led) == [("a", "new", "pending"), ("b", None, "done")]
    again = led.lease("w", 1.0, 100.0)
    assert led.release(again, "w") and states(led)[0] == ("a", "new", "pending")


@pytest.mark.parametrize("bad", [None, 0.0])
def test_null_last_checked_is_never_younger(spark, bad):
    got = run(spark, [(1, "u", 5.0, "n", None)], [("u", 1, "o", bad, None)], [(1, "freshness", "ok")])
    assert got == ([] if bad is None else [("u", "n")])
