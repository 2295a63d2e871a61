"""A frontier that several workers share and that survives them: urls under leases, host by host.

The urls are items of a ``WorkLedger``; their order and their hosts' clocks are two small tables
beside it. A worker acquires at most one url of each host that is ready, works on it, and releases
it as done or to be queued again. A worker that dies holds its urls until their leases run out; then
they are free again, and what it reports later is rejected by its token. The crawl is over when
nothing is pending and nothing is leased.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from . import ledger


class SharedFrontier:
    """Urls to fetch in a shared folder.

    A url is pushed once, with the priority and order of its first push; null urls are no items. The
    version of an item is its state in the crawl, so a url that is done is never queued again.
    """

    def __init__(self, spark: SparkSession, folder: str, delay_s: float = 0.0):
        self.spark, self.delay = spark, delay_s
        self.book = ledger.WorkLedger(spark, f"{folder.rstrip('/')}/ledger")
        self.order = f"{folder.rstrip('/')}/order"

    def _queued(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("url string, host string, priority double, ord bigint, step bigint").parquet(self.order)
        except Exception as e:  # noqa: BLE001 - before the first push
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def push(self, requests: DataFrame, writer: str) -> bool:
        """Queues the urls (url, priority, ord) that were never pushed; False if another writer was first.

        The order is written under the step's number before the step is committed, so a push that is
        tried again writes the same rows in the same place.
        """
        first = requests.where(F.col("url").isNotNull()).groupBy("url").agg(F.min(F.struct("priority", "ord")).alias("q"))
        old = self.book.states()
        if old is not None:
            first = first.join(old.select("url"), "url", "left_anti")
        n = self.book.head() + 1
        rows = first.select("url", U.authority(F.col("url")).alias("host"), F.col("q.priority").cast("double").alias("priority"), F.col("q.ord").cast("bigint").alias("ord"))
        rows.write.mode("overwrite").parquet(f"{self.order}/step={n}")
        own = self.spark.read.parquet(f"{self.order}/step={n}")
        return self.book.sync(own.select("url", F.lit("queued").alias("content_hash")), writer)

    def acquire(self, writer: str, now: float, seconds: float = 60.0) -> DataFrame | None:
        """(url, host, fence): the first url of each host that is ready, leased; None if another
        writer was first or nothing was ever pushed. A host is ready if none of its urls is leased
        and its last lease began ``delay_s`` ago."""
        queued = self._queued()
        if queued is None:
            return None
        queued = queued.groupBy("url").agg(F.min(F.struct("priority", "ord", "host")).alias("q")).select("url", "q.*")

        def pick(free: DataFrame, states: DataFrame) -> DataFrame:
            live = (F.col("state") == ledger.LEASED) & (F.col("lease_until") > now)
            # A lease's start is its end less its length; done urls keep their last lease.
            recent = F.col("lease_until") - F.lit(seconds) + F.lit(self.delay) > now
            busy = states.where(live | recent).join(queued.select("url", "host"), "url").select("host").distinct()
            ready = free.join(queued, "url").join(busy, "host", "left_anti")
            first = ready.groupBy("host").agg(F.min(F.struct("priority", "ord", "url")).alias("f")).select("f.url")
            return free.join(first, "url", "left_semi")

        got = self.book.lease(writer, now, seconds, pick)
        return None if got is None else got.join(queued.select("url", "host"), "url").select("url", "host", "fence")

    def release(self, urls: DataFrame, writer: str, done: bool = True) -> bool:
        """Urls (url, fence) are done, or pending again; under a stale token nothing changes."""
        rows = urls.select("url", F.lit("queued").alias("content_hash"), "fence")
        return self.book.complete(rows, writer) if done else self.book.release(rows, writer)

    def finished(self, now: float) -> bool:
        """Whether nothing is pending and no lease is alive or has run out with its url undone."""
        states = self.book.states()
        return states is None or not states.where(F.col("state") != ledger.DONE).limit(1).count()
