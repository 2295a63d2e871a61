"""Work-item ledger: every run gets exactly the items that are new or changed.

An item is a key at a version (here a url at a content hash). Its state is ``pending``, ``leased``
or ``done``:

* ``reconcile`` derives the states from the observations and from what finished runs recorded;
  rows of runs that did not succeed are leases that ran out, so their items are pending again;
* ``claim`` moves pending items to leased under the fencing token of the claiming run;
* ``settle`` accepts results only under the token of the present lease, so that a writer which
  lost its lease is rejected;
* ``WorkLedger`` keeps the states in a shared folder as a full table and the changes since. A step
  writes its changes to a path that follows from its number and writer, then a marker under a name
  of its own, and last gives the marker its number, which can be given once: a step that dies at any
  point leaves the ledger as it was, a retried one meets its own finished work, and of two writers
  one wins.

Everything is one hash aggregation per input, with partial sums before the shuffle: a key that
holds a third of all rows arrives as one row per task.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import local_path, made

PENDING, LEASED, DONE = "pending", "leased", "done"


def reconcile(observed: DataFrame, recorded: DataFrame, runs: DataFrame, job: str) -> DataFrame:
    """States of all keys: (url, content_hash, state, observed_at).

    observed: (url, now_s, event_id, content_hash). The current version of a url is that of its
    observation with a hash of the greatest (now_s, event_id); equal pairs are settled by the
    greater hash. recorded: (url, run_id, content_hash, last_checked); the record with the greatest
    run_id among runs of ``job`` with status ``ok`` counts, rows of all other runs are leases that
    ran out. A url is pending if it has a current version and no record, or a record without a
    hash, or the version is younger than the record's check and differs from it; a null
    last_checked is not younger than anything. All other urls are done. Null urls have no state;
    repeated rows change nothing; columns beside those named are ignored; an empty ``runs`` makes
    every observed url pending.
    """
    ok = runs.where((F.col("job") == job) & (F.col("status") == "ok")).select("run_id").distinct()
    seen = observed.where(F.col("content_hash").isNotNull()).select(
        "url",
        F.struct("now_s", "event_id", "content_hash").alias("_seen"),
        F.lit(None).cast("struct<run_id:bigint,last_checked:double,content_hash:string>").alias("_known"),
    )
    known = recorded.join(ok, "run_id", "left_semi").select(
        "url",
        F.lit(None).cast("struct<now_s:double,event_id:bigint,content_hash:string>").alias("_seen"),
        F.struct(F.col("run_id").cast("bigint").alias("run_id"), "last_checked", "content_hash").alias("_known"),
    )
    both = (
        seen.unionByName(known)
        .where(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.max("_seen").alias("_seen"), F.max("_known").alias("_known"))
    )
    changed = (F.col("_seen.now_s") > F.col("_known.last_checked")) & (
        F.col("_seen.content_hash") != F.col("_known.content_hash")
    )
    due = F.col("_seen").isNotNull() & (
        F.col("_known").isNull() | F.col("_known.content_hash").isNull() | F.coalesce(changed, F.lit(False))
    )
    return both.select(
        "url",
        F.coalesce("_seen.content_hash", "_known.content_hash").alias("content_hash"),
        F.when(due, PENDING).otherwise(DONE).alias("state"),
        F.col("_seen.now_s").alias("observed_at"),
    )


def claim(states: DataFrame, token: Column | int, until: float | None = None, now: float | None = None) -> DataFrame:
    """States after one run has leased what was pending or whose lease ran out before ``now``."""
    free = F.col("state") == PENDING
    if now is not None and "lease_until" in states.columns:
        free = free | ((F.col("state") == LEASED) & (F.coalesce(F.col("lease_until"), F.lit(float("-inf"))) <= F.lit(now)))
    for name, kind in (("fence", "bigint"), ("lease_until", "double")):
        if name not in states.columns:
            states = states.withColumn(name, F.lit(None).cast(kind))
    token = token if isinstance(token, Column) else F.lit(int(token))
    return states.select(
        *[c for c in states.columns if c not in ("state", "fence", "lease_until")],
        F.when(free, LEASED).otherwise(F.col("state")).alias("state"),
        F.when(free, token).otherwise(F.col("fence")).cast("bigint").alias("fence"),
        F.when(free, F.lit(until)).otherwise(F.col("lease_until")).cast("double").alias("lease_until"),
    )


def settle(states: DataFrame, results: DataFrame) -> DataFrame:
    """States after results (url, content_hash, fence): done where the lease still has that token.

    Results under another token, of another version or of an item that is not leased are rejected;
    repeated results count once.
    """
    got = results.select(F.col("url").alias("_u"), F.col("content_hash").alias("_c"), F.col("fence").alias("_f"), F.lit(True).alias("_got")).distinct()
    same = (F.col("url") == F.col("_u")) & F.col("content_hash").eqNullSafe(F.col("_c")) & (F.col("fence") == F.col("_f"))
    done = F.when(F.col("_got") & (F.col("state") == LEASED), DONE).otherwise(F.col("state")).alias("state")
    return states.join(got, same, "left").select(*[done if c == "state" else F.col(c) for c in states.columns])


#: Tables of changes after which a step writes a full table again.
COMPACT = 8
_COLUMNS = ["url", "content_hash", "state", "fence", "lease_until"]


class WorkLedger:
    """The ledger in a shared folder; one committed change per step.

    ``writer`` names who takes a step. A step that is retried after its commit finds nothing left to
    change, and a lease, told by writer and time, gives its items again. Null urls are no items; of a url given with several versions the greatest holds.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    # -- commits

    def head(self) -> int:
        """Number of the last committed step, 0 where there is none."""
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return 0
        return max((int(n) for x in self._fs.listStatus(at) if (n := x.getPath().getName()).isdigit()), default=0)

    def _marker(self, n: int) -> dict:
        """What step n left: its writer and the tables that make up the states, the full one first."""
        if not n:
            return {"writer": None, "tables": []}
        stream = self._fs.open(self._path(f"{self.folder}/commits/{n}"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _number(self, n: int, content: dict) -> bool:
        """Gives a marker the number n; False if n is taken. The marker is whole before it has one."""
        mark = f"{self.folder}/commits/.{n}-{uuid.uuid4().hex}"
        out = self.spark.sparkContext._jvm.java.io.DataOutputStream(self._fs.create(self._path(mark), False))
        out.writeUTF(json.dumps(content))
        out.close()
        final = self._path(f"{self.folder}/commits/{n}")
        if self._fs.getScheme() == "file":  # a rename would replace; a link does not
            try:
                os.link(local_path(mark), local_path(f"{self.folder}/commits/{n}"))
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(self._path(mark), False)
        jvm = self.spark.sparkContext._jvm
        try:
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(mark), final, none)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(self._path(mark), False)
            return False

    def states(self, n: int | None = None) -> DataFrame | None:
        """(url, content_hash, state, fence, lease_until) after step n, by default the last one."""
        tables = self._marker(self.head() if n is None else n)["tables"]
        return self._read(tables) if tables else None

    def _read(self, tables: list[str]) -> DataFrame:
        kind = "url string, content_hash string, state string, fence bigint, lease_until double"
        each = [self.spark.read.schema(kind).parquet(t).withColumn("_at", F.lit(k)) for k, t in enumerate(tables)]
        if len(each) == 1:
            return each[0].select(*_COLUMNS)
        every = each[0]
        for more in each[1:]:
            every = every.unionByName(more)
        last = every.groupBy("url").agg(F.max(F.struct("_at", *_COLUMNS[1:])).alias("_s"))
        return last.select("url", *[F.col(f"_s.{c}").alias(c) for c in _COLUMNS[1:]])

    def commit(self, changes: DataFrame, n: int, writer: str) -> bool:
        """Step n by ``writer``: the rows that changed. False if another writer's step has that number.

        The data lies at a path made of number and writer: a writer that fails and tries again
        overwrites only its own unfinished files.
        """
        if 0 < n <= self.head():
            return self._marker(n)["writer"] == writer
        before = self._marker(n - 1)["tables"]
        data = f"{self.folder}/states/{n}/{writer}"
        changes.select(*_COLUMNS).write.mode("overwrite").parquet(data)
        tables = [*before, data]
        if len(tables) > COMPACT:
            full = f"{self.folder}/states/{n}/{writer}-full"
            self._read(tables).write.mode("overwrite").parquet(full)
            tables = [full]
        return self._number(n, {"writer": writer, "tables": tables}) or self._marker(n)["writer"] == writer

    # -- steps

    def sync(self, wanted: DataFrame, writer: str) -> bool:
        """Adds the items (url, content_hash) that the ledger has not at that version, as pending.

        An item whose version changes loses its lease: what its holder reports is rejected.
        """
        n, old = self.head(), self.states()
        new = wanted.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("content_hash").alias("content_hash"))
        if old is not None:
            have = old.select("url", F.col("content_hash").alias("_h"), F.lit(True).alias("_old"))
            new = new.join(have, "url", "left").where(F.col("_old").isNull() | ~F.col("_h").eqNullSafe(F.col("content_hash")))
        new = new.select(
            "url", "content_hash", F.lit(PENDING).alias("state"),
            F.lit(None).cast("bigint").alias("fence"), F.lit(None).cast("double").alias("lease_until"),
        )
        return self.commit(new, n + 1, writer)

    def lease(self, writer: str, now: float, seconds: float, pick=None) -> DataFrame | None:
        """Leases free items; the leased rows, or None if another writer was first.

        The step's number is the fencing token. Free is what is pending or whose lease ran out.
        ``pick`` chooses among the free rows, given them and all states; by default all are taken.
        """
        n, writer = self.head(), f"{writer}-{now!r}-{seconds!r}"
        if not n or self._marker(n)["writer"] != writer:  # else it died after its commit
            n, old = n + 1, self.states()
            if old is None:
                return None
            taken = claim(old, n, now + seconds, now).where((F.col("state") == LEASED) & (F.col("fence") == n))
            taken = pick(taken, old) if pick else taken
            if not self.commit(taken, n, writer):
                return None
        return self.leased(n)

    def leased(self, token: int) -> DataFrame:
        """The items that are leased under a token."""
        return self.states().where((F.col("state") == LEASED) & (F.col("fence") == token))

    def complete(self, results: DataFrame, writer: str) -> bool:
        """Results (url, content_hash, fence) make items done, under the token of the present lease."""
        return self._settled(results, DONE, writer)

    def release(self, results: DataFrame, writer: str) -> bool:
        """Items that failed, or whose holder gives them up, are pending again."""
        return self._settled(results, PENDING, writer)

    def _settled(self, results: DataFrame, state: str, writer: str) -> bool:
        n, old = self.head(), self.states()
        if old is None:
            return False
        now = settle(old.where(F.col("state") == LEASED), results).where(F.col("state") == DONE)
        return self.commit(now.withColumn("state", F.lit(state)), n + 1, writer)


def next_run(observed: DataFrame, recorded: DataFrame, runs: DataFrame, job: str = "freshness") -> DataFrame:
    """(url, content_hash) that the next run of ``job`` leases, one row per url.

    What ``reconcile`` finds pending goes into a ledger of the shared folder and is leased from it.
    """
    spark = observed.sparkSession
    book = WorkLedger(spark, made(spark, "ledger"))
    book.sync(reconcile(observed, recorded, runs, job).where(F.col("state") == PENDING), "sync")
    return book.lease("next", 0.0, 3600.0).select("url", "content_hash")


def replay(recorded: DataFrame, runs: DataFrame, job: str = "freshness") -> DataFrame:
    """(url, content_hash, state): the ledger after all runs of ``job``, replayed one by one.

    Each run syncs the versions it recorded, leases what is free, and reports what it recorded under
    its token; a run that did not succeed reports nothing and its lease runs out before the next
    one. A stale report, under the token of the run before, is made in every run and rejected. Rows
    without a url count for nothing; of a url recorded twice in one run the greatest version holds.
    Runs of a job are few, one by one in order of their ids; their rows are never collected.
    """
    spark = recorded.sparkSession
    book = WorkLedger(spark, made(spark, "ledger"))
    plan = runs.where(F.col("job") == job).groupBy("run_id").agg(F.max(F.coalesce(F.col("status") == "ok", F.lit(False))).alias("ok")).orderBy("run_id").collect()
    token = -1
    for k, run in enumerate(plan):
        own = recorded.where(F.col("run_id") == run.run_id).groupBy("url").agg(F.max("content_hash").alias("content_hash"))
        book.sync(own, f"{run.run_id}-sync")
        book.lease(f"{run.run_id}-lease", 10.0 * k, 5.0)
        stale, token = token, book.head()
        if run.ok:
            results = own.select("url", "content_hash", F.explode(F.array(F.lit(stale), F.lit(token))).alias("fence"))
            book.complete(results, f"{run.run_id}-done")
    last = book.states()
    if last is None:
        return spark.createDataFrame([], "url string, content_hash string, state string")
    return last.select("url", "content_hash", F.when(F.col("state") == DONE, DONE).otherwise(PENDING).alias("state"))
