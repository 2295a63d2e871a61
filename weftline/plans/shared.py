"""Session helpers: table access, the shared folder, and lineage cuts."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a temporary folder is made, and the
    session then keeps it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written reliably to the shared folder and read back, without its lineage.

    The files are deleted once nothing in the session refers to the result any more, so rounds of an
    iteration don't pile up; what was shuffled for it is deleted as soon as it is written.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        sc.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(eager=True)
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)
    return out


#: Folders and files of this session in the shared folder, until ``clean``.
_MADE: list[str] = []


def made(spark: SparkSession, kind: str) -> str:
    """A new folder of the shared folder, which ``clean`` deletes."""
    _MADE.append(f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Deletes the tables and files that this session wrote to the shared folder.

    For the end of a job: results that were not written by then can't be read any more.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _MADE:
        at = path(_MADE.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table of the shared folder, for what is read several times by columns."""
    at = made(df.sparkSession, "tables")
    df.write.option("compression", "snappy").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage between the passes of a long job: its heap shrinks, and Spark
    deletes the files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def staging(df: DataFrame, compression: str = "snappy"):
    """``stage`` for as long as the block runs; the table is deleted at its end."""
    at = made(df.sparkSession, "tables")
    df.write.option("compression", compression).parquet(at)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(at)
    finally:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(at)


def put_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Bytes as a file of the shared folder; its URI, for ``SparkContext.addFile``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{made(spark, 'files')}/{name}")
    out = path.getFileSystem(conf).create(path, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()
    return path.getFileSystem(conf).makeQualified(path).toString()


def default_parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is scanned by fewer tasks than there are.

    For costly work per row over files of few row groups; a table of many files is left as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.toJavaRDD().getNumPartitions() < n else df


def local_path(uri: str) -> str:
    return uri[len("file:") :].replace("//", "/", 1) if uri.startswith("file:") else os.fspath(uri)


def dealt_files(df: DataFrame, hands: int) -> list[list[str]] | None:
    """The paths of a staged table's files, dealt to tasks by their size; None where the shared folder is
    not one that tasks can open by themselves."""
    names = df.inputFiles()
    if not all(x.startswith("file:") for x in names):
        return None
    paths = [urllib.parse.unquote(local_path(x)) for x in names]
    out, held = [[] for _ in range(hands)], [0] * hands
    for size, path in sorted(((os.path.getsize(x), x) for x in paths), reverse=True):
        k = held.index(min(held))
        out[k].append(path)
        held[k] += size
    return out


#: Rows of a narrow table up to which it may be broadcast, after they have been counted.
BROADCAST_ROWS = 100_000


def few(df: DataFrame) -> bool:
    """Whether a table that is cut from its lineage has so few rows that every task may hold it."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffle.

    For tables that are already cut from their lineage, so that counting them is cheap.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_sum(df: DataFrame, key: str, order: list[str], value, out: str = "running") -> DataFrame:
    """``df`` with the running sum of ``value`` within each key, in the given order.

    Rows are range-partitioned by key and order, so a key that holds a third of all rows is summed
    up by many tasks; what joins them is one row per key and partition. The order must be total for
    the sums to be defined.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    placed = cut(df.withColumn("_value", value).repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(key, "_part").agg(F.sum("_value").alias("_sum"))
    base = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(key, "_part", "_base")
    rows = placed.withColumn("_inner", F.sum("_value").over(inner)).join(base, [key, "_part"])
    return rows.withColumn(out, F.col("_inner") + F.col("_base")).drop("_value", "_part", "_inner", "_base")
