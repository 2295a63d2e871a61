"""Content store with bodies, and replay of archived captures."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..plans.shared import local_path
from ..sources import warc
from . import archive


class ContentStore:
    """Bodies by their digest, once each, and the digest that each url had last, as tables.

    A batch of responses adds a folder of its own number; a batch that is put again writes the same
    folder again. Objects that an earlier batch has are not written again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, kind: str, but: int | None = None) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{kind}, batch int")
        got = self.spark.read.schema(f"{kind}, batch int").parquet(f"{self.folder}/{name}")
        return got if but is None else got.where(F.col("batch") != but)

    def objects(self, but: int | None = None) -> DataFrame:
        return self._table("objects", "digest string, size bigint, body binary", but)

    def put(self, responses: DataFrame, batch: int) -> DataFrame:
        """Stores a batch of responses (ord, url, status, body, truncated); (reason, n) of those refused.

        The first copy of a content is written, further ones only noted with their url.
        """
        r = responses.withColumn("reason", archive.refused(F.col("status"), F.coalesce("truncated", F.lit(False)))).withColumn("digest", F.sha2("body", 256))
        ok = r.where(F.col("reason").isNull() & F.col("body").isNotNull() & F.col("url").isNotNull())
        known = self.objects(but=batch).select("digest")
        # The bodies of equal content are equal, so any of them will do.
        new = ok.select("digest", "body").join(known, "digest", "left_anti").dropDuplicates(["digest"])
        new.select("digest", F.octet_length("body").cast("bigint").alias("size"), "body").write.mode("overwrite").parquet(f"{self.folder}/objects/batch={batch}")
        last = ok.groupBy("url").agg(F.max(F.struct("ord", "digest")).alias("r")).select("url", "r.ord", "r.digest")
        last.write.mode("overwrite").parquet(f"{self.folder}/records/batch={batch}")
        return r.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

    def records(self) -> DataFrame:
        """(url, digest): the digest each url had in its last batch."""
        every = self._table("records", "url string, ord bigint, digest string")
        return every.groupBy("url").agg(F.max(F.struct("batch", "ord", "digest")).alias("r")).select("url", "r.digest")

    def read(self, urls: DataFrame) -> DataFrame:
        """(url, digest, body) of urls (url) that are stored."""
        return self.records().join(urls.select("url").distinct(), "url", "left_semi").join(self.objects().select("digest", "body"), "digest").select("url", "digest", "body")

    def urls_for(self, digest: str) -> DataFrame:
        return self.records().where(F.col("digest") == digest).select("url").orderBy("url")


_ARCHIVED = "url string, filename string, offset bigint, status int, headers map<string,string>, body binary"


def captured(captures: DataFrame, folder: str) -> DataFrame:
    """(url, filename, offset, status, headers, body) of captures (filename, offset, length).

    Captures of one file are read by one task in the order of their offsets, each by itself.
    """
    base = local_path(folder)

    def run(batches):
        for b in batches:
            rows = []
            for name, offset, length in sorted(zip(*(c.to_pylist() for c in b.columns))):
                with open(os.path.join(base, name) if os.path.isdir(base) else base, "rb") as f:
                    f.seek(offset)
                    got = warc.record_at(f.read(length), name, offset, length)
                if got is not None:
                    rows.append({k: got[k] for k in ("url", "filename", "offset", "status", "headers", "body")})
            kinds = pa.schema([("url", pa.string()), ("filename", pa.string()), ("offset", pa.int64()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
            yield pa.RecordBatch.from_pylist([r | {"headers": list(r["headers"].items())} for r in rows], schema=kinds)

    own = captures.where(F.col("filename").isNotNull() & F.col("offset").isNotNull()).select("filename", F.col("offset").cast("bigint"), F.col("length").cast("bigint")).distinct()
    return own.repartition("filename").sortWithinPartitions("filename", "offset").mapInArrow(run, _ARCHIVED)


def replayed(index: DataFrame, folder: str, urls: DataFrame | None = None) -> DataFrame:
    """(url, status, links): the newest capture of each url, read from its record and parsed again.

    index: (key, timestamp, url, filename, offset, length); urls: (url), by default all. What is no
    HTML has null links; a url without a capture has no row.
    """
    own = index if urls is None else index.join(urls.select("url").distinct(), "url", "left_semi")
    last = own.groupBy("key").agg(F.max(F.struct("timestamp", "url", "filename", "offset", "length")).alias("c")).select("c.*")
    got = captured(last, folder)
    kind = F.col("headers")["content-type"]
    body = F.when(F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("html")), F.col("body"))
    x = got.withColumn("_b", body).withColumn("_k", kind).withColumn("x", html.extracted("_b", "url", "_k"))
    return x.select("url", "status", F.when(F.col("_b").isNotNull(), F.col("x.links")).alias("links"))
