"""Text and JSON sources and sinks: capture index lines, document lines, export lines, bundles."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..plans.shared import local_path

CDX = "url string, mime string, status int, digest string, offset bigint, length bigint, filename string"


def read_cdxj(spark: SparkSession, path: str) -> DataFrame:
    """Capture index from lines ``key timestamp {json}``; other lines are left out."""
    v = F.split(F.col("value"), " ", 3)
    rows = spark.read.text(path).where(F.size(v) == 3).select(v[0].alias("key"), v[1].alias("timestamp"), F.from_json(v[2], CDX).alias("r"))
    return rows.select("key", "timestamp", "r.*")


def write_cdxj(index: DataFrame, path: str) -> None:
    """Capture index as lines sorted by key and time across files, without repeats."""
    names = sorted(c for c in index.columns if c not in ("key", "timestamp"))
    lines = index.distinct().repartitionByRange("key", "timestamp").sortWithinPartitions("key", "timestamp")
    lines.select(F.concat_ws(" ", "key", "timestamp", F.to_json(F.struct(*names))).alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(url, title, text) of export lines; those without text are left out, final_url goes first."""
    rows = spark.read.schema(f"url string, final_url string, title string, `{text}` string").json(path)
    return rows.where(F.length(text) > 0).select(F.coalesce(F.nullif("final_url", F.lit("")), "url", F.lit("")).alias("url"), "title", F.col(text).alias("text"))


def write_export(records: DataFrame, path: str) -> None:
    """Export records as JSON lines with null keys kept."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


_REPORT = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Crawl</title>
<style>body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:left;border-bottom:1px solid #ddd}</style>
<h1>Crawl</h1><dl id="sum"></dl><table id="pages"></table>
<script type="application/json" id="data">__DATA__</script>
<script>
const d = JSON.parse(document.getElementById("data").textContent), cell = (tag, v) => { const e = document.createElement(tag); e.textContent = v ?? ""; return e };
for (const [k, v] of Object.entries(d.summary)) document.getElementById("sum").append(cell("dt", k), cell("dd", typeof v === "object" ? JSON.stringify(v) : v));
const names = d.pages.length ? Object.keys(d.pages[0]) : [], table = document.getElementById("pages"), row = (tag, vs) => { const r = document.createElement("tr"); vs.forEach(v => r.append(cell(tag, v))); table.append(r) };
row("th", names); d.pages.forEach(p => row("td", names.map(n => p[n])));
</script></html>
"""


def write_report(summary: DataFrame, pages: DataFrame, path: str, most: int = 10_000) -> None:
    """One self-contained HTML file with the one-row summary and the first ``most`` pages by url.

    For a person to read, so it is cut; the export holds all pages.
    """
    keep = lambda df: df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    rows = [r.j for r in keep(pages.orderBy("url").limit(most)).collect()]
    one = [r.j for r in keep(summary.limit(1)).collect()] or ["{}"]
    data = f'{{"summary": {one[0]}, "pages": [{", ".join(rows)}]}}'
    with open(path, "w", encoding="utf-8") as f:
        f.write(_REPORT.replace("__DATA__", data.replace("</", "<\\/")))


class CdxjSource(DataSource):
    """``spark.read.format("cdxj")`` and ``df.write.format("cdxj")``: lines ``key timestamp {json}``.

    Reading makes one partition per file; lines of another form are left out. Writing makes one file
    per task in the order of its rows; ``write_cdxj`` also sorts them across files.
    """

    @classmethod
    def name(cls):
        return "cdxj"

    def schema(self):
        return "key string, timestamp string, " + CDX

    def reader(self, schema):
        return _CdxjReader(self.options)

    def writer(self, schema, overwrite):
        return _CdxjWriter(self.options, overwrite)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _CdxjReader(DataSourceReader):
    def __init__(self, options):
        self.path = local_path(options["path"])

    def partitions(self):
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if not n.startswith((".", "_"))]
        return [_File(self.path)]

    def read(self, part):
        kinds = [c.strip().split() for c in CDX.split(",")]
        cast = {"string": str, "int": int, "bigint": int}
        with open(part.path, encoding="utf-8") as f:
            for line in f:
                words = line.rstrip("\n").split(" ", 2)
                try:
                    got = json.loads(words[2]) if len(words) == 3 else None
                    if isinstance(got, dict):
                        yield (words[0], words[1], *(None if got.get(n) is None else cast[k](got[n]) for n, k in kinds))
                except ValueError:
                    continue


class _Lines(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _CdxjWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = local_path(options["path"]), overwrite

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        t = TaskContext.get()
        name = f"part-{t.partitionId():05d}-{t.taskAttemptId()}.cdxj"
        with open(os.path.join(self.path, "." + name), "w", encoding="utf-8") as f:
            for r in rows:
                own = {k: v for k, v in sorted(r.asDict().items()) if k not in ("key", "timestamp") and v is not None}
                f.write(f"{r['key']} {r['timestamp']} {json.dumps(own, ensure_ascii=False)}\n")
        return _Lines(name)

    def commit(self, messages):
        if self.overwrite:
            for n in os.listdir(self.path):
                if not n.startswith("."):
                    os.remove(os.path.join(self.path, n))
        for m in messages:
            if m:
                os.replace(os.path.join(self.path, "." + m.name), os.path.join(self.path, m.name))

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(os.path.join(self.path, "." + m.name)):
                os.remove(os.path.join(self.path, "." + m.name))


def write_bundle(summary: DataFrame, path: str, files: dict[str, str]) -> None:
    """A zip with the one-row summary as JSON and the given local files by name."""
    row = summary.limit(1).toJSON().first() or "{}"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("summary.json", json.dumps(json.loads(row), indent=2, ensure_ascii=False))
        for name, at in sorted(files.items()):
            z.write(at, name)
