"""WARC files as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Each record is one gzip member, so a record can be read alone from its offset. Plain files are read as well. Reading makes one
partition per file, or per list of (file, offset, length) given as the option ``records``; writing
makes one file per task, named by the task, and reports where each record landed in ``index`` files
beside them. A broken record is passed over, or raises with the option ``strict``. Paths are local or mounted paths that all executors share.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import uuid
import zlib
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..plans.shared import local_path

SCHEMA = (
    "url string, warc_type string, date string, record_id string, status int, reason string, http_version string, "
    "headers map<string,string>, body binary, filename string, offset bigint, length bigint"
)
#: Headers that tell of the transfer and not of the content.
TRANSFER = frozenset("content-encoding transfer-encoding content-length connection keep-alive".split())
_EOL = b"\r\n"


def headers_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(first line, headers, rest) of a block of header lines and a body."""
    head, _, rest = block.partition(_EOL + _EOL)
    first, *lines = head.decode("latin-1").split("\r\n")
    pairs = [line.partition(":") for line in lines if ":" in line]
    return first, [(k.strip(), v.strip()) for k, _, v in pairs], rest


def parse_record(raw: bytes, filename: str = "", offset: int = 0, length: int = 0) -> dict | None:
    """One record from its uncompressed bytes; None if its length does not hold what it declares."""
    _, pairs, rest = headers_of(raw)
    h = {k.lower(): v for k, v in pairs}
    size = int(h.get("content-length", -1))
    if size < 0 or len(rest) < size:
        return None
    block = rest[:size]
    out = {
        "url": h.get("warc-target-uri"), "warc_type": h.get("warc-type"), "date": h.get("warc-date"), "record_id": h.get("warc-record-id"),
        "status": None, "reason": None, "http_version": None, "headers": {}, "body": block, "filename": filename, "offset": offset, "length": length,
    }
    if h.get("warc-type") == "response":
        line, fields, body = headers_of(block)
        version, _, tail = line.partition(" ")
        code, _, reason = tail.partition(" ")
        out |= {"http_version": version, "status": int(code) if code.isdigit() else None, "reason": reason, "headers": {k.lower(): v for k, v in fields}, "body": body}
    return out


def record_at(raw: bytes, filename: str, offset: int, length: int) -> dict | None:
    """One record from the bytes at its offset, gzipped or plain; None if they are none."""
    try:
        whole = gzip.decompress(raw) if raw.startswith(_GZIP) else raw
    except (OSError, EOFError, zlib.error):
        return None
    return parse_record(whole, filename, offset, length)


class Damaged(ValueError):
    """A file that cannot be read to its end."""


class _Window:
    """A file read forward through a buffer, at known offsets."""

    def __init__(self, f, step: int = 1 << 20):
        self.f, self.step, self.data, self.at = f, step, b"", 0

    def more(self) -> bool:
        new = self.f.read(self.step)
        self.data += new
        return bool(new)

    def find(self, mark: bytes, start: int) -> int:
        """Place of a mark from ``start`` on, -1 at the end of the file; what lies before may be dropped."""
        while (k := self.data.find(mark, start)) < 0:
            start = max(start, len(self.data) - len(mark) + 1)
            if not self.more():
                return -1
        return k

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


_GZIP, _RECORD = b"\x1f\x8b\x08", b"WARC/"


def members(path: str, strict: bool = False):
    """(offset, length, bytes) of each record of a file, gzipped or plain.

    A broken record is passed over: reading goes on at the next one that can be told, and with
    ``strict`` it raises instead. A cut-off last record is broken as well.
    """
    with open(path, "rb") as f:
        w = _Window(f)
        while True:
            if not w.data and not w.more():
                return
            zipped = w.data[:3] == _GZIP[: len(w.data[:3])]
            got = _unzipped(w) if zipped else _plain(w)
            if got is not None:
                raw, used = got
                yield w.at, used, raw
                w.drop(used)
                continue
            if strict:
                raise Damaged(f"{path}: no record at {w.at}")
            gz, plain = w.find(_GZIP, 1), w.find(b"\n" + _RECORD, 1)
            nxt = min((k for k in (gz, plain + 1 if plain >= 0 else -1) if k > 0), default=-1)
            if nxt < 0:
                return
            w.drop(nxt)


def _unzipped(w: _Window) -> tuple[bytes, int] | None:
    """(bytes, length) of the gzip member at the window's start."""
    d, parts, fed = zlib.decompressobj(31), [], 0
    while True:
        try:
            parts.append(d.decompress(w.data[fed:]))
        except zlib.error:
            return None
        if d.eof:
            return b"".join(parts), len(w.data) - len(d.unused_data)
        fed = len(w.data)
        if not w.more():
            return None


def _plain(w: _Window) -> tuple[bytes, int] | None:
    """(bytes, length) of the plain record at the window's start, with the empty lines after it."""
    lead = 0
    while True:  # empty lines between records
        if len(w.data) < lead + 2 and not w.more():
            return None
        if w.data[lead : lead + 2] != _EOL:
            break
        lead += 2
    end = w.find(_EOL + _EOL, lead)
    if end < 0 or not w.data[lead:].startswith(_RECORD):
        return None
    size = {k.lower(): v for k, v in headers_of(w.data[lead : end + 4])[1]}.get("content-length", "")
    if not size.isdigit():
        return None
    stop = end + 4 + int(size)
    while len(w.data) < stop + 4:
        if not w.more():
            break
    if len(w.data) < stop:
        return None
    while w.data[stop : stop + 2] == _EOL:
        stop += 2
    return w.data[lead:stop], stop


def http_block(version: str, status: int, reason: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    """A response as bytes: headers in order without those of the transfer, and the true length."""
    lines = [f"{version} {status} {reason}".rstrip()]
    lines += [f"{k}: {v}" for k, v in headers if k.lower() not in TRANSFER]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("latin-1", "replace") + _EOL * 2 + body


def record_bytes(kind: str, url: str | None, date: str, block: bytes, content_type: str) -> bytes:
    """One record as a gzip member."""
    digest = "sha256:" + hashlib.sha256(block).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {url}"] if url else []), f"WARC-Block-Digest: {digest}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}",
    ]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z:
        z.write("\r\n".join(head).encode() + _EOL * 2 + block + _EOL * 2)
    return out.getvalue()


class _Part(InputPartition):
    def __init__(self, path: str, spots: list[tuple[int, int]] | None = None):
        self.path, self.spots = path, spots


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = local_path(options.get("path", ""))
        self.records = options.get("records")
        self.strict = str(options.get("strict", "false")).lower() == "true"

    def partitions(self):
        if self.records:  # JSON: [[file, offset, length], ...]
            by: dict[str, list] = {}
            for name, offset, length in json.loads(self.records):
                by.setdefault(os.path.join(self.path, name) if os.path.isdir(self.path) else self.path, []).append((offset, length))
            return [_Part(p, sorted(s)) for p, s in sorted(by.items())]
        if os.path.isdir(self.path):
            return [_Part(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith((".warc.gz", ".warc"))]
        return [_Part(self.path)]

    def read(self, part):
        name = os.path.basename(part.path)
        if part.spots is None:
            found = members(part.path, self.strict)
        else:
            found = self._at(part)
        order = [c.strip().split()[0] for c in SCHEMA.replace("map<string,string>", "m").split(",")]
        for offset, length, raw in found:
            row = parse_record(raw, name, offset, length)
            if row is not None:
                yield tuple(row[c] for c in order)

    @staticmethod
    def _at(part):
        with open(part.path, "rb") as f:
            for offset, length in part.spots:
                f.seek(offset)
                raw = f.read(length)
                yield offset, length, gzip.decompress(raw) if raw.startswith(_GZIP) else raw


class _Written(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class WarcWriter(DataSourceWriter):
    """Writes (url, status, reason, http_version, headers, body[, fetched_at]) as response records."""

    def __init__(self, options, overwrite: bool):
        self.path, self.software, self.overwrite = local_path(options["path"]), options.get("software", "weftline"), overwrite

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        t = TaskContext.get()
        name = f"part-{t.partitionId():05d}-{t.taskAttemptId()}.warc.gz"
        now, at, index = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), 0, []
        with open(os.path.join(self.path, "." + name), "wb") as f:
            at += f.write(record_bytes("warcinfo", None, now, f"software: {self.software}\r\nformat: WARC/1.1\r\n".encode(), "application/warc-fields"))
            for r in rows:
                if r["status"] is None or r["body"] is None:
                    continue
                when = r["fetched_at"].strftime("%Y-%m-%dT%H:%M:%SZ") if "fetched_at" in r and r["fetched_at"] else now
                block = http_block(r["http_version"] or "HTTP/1.1", r["status"], r["reason"] or "", sorted((r["headers"] or {}).items()), bytes(r["body"]))
                size = f.write(record_bytes("response", r["url"], when, block, "application/http;msgtype=response"))
                index.append({"url": r["url"], "filename": name, "offset": at, "length": size})
                at += size
        with open(os.path.join(self.path, "." + name + ".index"), "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in index)
        return _Written(name, len(index))

    def commit(self, messages):
        keep = {m.name for m in messages if m}
        if self.overwrite:
            for n in os.listdir(self.path):
                if n.endswith((".warc.gz", ".index")) and not n.startswith(".") :
                    os.remove(os.path.join(self.path, n))
        for n in keep:
            os.replace(os.path.join(self.path, "." + n), os.path.join(self.path, n))
            os.replace(os.path.join(self.path, "." + n + ".index"), os.path.join(self.path, n + ".index"))

    def abort(self, messages):
        for m in messages:
            for n in ("." + m.name, "." + m.name + ".index") if m else ():
                if os.path.exists(os.path.join(self.path, n)):
                    os.remove(os.path.join(self.path, n))


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
