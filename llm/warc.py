"""WARC archives of pages and one globally ordered index of their captures.

Writing: each task writes gzip-compressed WARC files (a member for each record, so records can be
read alone) into the shared folder under names of its own and returns their names; only files that
a finished task named count, so lost or repeated tasks leave no trace.  Of records with equal
payloads of at least ``least`` bytes the one with the smallest id is the response, others revisit it.

Reading streams each file record by record and checks payload digests.  The captures of a file, sorted by
URL key and time, are a run.  Runs are merged externally: the key space is cut into ranges, each
run is cut with it, and a task merges the pieces of all runs in its range with a loser tree.  Ranges follow
each other, so the merged index is in order as a whole.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import fresh_folder, saved

#: Payloads below so many bytes are never revisited.
LEAST = 100
#: Bytes of records, before compression, after which a file is closed.
FILE_BYTES = 32 << 20
#: Captures in a range of the merge.
RANGE_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "file string, records long"
_INDEX = ("key string, time string, run string, place long, file string, offset long, id long, url string, "
          "payload_bytes long, payload_digest string, record_type string, refers_to long")
_ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64()}[kind])
                    for name, kind in (c.split() for c in _INDEX.split(", "))])


def url_key(url: str) -> str:
    """The sort key of a URL: host parts reversed, then port, path and query; no fragment, no leading www."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    port = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page: int, url: str, time: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has the HTTP headers and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page}>",
              f"WARC-Date: {time}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _clean(url: str | None, page: int) -> str:
    """A URL fit for a header line; a missing one is named after the page."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:x-page:{page}"


def _write(folder: str) -> Callable:
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        out = name = None
        size = records = 0
        done = []
        for batch in batches:
            for row in batch.select(["page", "url", "time", "payload", "size", "digest", "refers_to"]).to_pylist():
                if out is None:
                    name, size, records = f"{path}/capture-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = record(row["page"], _clean(row["url"], row["page"]), row["time"], row["payload"].encode(),
                              row["size"], row["digest"], row["refers_to"])
                out.write(_member(data))
                size, records = size + len(data), records + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((name, records))
        if out is not None:
            out.close()
            done.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], schema=schema)

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, page: str = "page_id", url: str = "url",
                   body: str = "html", time: str | None = None) -> DataFrame:
    """Write a record for each page and return the manifest (file, records).

    A null body is an empty payload; rows without an id are left out and ids are taken to be
    unique.  ``time`` is a timestamp column; without one, captures are a second apart by id.
    """
    spark = pages.sparkSession
    when = F.col(time) if time else F.timestamp_seconds(F.lit(1704067200) + F.pmod("page", F.lit(10**9)))
    rows = pages.withColumnRenamed(page, "page").where("page is not null").select(
        F.col("page").cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(body), F.lit("")).alias("payload"),
        F.date_format(F.coalesce(when, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # Ids and digests only; a payload that many pages share is one combined row.
    large = rows.where(F.col("size") >= least)
    first = large.groupBy("digest").agg(F.min("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = large.select("page", "digest").join(first, "digest").where("page > refers_to").select("page", "refers_to")
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return saved(rows.join(revisits, "page", "left").mapInArrow(_write(folder), _MANIFEST), "warc-manifest")


def _stream(source) -> Iterator[tuple[int, io.BytesIO]]:
    """Offset and content of each gzip member, one at a time."""
    at, rest = 0, b""
    while True:
        squeeze, content, taken = zlib.decompressobj(31), [], 0
        while not squeeze.eof:
            chunk = rest or source.read(1 << 18)
            if not chunk:
                if taken:
                    raise ValueError("archive ends within a record")
                return
            content.append(squeeze.decompress(chunk))
            rest = squeeze.unused_data
            taken += len(chunk) - len(rest)
        yield at, io.BytesIO(b"".join(content))
        at += taken


def _headers(stream: io.BytesIO) -> dict[str, str]:
    found = {}
    for line in iter(stream.readline, b""):
        line = line.rstrip(b"\r\n")
        if not line:
            break
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode()] = value.strip().decode()
    return found


def _page(urn: str) -> int:
    return int(urn.strip("<>").rpartition(":")[2])


def read_record(stream: io.BytesIO) -> dict:
    """Fields of a record; the digest of a response is computed anew and must agree."""
    if not stream.readline().startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(stream)
    block = io.BytesIO(stream.read(int(fields["content-length"])))
    block.readline()
    size = int(_headers(block)["content-length"])
    payload = block.read()
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't agree with its digest")
    return {"id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "time": fields["warc-date"],
            "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "payload": payload,
            "refers_to": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None}


def _runs(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with store.open_input_stream(name, compression=None) as source:
                    for offset, stream in _stream(source):
                        row = read_record(stream)
                        del row["payload"]
                        rows.append(row | {"key": url_key(row["url"]), "file": name, "offset": offset})
                if len(rows) != records:
                    raise ValueError(f"{name} has {len(rows)} records of {records}")
                rows.sort(key=lambda r: (r["key"], r["time"], r["id"]))
                for place, row in enumerate(rows):
                    row["run"], row["place"] = name, place
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, sources: list[Iterator], key: Callable) -> None:
        self.sources, self.key = sources, key
        self.size = max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (self.key(x), a) < (self.key(y), b)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._build(2 * node), self._build(2 * node + 1)
        if self._before(right, left):
            left, right = right, left
        self.losers[node] = right
        return left

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            best = self.winner
            self.heads[best] = next(self.sources[best], None)
            node = (best + self.size) // 2
            while node:
                if self._before(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of runs, each in order, merged into one sequence with part and rank."""
    runs: dict[str, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            runs.setdefault(row["run"], []).append(row)
    schema = pa.schema([*_ARROW, ("part", pa.int64()), ("rank", pa.int64())])
    part, rows = TaskContext.get().partitionId(), []
    for rank, row in enumerate(LoserTree([iter(r) for r in runs.values()], lambda r: (r["key"], r["time"], r["id"]))):
        rows.append(row | {"part": part, "rank": rank})
        if len(rows) == 5000:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_captures(manifest: DataFrame, folder: str) -> DataFrame:
    """The merged index of archives: a row for each record, ``capture_rank`` counting them in order of key, time and id."""
    files = manifest.count()
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = saved(manifest.repartition(max(1, min(files, 8 * parts))).mapInArrow(_runs(folder), _INDEX), "warc-runs")
    ranges = max(parts, runs.count() // RANGE_ROWS + 1)
    merged = saved(runs.repartitionByRange(ranges, "key", "time", "id").sortWithinPartitions("run", "place").mapInArrow(
        _merge, _INDEX + ", part long, rank long"), "warc-merged")
    # A row for each range.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return merged.join(before, "part").withColumn("capture_rank", F.col("before") + F.col("rank")).drop(
        "part", "rank", "before", "run", "place")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    return read_captures(write_archives(pages, folder), folder)


def op4_warc(spark, folder: str) -> DataFrame:
    """All pages written as WARC archives, read back and indexed."""
    found = archive_round_trip(spark, spark.read.parquet(f"{folder}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
                        F.col("key").alias("url_key"), F.col("time").alias("captured"), "capture_rank")
