"""WARC archives and an external merge of their capture index.

Writing: of records with equal payloads, that with the smallest id is a response, the others are revisits of it
(WARC/1.1, identical-payload-digest); payloads under ``min_bytes`` are always responses. Each task writes archives of gzip
members, one a record, to the shared folder under names of its own and reports them in a manifest table; a retried task
writes new ones, and only those in the manifest are read.

Reading: a task streams the archives it is given, checks each response's payload against its digest, and sorts the captures of
each archive by URL key, timestamp and id. That is a run: it is cut at the bounds of key ranges (from a sample of keys, which only
balances them) and written to the shared folder in blocks of up to 1024 captures. The owner of a range gets its blocks in the order of
their first captures, without sorting captures again, and merges them as they come: a loser tree over the runs gives out what is
before the next block's first capture. So a range is never held whole, and all ranges together are the captures in global
order. A URL with many captures spans ranges by its timestamps.

Defined results: a null payload counts as empty; a null url has the key ""; a null id takes part in nothing but its own
record: it is response only if no record with an id has its payload, else revisits; rows that repeat the smallest id are all
responses; the timestamp is a column, or made from the id; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, shared_path, shuffle_partitions, table

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
CAPTURE = "url_key string, ts string, id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long, length long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_to_32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, in lower case: captures of a host stand together."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path.lower() or '/'}{'?' + parts.query.lower() if parts.query else ''}"


def record(page_id: int | None, url: str, date: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. The HTTP header of a revisit still names the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(position, length, content) of the gzip members of a stream."""
    at, rest = 0, b""
    while True:
        d, out, used = zlib.decompressobj(31), [], 0
        while not d.eof:
            if not rest and not (rest := stream.read(size)):
                if used:
                    raise ValueError("an archive ends within a record")
                return
            out.append(d.decompress(rest))
            used += len(rest) - len(d.unused_data)
            rest = d.unused_data if d.eof else b""
        yield at, used, b"".join(out)
        at += used


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def page_of(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def write_archives(pages: DataFrame, *, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """The manifest (archive, records) of archives of pages (id long, url string, ts string, payload string)."""
    spark = pages.sparkSession
    root = shared_path(spark, "warc")
    digest, size = F.sha1(F.col("payload").cast("binary")), F.octet_length("payload")
    tagged = pages.select("id", F.coalesce("url", F.lit("")).alias("url"), "ts", "payload", digest.alias("digest"), size.alias("bytes"))
    first = pages.select("id", digest.alias("digest")).groupBy("digest").agg(F.min("id").alias("first"))
    rows = tagged.join(first, "digest").withColumn("revisit", (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(root)
        fs.create_dir(path)
        out, name, n, size = None, "", 0, 0
        done: list[tuple[str, int]] = []
        try:
            for batch in batches:
                for page_id, url, ts, payload, digest, first, revisit in zip(*(c.cast(pa.binary()) if i == 3 else c for i, c in enumerate(batch.columns)), strict=True):
                    if out is None:
                        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    data = gzip.compress(record(page_id.as_py(), url.as_py(), ts.as_py(), payload.as_py(), hex_to_32(digest.as_py()), first.as_py(), revisit.as_py()), 3, mtime=0)
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        done.append((name, n))
        finally:
            if out is not None:
                out.close()
                done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{x}" for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["archive", "records"])

    return materialise(rows.select("id", "url", "ts", "payload", "digest", "first", "revisit").mapInArrow(run, "archive string, records long"), "warc-manifest")


def captures(archive: str) -> list[tuple]:
    """The captures of an archive in the order of (url_key, ts, id): a run."""
    fs, path = file_system(archive)
    found = []
    with fs.open_input_stream(path, compression=None) as stream:
        for position, length, data in members(stream):
            warc, http, payload = parse(data)
            kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (digest32(payload) != digest or len(payload) != int(http["Content-Length"])):
                raise ValueError(f"{archive}: the payload at {position} isn't that of its digest")
            url = warc["WARC-Target-URI"]
            refers = page_of(warc["WARC-Refers-To"]) if kind == "revisit" else None
            found.append((url_key(url), warc["WARC-Date"], page_of(warc["WARC-Record-ID"]), url, int(http["Content-Length"]), digest, kind, refers, archive, position, length))
    return sorted(found, key=order)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(CAPTURE_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CAPTURE_TYPES, strict=True)], CAPTURE_NAMES)


def read_archives(manifest: DataFrame, bounds: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """(range, url_key, ts, id, archive, position, block): the runs of all archives, cut at ``bounds`` (url_key, ts) and into blocks, with
    each block's first capture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                found = captures(archive)
                cuts = [0, *(bisect.bisect_left(found, x, key=lambda c: c[:2]) for x in bounds), len(found)]
                rows = []
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for at in range(x, y, BLOCK):
                        own = found[at : min(at + BLOCK, y)]
                        rows.append((k, *own[0][:3], *own[0][8:10], batch_of(own).serialize().to_pybytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK_TYPES, strict=True)], BLOCK_NAMES)

    n = max(shuffle_partitions(manifest.sparkSession), 1)
    return manifest.repartition(n, "archive").mapInArrow(run, "range int, url_key string, ts string, id long, archive string, position long, block binary")


BLOCK = 1024
BLOCK_NAMES = ["range", "url_key", "ts", "id", "archive", "position", "block"]
BLOCK_TYPES = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
CAPTURE_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
CAPTURE_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in CAPTURE.split(", ")]
CAPTURE_SCHEMA = pa.schema(list(zip(CAPTURE_NAMES, CAPTURE_TYPES, strict=True)))


def order(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[8], capture[9]


class LoserTree:
    """Merges sorted runs: a node keeps the loser of its match, so the next row costs one match a level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * len(runs)
        for k in range(len(runs)):
            self._play(k)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (order(x), a) < (order(y), b))

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[self.losers[0]]) is not None:
            yield head
            winner = self.losers[0]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merged(blocks: Iterator[tuple[tuple, str, list[tuple]]]) -> Iterator[tuple]:
    """The captures of blocks (order of the first capture, run, captures), which come in that order. What is before a block is given out as
    soon as the captures held are twice those that had to stay the last time: about a block a run."""
    open_: dict[str, list[tuple]] = {}
    held = stayed = 0

    def before(limit: tuple | None) -> Iterator[tuple]:
        """What is before ``limit``; the rest stays open."""
        taken = dict.fromkeys(open_, 0)
        for capture in LoserTree([iter(x) for x in open_.values()]):
            if limit is not None and order(capture) >= limit:
                break
            taken[capture[8]] += 1
            yield capture
        for run, n in taken.items():
            if n == len(open_[run]):
                del open_[run]
            elif n:
                open_[run] = open_[run][n:]

    for first, run, rows in blocks:
        if held >= 2 * stayed + 4 * BLOCK:
            yield from before(first)
            held = stayed = sum(map(len, open_.values()))
        open_.setdefault(run, []).extend(rows)
        held += len(rows)
    yield from before(None)


def merge(runs: DataFrame, ranges: int) -> DataFrame:
    """Captures in the order of (url_key, ts, id) over the partitions of the result."""
    first = ["url_key", "ts", F.col("id").asc_nulls_first(), "archive", "position"]
    ranged = runs.repartitionByRange(ranges, "range").sortWithinPartitions("range", *first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[tuple, str, list[tuple]]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own = pa.ipc.read_record_batch(batch.column(6)[k].as_buffer(), CAPTURE_SCHEMA)
                    rows = list(zip(*(c.to_pylist() for c in own.columns), strict=True))
                    yield order(rows[0]), rows[0][8], rows

        out = []
        for row in merged(blocks()):
            out.append(row)
            if len(out) == 4096:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return ranged.mapInArrow(run, CAPTURE)


def key_bounds(rows: DataFrame, n: int, ranges: int) -> list[tuple[str, str]]:
    """(url_key, ts) between ``ranges`` ranges, from a sample of about 64 keys each, but not much over 2**20 in all; n: the number of rows."""
    per_range = max(1, min(64, (1 << 20) // ranges))
    sample = rows.select("url", "ts").sample(min(1.0, per_range * ranges / max(1, n)), seed=3).limit(2 * per_range * ranges).collect()
    keys = sorted((url_key(" ".join((r.url or "").split())), r.ts) for r in sample)
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)} if keys else set())


def capture_history(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None, *, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write archives of all rows, read them back, and return the merged captures."""
    base = EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")
    made = F.concat(F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    ts = made if ts_col is None else F.coalesce(F.date_format(F.col(ts_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(base))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), ts.alias("ts"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    manifest, ranges = write_archives(rows, min_bytes=min_bytes, archive_bytes=archive_bytes), shuffle_partitions(pages.sparkSession)
    n = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    bounds = key_bounds(rows, n, ranges)
    runs = materialise(read_archives(manifest, bounds), "warc-runs")
    discard(manifest)
    return merge(runs, ranges)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = capture_history(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(h, i + 1, 1)) - 1) AS d FROM p),
b AS (SELECT *, flatten(list_transform(d, lambda x: [x // 8, x // 4 % 2, x // 2 % 2, x % 2])) AS bits FROM f)
SELECT page_id, payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * bits[5 * i + 1] + 8 * bits[5 * i + 2] + 4 * bits[5 * i + 3] + 2 * bits[5 * i + 4] + bits[5 * i + 5] AS BIGINT), 1)), '') AS payload_digest FROM b
"""
