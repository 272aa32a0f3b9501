"""WARC archives with revisit records, and a capture index by external merge.

Writing: records are built in DataFrame expressions and written by Spark's text writer, whose line separator is the
blank lines that end a WARC record, so every file is a gzip-compressed WARC file, on any file system Spark writes to.
A payload of at least ``REVISIT_FROM`` bytes is stored once, in the response of the smallest page id; others revisit it.

Reading: each file is inflated and parsed in pieces by its Content-Length headers, payload digests are verified, and the file's
captures are sorted by URL key and timestamp: a run.  The runs are dealt to key ranges (by Spark's range partitioner, over
the whole sort key, so one URL with very many captures is no hot key); each range merges its slices of all runs with
a loser tree, and counts per range turn places into global ones.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import materialise

REVISIT_FROM = 100
RANGE_ROWS = 50_000
#: rows per archive file, which bounds a run
FILE_ROWS = 20_000
_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_ID = "urn:x-page:"


# ----------------------------------------------------------------------------------------------
# writing
# ----------------------------------------------------------------------------------------------
def with_revisits(pages: DataFrame, *, id_col: str, payload: str, at_least: int = REVISIT_FROM) -> DataFrame:
    """``pages`` and ``__bytes``, ``__digest`` (hex SHA-256) of the payload and ``__refers`` (id of the response that a
    revisit points to, else NULL)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    out = pages.withColumn("__bytes", F.octet_length(body).cast("long")).withColumn("__digest", F.sha2(body.cast("binary"), 256))
    again = out.where(F.col("__bytes") >= at_least).groupBy(F.col("__digest").alias("__d")).agg(
        F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __first is not null")
    again = materialise(again.select("__d", "__first"), "payloads")
    out = out.join(again, out["__digest"] == again["__d"], "left")
    other = (F.col("__bytes") >= at_least) & ~F.col(id_col).eqNullSafe(F.col("__first"))
    return out.withColumn("__refers", F.when(other, F.col("__first"))).drop("__d", "__first")


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is NULL.  Line breaks and other control characters are percent-encoded."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))


def record(id_col: str, url: str, payload: str, captured: Column) -> Column:
    """The record of a page, without the two blank lines that end it."""
    body = F.coalesce(F.col(payload), F.lit(""))
    uri = F.col(url)
    for c in ("\r", "\n", "\t", "\x0b", "\x0c"):
        uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
    utc = F.convert_timezone(None, F.lit("UTC"), captured.cast("timestamp_ntz"))
    revisit = F.col("__refers").isNotNull()
    http = F.concat(F.lit(_HTTP), F.lit("Content-Length: "), F.col("__bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), c.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1" + _CRLF), _header("WARC-Type", kind), _header("WARC-Record-ID", F.coalesce(name(F.col(id_col)), F.lit(f"<{_ID}>"))),
        _header("WARC-Date", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")), _header("WARC-Target-URI", uri),
        _header("WARC-Profile", profile), _header("WARC-Refers-To", name(F.col("__refers"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))),
        _header("X-Payload-Length", F.col("__bytes").cast("string")), _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit(_CRLF), block)


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url: str = "url", payload: str = "html",
               captured: Column | None = None, at_least: int = REVISIT_FROM) -> None:
    """One record per row of ``pages``, in gzip-compressed WARC files under ``path``.

    ``captured`` is a timestamp expression (default: the epoch).  A NULL payload is empty, a NULL URL or id leaves its
    header out or empty.  Rows with the smallest id of their payload are responses, also where they are repeated; among NULL
    ids alone nothing is revisited.  An empty table writes no record.  Other columns are not stored.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload"),
                     (captured if captured is not None else F.timestamp_seconds(F.lit(0))).alias("captured"))
    p = with_revisits(p, id_col="id", payload="payload", at_least=at_least)
    p.select(record("id", "url", "payload", F.coalesce("captured", F.timestamp_seconds(F.lit(0)))).alias("value")).write \
        .option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


# ----------------------------------------------------------------------------------------------
# reading
# ----------------------------------------------------------------------------------------------
def _inflated(data: memoryview, piece: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file of any number of members, piece by piece."""
    d = zlib.decompressobj(31)
    for i in range(0, len(data), piece):
        rest = bytes(data[i:i + piece])
        while rest:
            yield d.decompress(rest)
            rest = d.unused_data if d.eof else b""
            if d.eof:
                d = zlib.decompressobj(31)
    yield d.flush()


def records(data: memoryview) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset (in the inflated file), headers and block of every record of a WARC file."""
    buffer, at, offset = bytearray(), 0, 0
    pieces = _inflated(data)

    def need(n: int) -> bool:
        nonlocal at
        while len(buffer) - at < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            if at > 1 << 20:
                del buffer[:at]
                at = 0
            buffer.extend(piece)
        return True
    while need(1):
        end, size = -1, 256
        while end < 0:
            more = need(size)
            end = buffer.find(b"\r\n\r\n", at)
            if end < 0 and not more:
                raise ValueError("a WARC header does not end")
            size *= 2
        lines = bytes(buffer[at:end]).decode("utf-8").split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        head, length = end + 4 - at, int(headers["content-length"])
        if not need(head + length + 4):
            raise ValueError("a WARC record is cut off")
        yield offset, headers, bytes(buffer[at + head:at + head + length])
        at += head + length + 4
        offset += head + length + 4


def url_key(url: str) -> str:
    """Sort-friendly form of an address: host labels reversed without ``www``, then path and query, in lower case."""
    try:
        u = urlsplit(url)
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + \
        ((u.path or "/") + (f"?{u.query}" if u.query else "")).lower()


_RUN = "run string, url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, " \
       "payload_digest string, record_offset long"
_COLUMNS = [x.split()[0] for x in _RUN.split(", ")]


def _capture(headers: dict[str, str], block: bytes) -> tuple:
    """(URL key, timestamp, id, type, refers to, payload bytes, digest); digests and lengths are verified."""
    number = lambda x: int(x[len(_ID) + 1:-1]) if x and len(x) > len(_ID) + 2 else None
    digest, length = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
    if headers["warc-type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    return (url_key(headers.get("warc-target-uri", "")), headers["warc-date"], number(headers["warc-record-id"]), headers["warc-type"],
            number(headers.get("warc-refers-to")), length, digest)


def _order(capture: tuple) -> tuple:
    """URL key, timestamp, id (NULL last), then run and place in it."""
    return capture[1], capture[2], capture[3] is None, capture[3] or 0, capture[0], capture[8]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


_ARROW = pa.schema([(n, pa.int64() if n in ("page_id", "refers_to", "payload_bytes", "record_offset") else pa.string()) for n in _COLUMNS])


def _runs(batches):
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            name = path.as_py().rpartition("/")[2]
            run = [(name, *_capture(h, block), offset) for offset, h, block in records(memoryview(content.as_buffer()))]
            yield from _batches(iter(sorted(run, key=_order)), _ARROW)


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so the next smallest costs one path of matches."""

    def __init__(self, runs: list[list[tuple]], order):
        self.runs, self.order = runs, order
        self.k = max(1, len(runs))
        self.at = [0] * len(runs)
        self.head = [order(r[0]) if r else None for r in runs]
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i, True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, winner: int, build: bool = False) -> None:
        """Matches from a run's leaf to the top; while building, the first to come waits."""
        node = (winner + self.k) // 2
        while node > 0:
            rival = self.tree[node]
            if rival < 0 and build:
                self.tree[node] = winner
                return
            if self._beats(rival, winner):
                self.tree[node], winner = winner, rival
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.runs and self.head[w := self.tree[0]] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.head[w] = self.order(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            self._play(w)


def _merge(batches):
    runs: dict[str, list[tuple]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            runs.setdefault(row[0], []).append(row)
    for r in runs.values():  # slices arrive in order of their run; that isn't promised
        if any(_order(x) > _order(y) for x, y in zip(r, r[1:])):
            r.sort(key=_order)
    part = TaskContext.get().partitionId()
    schema = _ARROW.append(pa.field("range", pa.int32())).append(pa.field("place", pa.int64()))
    yield from _batches(((*row, part, i) for i, row in enumerate(LoserTree(list(runs.values()), _order))), schema)


def read_captures(spark, path: str) -> DataFrame:
    """The captures of all WARC files under ``path``, in the order of their URL keys and timestamps: ``page_id, url_key, captured,
    record_type, refers_to, payload_bytes, payload_digest, run, record_offset, position`` (global, from 0).  A malformed
    record or a payload that doesn't match its digest is an error; no file gives no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = materialise(files.mapInArrow(_runs, _RUN), "runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    ranges = max(ranges, spark.sparkContext.defaultParallelism)
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_last(), "run", "record_offset")
    merged = materialise(dealt.mapInArrow(_merge, _RUN + ", range int, place long"), "merged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = merged.groupBy("range").agg(F.count(F.lit(1)).alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("carry"))
    out = merged.join(F.broadcast(carry), "range")
    return out.select("page_id", "url_key", "captured", "record_type", "refers_to", "payload_bytes", "payload_digest", "run",
                      "record_offset", (F.col("place") + F.col("carry")).alias("position"))


def archive(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """``write_warc`` and ``read_captures`` in one: the capture index of the archives written for ``pages``."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, **how)
    return read_captures(pages.sparkSession, path)
