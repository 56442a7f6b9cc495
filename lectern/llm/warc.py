"""WARC archives of pages, and their index merged into capture histories.

Records are rows of text and go out through Spark's text writer, whose line separator is the two line ends that close
a record; so an archive is a plain gzip WARC file wherever Spark can write. Each archive read back gives a run of
index entries, sorted by URL key and time. Entries meet by range of (key, time, page), and in each range a loser tree
merges the runs, so the ranges in order are the histories in order; a hot URL spans ranges by its times.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, save

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"


def _line(name: str, value: Column) -> Column:
    """A header line, empty if the value is null; line ends inside a value would end the header."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", "%0A"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured_col: str | None = None, least: int = 100) -> DataFrame:
    """The text of one record per row of pages, without the closing line ends.

    Null payloads count as empty. Of equal payloads of ``least`` bytes or more, the smallest id's record is the
    response and the others revisit it; a null id never is the smallest unless all are null, then each is a response.
    Rows repeated in full are all responses if theirs is the smallest id. Without a capture time, the id counts
    seconds from the start of 2024.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    epoch = F.col(f"`{captured_col}`") if captured_col else F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col(f"`{id_col}`"), F.lit(0)))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.date_format(epoch, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    # Grouped before any payload moves; only digests that repeat are joined.
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    marked = rows.join(first, "digest", "left")
    revisit = F.coalesce((F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("id"))),
        _line("WARC-Date", F.col("at")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("first")))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return marked.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, per_file: int = 500, **how) -> None:
    """Archives of per_file records at most, gzip, under path."""
    records(pages, **how).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str | None) -> str:
    """Host reversed and comma-joined, then path and query; scheme, www, default port and fragment do not count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + query if query else ''}".lower()


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record, offsets in the uncompressed archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = head + 4 + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end")
        yield headers, data[head + 4 : end], at, end + 4 - at
        at = end + 4


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch per archive: its entries as a sorted run. Payloads are checked against their digests."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            run = []
            for headers, block, at, length in parse_archive(zlib.decompress(content.as_buffer(), 47)):
                http, payload = block.split(b"\r\n\r\n", 1)
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{path}: payload at {at} does not match its digest")
                url = headers.get("WARC-Target-URI")
                run.append((url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, kind, size, digest, _page(headers.get("WARC-Refers-To")), path, at, length))
            run.sort(key=_order)
            names = [x.split()[0] for x in _INDEX.split(", ")]
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in _INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in run], kinds[k]) for k in range(len(names))], names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_index_rows, _INDEX)


def _order(entry: tuple) -> tuple:
    """URL key, time, page; a null page first; then the place in the archives."""
    return entry[0].encode(), entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


class LoserTree:
    """Merges sorted runs: each inner node keeps the run that lost there, so one path is replayed per entry."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [self._next(r) for r in range(k)]
        self.losers = [0] * k
        winner = [0] * (2 * k)
        for r in range(k):
            winner[k + r] = r
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winner[1] if k > 1 else 0

    def _next(self, run: int):
        entry = next(self.runs[run], None)
        return None if entry is None else (_order(entry), entry)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[0] <= y[0])

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and (head := self.heads[self.top]) is not None:
            yield head[1]
            self.heads[self.top] = self._next(self.top)
            node = (k + self.top) // 2
            while node:
                if self._before(self.losers[node], self.top):
                    self.top, self.losers[node] = self.losers[node], self.top
                node //= 2


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one range, which come one after another, merged. A range is a bounded share of the entries."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    archive = t["archive"].to_pylist()
    starts = [0, *(k for k in range(1, len(archive)) if archive[k] != archive[k - 1]), len(archive)]

    def run(a: int, b: int) -> Iterator[tuple]:
        for k in range(a, b, 1024):
            part = t.slice(k, min(1024, b - k))
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    out: list[tuple] = []
    schema = t.schema
    for entry in LoserTree([run(a, b) for a, b in zip(starts, starts[1:], strict=False)]):
        out.append(entry)
        if len(out) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def histories(index: DataFrame, per_range: int = 50_000) -> DataFrame:
    """The entries in global order of (URL key, time, page): partition after partition, and within each."""
    n = max(1, -(-index.count() // per_range))
    key = ["url_key", "captured", "page_id", "archive", "offset"]
    ranges = index.repartitionByRange(n, *key).sortWithinPartitions("archive", "url_key", "captured", "page_id", "offset")
    return ranges.mapInArrow(_merge_rows, index.schema)


def capture_histories(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Writes pages as archives, reads them back and merges their index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **how)
    return histories(save(read_index(spark, path), "warc-index"))
