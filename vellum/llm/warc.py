"""WARC archives with a two-level capture index (operator 7).

Records are gzip members of WARC files, in the order of their capture key: the URL with its host reversed, then the page id.
The index has two levels. Lines (key, page id, file, offset, length, digest), sorted by key, are packed into compressed
blocks of BLOCK_LINES; the directory holds each block's first line, its offset and length. A lookup binary-searches
the directory, reads one block by range, binary-searches it, and reads the record by range. Directory and blocks exist once
for each part of the key space, and the list of parts is itself sorted, so nothing of the index is ever read whole. A task begins
another part after FILE_BYTES. Look-ups come in key order, so records that follow each other are read together.

Payloads. Of captures with equal payloads the one with the greatest page id is a response; the others are revisit records
without payload that refer to it. Payloads under ``min_payload`` bytes are always responses. The greatest id is found by a summed-up count of
SHA-1 digests and SHA-256 digests; joins by digest deal out both sides anew, so that a hot payload can be split.

Edge cases. A null html is an empty payload, a null URL has key "-". Rows without a page id are archived
with the id "none"; they come before all ids, negative ones too, and lose to any other. Rows with equal page id and payload are written each, of the same type
of record. An empty table gives an archive without parts. A very long payload is one record. Extra columns are left out.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, partitions, redealt
from vellum.llm.files import Ranges, write_whole

BLOCK_LINES = 512
#: Bytes of an archive file after which a task begins another part.
FILE_BYTES = 1 << 30
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)")


def capture_key(url: str | None) -> str:
    """Reversed host, in lower case, then ")" and path and query: com,example,www)/path?q. Port 80 and 443 go."""
    if url is None:
        return "-"
    m = _URL.match(url)
    if not m:
        return url
    host, port, path = m.groups()
    name = ",".join(reversed(host.lower().rstrip(".").split(".")))
    return name + (f":{port}" if port not in (None, "80", "443") else "") + ")" + (path or "/")


def _place(key: str, page: int | None) -> tuple:
    """The order of captures, as Spark sorts (key, page): a missing page id comes first."""
    return key, page is not None, page or 0


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:vellum:page:{'none' if page is None else page}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        # A null URL is "-"; a URL of that name is written with its character escaped.
        f"WARC-Target-URI: {'-' if url is None else '\\u002d' if url == '-' else json.dumps(url)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head.insert(5, f"WARC-Refers-To: <urn:vellum:page:{refers_to}>")
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    return fields, rest[:size]


def _classified(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, html_col: str, min_payload: int) -> DataFrame:
    """(page, url, html, target): target is the response's page id where a payload is there twice and one of its rows has an id."""
    data = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumn("_d", F.when(F.octet_length(data) >= min_payload, F.sha2(data, 256)))
    digests = rows.where("_d IS NOT NULL").withColumn("_h", F.xxhash64("_d"))
    twice = digests.groupBy("_h", "_d").agg(F.count(F.lit(1)).alias("_n"), F.max("page").alias("target")).where("_n > 1")
    twice = scratch.write(twice.select("_h", F.col("_d").alias("_e"), "target"), "payloads")
    joined = rows.withColumn("_h", F.xxhash64("_d")).join(redealt(twice, "_h", "_k"), (F.col("_h") == F.col("_k")) & (F.col("_d") == F.col("_e")), "left")
    return joined.select("page", "url", "html", "target")


def _index_key(url: Column):
    @F.arrow_udf("string")
    def of(urls: pa.Array) -> pa.Array:
        return pa.array([capture_key(u.as_py()) for u in urls], pa.string())

    return of(url)


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, level: int = 6, file_bytes: int = FILE_BYTES
) -> None:
    """Writes part-*.warc.gz, part-*.cdx (blocks), part-*.dir (directory) and the manifest, the sorted list of parts."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    rows = _classified(pages, scratch, id_col, url_col, html_col, min_payload).withColumn("key", _index_key(F.col("url")))
    order = ["key", "page"]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, F.xxhash64("html"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, no = TaskContext.get().partitionId(), _rows(batches), 0
        row = next(rows, None)
        while row is not None:
            part, held = f"part-{task:06d}-{no:06d}", _Part()
            with write_whole(folder, f"{part}.warc.gz") as out:
                while row is not None and held.at < file_bytes:
                    page, url, html, target, key = row
                    payload = html.encode()
                    digest = base32_sha1(payload)
                    revisit = target is not None and page != target
                    data = record("revisit" if revisit else "response", page, url, b"" if revisit else payload, len(payload), digest, target if revisit else None)
                    member = gzip.compress(data, level, mtime=0)
                    out.write(member)
                    held.add(key, page, len(member), digest)
                    row = next(rows, None)
            with write_whole(folder, f"{part}.cdx") as out:
                held.write_blocks(out)
            with write_whole(folder, f"{part}.dir") as out:
                out.write(json.dumps(held.directory).encode())
            first = [pa.array([x], t) for x, t in zip((part, *held.first, held.lines), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(first, names=["part", "key", "page", "lines"])
            no += 1

    made = ranged.select("page", "url", "html", "target", "key").mapInArrow(step, "part string, key string, page long, lines long")
    made.write.parquet(f"{folder}/manifest")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("page", "url", "html", "target", "key")), strict=True):
            yield tuple(x.as_py() for x in row)


class _Part:
    """The index of one part: lines, packed block by block."""

    def __init__(self):
        self.at, self.lines, self.first = 0, 0, None
        self.open: list[str] = []
        self.blocks: list[bytes] = []
        self.directory: list[list] = []

    def add(self, key: str, page: int | None, size: int, digest: str) -> None:
        if self.first is None:
            self.first = (key, page)
        self.open.append(json.dumps([key, page, self.at, size, digest]))
        self.at += size
        self.lines += 1
        if len(self.open) == BLOCK_LINES:
            self._pack()

    def _pack(self) -> None:
        if self.open:
            data = zlib.compress("\n".join(self.open).encode())
            at = self.directory[-1][2] + self.directory[-1][3] if self.directory else 0
            self.directory.append([*json.loads(self.open[0])[:2], at, len(data), zlib.crc32(data)])
            self.blocks.append(data)
            self.open = []

    def write_blocks(self, out) -> None:
        self._pack()
        for data in self.blocks:
            out.write(data)


class CaptureIndex:
    """Lookups in one part's index: the directory is read once, a block when a key falls into it."""

    def __init__(self, files: Ranges, part: str):
        self.files, self.part = files, part
        self.directory = json.loads(files.read(f"{part}.dir", 0, files.size(f"{part}.dir")))
        self.firsts = [_place(*d[:2]) for d in self.directory]
        self.block, self.lines = -1, []

    def _load(self, block: int) -> None:
        if block != self.block:
            _, _, at, size, crc = self.directory[block]
            data = self.files.read(f"{self.part}.cdx", at, size)
            if zlib.crc32(data) != crc:
                raise ValueError(f"{self.part}: an index block is damaged")
            self.block, self.lines = block, [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]

    def find(self, key: str, page: int | None) -> list[list]:
        """The lines of a capture: more than one only if rows with the same URL and page id were archived."""
        wanted = _place(key, page)
        out, at = [], max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while at < len(self.firsts) and self.firsts[at] <= wanted:
            self._load(at)
            lo = bisect.bisect_left(self.lines, wanted, key=lambda x: _place(*x[:2]))
            hi = bisect.bisect_right(self.lines, wanted, key=lambda x: _place(*x[:2]))
            out += self.lines[lo:hi]
            at += 1
        return out

    def record(self, line: list) -> tuple[dict[str, str], bytes]:
        _, _, at, size, digest = line
        fields, payload = parse_record(gzip.decompress(self.files.read_on(f"{self.part}.warc.gz", at, size)))
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or (fields["WARC-Type"] == "response" and base32_sha1(payload) != digest):
            raise ValueError(f"{self.part}: a record is damaged")
        return fields, payload


def _page(uri: str | None) -> int | None:
    return None if uri is None else int(uri[:-1].rsplit(":", 1)[1])


def read_captures(captures: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Looks up each distinct (url, page id) of ``captures``: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to. Captures that the archive lacks have no row."""
    spark = captures.sparkSession
    manifest = spark.read.schema("part string, key string, page long, lines long").parquet(f"{folder}/manifest")
    # The list of parts is as long as the archive had tasks.
    parts = [(r.key, r.page, r.part, r.lines) for r in manifest.orderBy("key", "page", "part").collect()]
    shared = spark.sparkContext.broadcast(parts)
    wanted = captures.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url")).distinct()
    keyed = wanted.select(_index_key(F.col("url")).alias("key"), "page")
    ranged = keyed.distinct().repartitionByRange(partitions(spark), "key", "page").sortWithinPartitions("key", "page")
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, list_ = Ranges(folder), shared.value
        firsts = [_place(k, p) for k, p, _, _ in list_]
        open_: dict[str, CaptureIndex] = {}
        out, size = [], 0
        for batch in batches:
            for key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = _place(key, page)
                at = max(0, bisect.bisect_left(firsts, wanted) - 1)
                while at < len(firsts) and firsts[at] <= wanted:
                    part = list_[at][2]
                    if part not in open_:
                        open_ = {part: CaptureIndex(files, part)}
                    for line in open_[part].find(key, page):
                        fields, payload = open_[part].record(line)
                        kind = fields["WARC-Type"]
                        uri = fields["WARC-Target-URI"]
                        out.append(
                            (
                                page,
                                None if uri == "-" else json.loads(f'"{uri}"'),
                                payload if kind == "response" else None,
                                int(fields["X-Payload-Bytes"]),
                                fields["WARC-Payload-Digest"][5:],
                                kind,
                                _page(fields.get("WARC-Refers-To")),
                            )
                        )
                        size += len(payload)
                    at += 1
                if size > 8_000_000 or len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return ranged.mapInArrow(step, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: part, first key, first page, lines."""
    return spark.read.parquet(f"{folder}/manifest").orderBy("key", "page")
