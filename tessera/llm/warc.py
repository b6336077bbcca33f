"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole WARC/1.1 records, and at its
end a skippable frame with the seek table (Zstandard's seekable format): compressed and plain size of
every frame. The record index (Parquet) maps a record's id to its bundle, its frame and its offset
within the frame, so that one record costs one frame.

Of records with equal payloads one is a response, the others are revisits that name it. Which, is
decided over digests and ids alone; the payloads cross the network once, to where they are written.
Bundles carry a unique name for each attempt to write them and count only where the committed index
names them, so lost executors and second attempts leave nothing wrong behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256_000, 64_000_000, 3
#: Compressed bytes of frames that a task reads, about; it reads them one frame at a time.
READ_BYTES = 2_000_000
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_size long, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """(record id, the record). A revisit has no payload of its own, but its digest and size.

    Ids are made of page id and digest, so that a revisit can name its response.
    """
    name = f"<urn:tessera:page:{'' if page_id is None else page_id}:{digest(payload)}>"
    block = b"" if revisit else payload
    target = "".join(c if " " < c else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:tessera:page:{refers_to}:{digest(payload)}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, block, offset of the next record)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut short")
    return fields, block, end + 8 + size


class Bundle:
    """Writes records into frames; close() gives the file's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self._frame_bytes, self._z = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._open, self._size, self._names = [], 0, []
        self._sizes: list[tuple[int, int]] = []
        self._out, self.bytes, self.rows = [], 0, []

    def add(self, name: str, page_id: int | None, data: bytes) -> None:
        self._names.append((name, page_id, self._size, len(data)))
        self._open.append(data)
        self._size += len(data)
        if self._size >= self._frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self._open:
            return
        packed = self._z.compress(b"".join(self._open))
        self.rows += [(name, page_id, len(self._sizes), self.bytes, len(packed), offset, length) for name, page_id, offset, length in self._names]
        self._sizes.append((len(packed), self._size))
        self._out.append(packed)
        self.bytes += len(packed)
        self._open, self._size, self._names = [], 0, []

    def close(self) -> bytes:
        self._flush()
        entries = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self._out) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of the frames of a bundle, from its footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    size = 12 if flags & 128 else 8
    at, out = 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", data, len(data) - 9 - (n - i) * size)
        out.append((at, packed, plain))
        at += packed
    return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Archive:
    spark: SparkSession
    root: str

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.root}/index")

    def lookup(self, record_id: str) -> tuple[dict[str, str], bytes]:
        """One record, by reading one frame."""
        import zstandard

        r = self.index().where(F.col("record_id") == record_id).first()
        where, path = _filesystem(f"{self.root}/bundles")
        with where.open_input_file(f"{path}/{r.bundle}") as f:
            frame = zstandard.ZstdDecompressor().decompress(f.read_at(r.frame_size, r.frame_start))
        return parse(frame, r.offset)[:2]


def write_archive(pages: DataFrame, root: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """A record for each row, payload the text in UTF-8 (null: empty).

    Among equal payloads of least_bytes or more the row with the largest id is the response and the
    others are revisits of it (rows that repeat that very id are responses too; null ids count as
    the smallest). Smaller payloads are all responses. An empty table makes an archive without bundles.
    `root` has to be a place that pyarrow's file systems reach (file, hdfs, s3 ...).
    """
    spark = pages.sparkSession
    root = root or shared_dir(spark, "warc")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    groups = p.where(F.octet_length("html") >= least_bytes).groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_sha", "_first")
    p = p.join(groups, "_sha", "left").withColumn("_revisit", F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")))
    where, path = _filesystem(f"{root}/bundles")
    where.create_dir(path, recursive=True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in INDEX.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]

        def put(bundle: Bundle) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = bundle.close()
            where, path = _filesystem(f"{root}/bundles")
            with where.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(data)
            rows = [(r[0], r[1], name, *r[2:]) for r in bundle.rows]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        bundle = None
        for b in batches:
            for page_id, url, html, first, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bundle = bundle or Bundle()
                bundle.add(*_named(page_id, record(page_id, url, html.encode(), first, revisit)))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield put(bundle)
                    bundle = None
        if bundle:
            yield put(bundle)

    written(p.select("page_id", "url", "html", "_first", "_revisit").mapInArrow(run, INDEX), "index", f"{root}/index")
    return Archive(spark, root)


def _named(page_id: int | None, made: tuple[str, bytes]) -> tuple[str, int | None, bytes]:
    return made[0], page_id, made[1]


def read_archive(archive: Archive) -> DataFrame:
    """Every record of the bundles that the index names: RECORD's columns; payload is null for revisits.

    The frames are dealt out by their place, to as many tasks as their bytes ask for. A damaged payload
    raises an error; an archive of an empty table gives no rows; repeated rows are records of their own.
    """
    root = archive.root

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for name, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where, path = _filesystem(f"{root}/bundles")
                with where.open_input_file(f"{path}/{name}") as f:
                    frame = zstandard.ZstdDecompressor().decompress(f.read_at(size, start))
                rows, at = [], 0
                while at < len(frame):
                    fields, block, at = parse(frame, at)
                    told, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                    if not revisit and (digest(block) != told or len(block) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                    page, refers = fields["X-Page-ID"], fields.get("WARC-Refers-To", "").removeprefix("<urn:tessera:page:").split(":")[0]
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], told, int(fields["X-Payload-Length"]), int(refers) if refers else None, None if revisit else block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    frames = archive.index().select("bundle", "frame_start", "frame_size").distinct()
    size = frames.agg(F.sum("frame_size")).first()[0] or 0
    return frames.repartition(size // READ_BYTES + 1, "bundle", "frame_start").mapInArrow(run, RECORD)


def op10_seekable_warc(spark, sf_dir: str) -> DataFrame:
    out = read_archive(write_archive(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p GROUP BY html),
d AS (SELECT DISTINCT hex, list_transform(range(8), lambda i: CAST('0x' || substring(hex, 5 * i + 1, 5) AS BIGINT)) AS parts FROM p),
b AS (SELECT hex, array_to_string(list_transform(range(32), lambda i:
  substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS base32 FROM d)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, b.base32 AS payload_digest,
  CASE WHEN p.page_id = g.top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> g.top THEN g.top END AS refers_to
FROM p JOIN g USING (html) JOIN b USING (hex)
"""
