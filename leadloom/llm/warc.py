"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, an index of offsets.

Layout of a folder (all of it written by Spark's own sinks, so it lies in shared storage and a lost
executor or a repeated task leaves no half file):

* ``bundles/bundle=B/part-*``: one archive each. WARC records are laid end to end and cut between
  records into frames of about ``frame_bytes``, each compressed by itself with a checksum. Behind
  them stands the seek table of the Zstandard seekable format: a skippable frame with compressed
  size, size and checksum of every frame, and a footer. Any zstd tool can unpack the file. The
  first frame holds a ``warcinfo`` record.
* ``index``: ``record_id, page_id, bundle, frame, offset, length`` of every record, offset and
  length inside the unpacked frame, sorted by ``record_id``.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id
is a ``response``; the others are ``revisit`` records, which hold the HTTP head but no payload and
name that response. How many rows a payload has is counted before the payloads move, so a payload
that a third of all rows share is dealt over many tasks; whole pages are shuffled once.

Defined results: a null payload is empty; a null page_id is smaller than any other; a null url
gives no ``WARC-Target-URI``; line breaks in urls are percent-encoded; rows with the same page_id
and payload are records of their own under one record id, all ``response`` if their page_id is the
largest; extra columns are not read; an empty table gives a folder without bundles, which reads
back as no rows. A record is never cut, so a frame is as long as its longest record at least.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import conf, forget, spread_join, written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 27  # before compression
LEAST_BYTES = 1000

# Fixed values of the two formats.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER, ENTRY = struct.Struct("<IBI"), struct.Struct("<III")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "tag:leadloom.example,2026:page/"

ENTRIES = "array<struct<record_id: string, page_id: bigint, frame: int, offset: bigint, length: bigint>>"
RECORD = (
    "record_id string, record_type string, page_id long, url string, date string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary, bundle string, frame int, offset long"
)


def record_name(page_id: int | None, digest: str) -> str:
    return f"{NAME}{'-' if page_id is None else page_id}/{digest}"


def page_of(record_id: Column) -> Column:
    """The page_id in a record id; null for records without one."""
    return F.nullif(F.regexp_extract(record_id, "page/(-?[0-9]+)/", 1), F.lit("")).cast("long")


def record_bytes(page_id: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, its closing line breaks included."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_name(page_id, digest)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_name(refers_to, digest)}>")]
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _info(bundle: str) -> bytes:
    block = f"software: leadloom\r\nformat: WARC File Format 1.1\r\nbundle: {bundle}\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{NAME}info/{bundle}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
    return f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parsed(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields and block of the record at ``start``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", start)
    version, *lines = data[start:end].decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no WARC record at {start}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = end + 4
    stop = block + int(fields["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {start} does not end where its length says")
    return fields, data[block:stop], stop + 4


class Bundle:
    """Frames under construction."""

    def __init__(self, name: str, frame_bytes: int):
        self.name, self.size = name, 0
        self._limit, self._open, self._open_bytes = frame_bytes, [], 0
        self._frames, self._table, self._entries = [], [], []
        self._packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self._put(_info(name))
        self._close()

    def _put(self, record: bytes) -> None:
        self._open.append(record)
        self._open_bytes += len(record)
        self.size += len(record)

    def _close(self) -> None:
        if self._open:
            data = b"".join(self._open)
            frame = self._packer.compress(data)
            self._frames.append(frame)
            self._table.append(ENTRY.pack(len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self._open, self._open_bytes = [], 0

    def add(self, record_id: str, page_id: int | None, record: bytes) -> None:
        self._entries.append((record_id, page_id, len(self._frames), self._open_bytes, len(record)))
        self._put(record)
        if self._open_bytes >= self._limit:
            self._close()

    def row(self) -> list:
        """Name, archive without the last four bytes (the sink adds them, see ``write_bundles``), entries."""
        self._close()
        table = b"".join(self._table)
        head = struct.pack("<II", SKIPPABLE, len(table) + FOOTER.size)
        footer = FOOTER.pack(len(self._frames), WITH_CHECKSUMS, SEEKABLE)
        names = ("record_id", "page_id", "frame", "offset", "length")
        return [self.name, b"".join([*self._frames, head, table, footer[:-4]]), [dict(zip(names, e, strict=True)) for e in self._entries]]


def frames_of(content: bytes, wanted: set[int] | None = None) -> Iterator[tuple[int, bytes]]:
    """(number, unpacked bytes) of the frames of an archive, found by its seek table; only ``wanted`` ones if given."""
    number, descriptor, magic = FOOTER.unpack_from(content, len(content) - FOOTER.size)
    if magic != SEEKABLE or descriptor != WITH_CHECKSUMS:
        raise ValueError("no seek table at the end")
    table = len(content) - FOOTER.size - number * ENTRY.size
    at, unpacker = 0, zstandard.ZstdDecompressor()
    for i in range(number):
        packed, size, checksum = ENTRY.unpack_from(content, table + i * ENTRY.size)
        if wanted is None or i in wanted:
            data = unpacker.decompress(content[at : at + packed], max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {i} is damaged")
            yield i, data
        at += packed


def _linked(pages: DataFrame, least_bytes: int, id_column: str, url_column: str, payload_column: str, date_column: str | None) -> DataFrame:
    """``page_id, url, date, payload, digest, refers_to, revisit`` of every row."""
    date = F.date_format(F.to_utc_timestamp(F.col(date_column), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_column else F.lit(None)
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.coalesce(date.cast("string"), F.lit("1970-01-01T00:00:00Z")).alias("date"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= least_bytes
    # Rows that are never linked get a key of their own and spread.
    keyed = rows.withColumn("link", F.when(long_enough, F.col("digest")).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url", F.rand(0))))))
    equal = rows.filter(long_enough).groupBy(F.col("digest").alias("link")).agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = spread_join(keyed, equal, "link", "n")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "date", "payload", "digest", F.when(revisit, F.col("newest")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(
    pages: DataFrame,
    path: str,
    least_bytes: int = LEAST_BYTES,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    date_column: str | None = None,
) -> None:
    """Write a record for each row of ``pages`` to the folder ``path``; a task holds one packed bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bundle", "archive", "entries"]
        entries = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        types = [pa.string(), pa.binary(), entries]
        part, number, bundle = TaskContext.get().partitionId(), 0, None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(bundle.row(), types, strict=True)], names)

        for batch in batches:
            for page_id, url, date, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = Bundle(f"b{part:06d}-{number:04d}", frame_bytes)
                bundle.add(record_name(page_id, digest), page_id, record_bytes(page_id, url, date, payload, digest, refers_to, revisit))
                if bundle.size >= bundle_bytes:
                    yield close()
                    number, bundle = number + 1, None
        if bundle is not None:
            yield close()

    linked = _linked(pages, least_bytes, id_column, url_column, payload_column, date_column)
    # Whole pages go to Python: few at a time, for Arrow holds a batch twice while it grows.
    with conf(pages.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
        staged = written(linked.mapInArrow(run, f"bundle string, archive binary, entries {ENTRIES}"))
    # One row makes one file. The text sink ends a row with its separator: here the last four bytes
    # of the format, so the file ends as the format asks.
    ending = struct.pack("<I", SEEKABLE).decode("latin-1")
    archives = staged.select("bundle", F.col("archive").cast("string").alias("archive"))
    archives.write.partitionBy("bundle").option("lineSep", ending).option("encoding", "ISO-8859-1").option("compression", "none").text(f"{path}/bundles")
    staged.select("bundle", F.inline("entries")).sort("record_id", "bundle", "frame", "offset").write.parquet(f"{path}/index")
    forget(staged)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/bundles")
    bundle = F.col("bundle") if "bundle" in files.columns else F.lit(None)  # a folder without bundles
    return files.filter("length > 0").select(bundle.cast("string").alias("bundle"), "content")


def _row(data: bytes, start: int, payloads: bool) -> tuple[list | None, int]:
    fields, block, following = parsed(data, start)
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None, following
    name, digest = fields["WARC-Record-ID"][1:-1], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {name} is damaged")
    page = name.removeprefix(NAME).partition("/")[0]
    refers_to = fields["WARC-Refers-To"][1:-1] if kind == "revisit" else None
    kept = payload if payloads and kind == "response" else None
    return [name, kind, None if page == "-" else int(page), fields.get("WARC-Target-URI"), fields["WARC-Date"], digest, size, refers_to, kept], following


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
_NAMES = [f.split()[0] for f in RECORD.split(", ")]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``, frame by frame; payloads are checked against their digests.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, also for a revisit, whose ``payload`` is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for frame, data in frames_of(content.as_py()):
                    rows, at = [], 0
                    while at < len(data):
                        row, following = _row(data, at, payloads)
                        if row:
                            rows.append([*row, bundle, frame, at])
                        at = following
                    if rows:
                        yield _batch(rows)

    return _archives(spark, path).mapInArrow(run, RECORD)


def fetch(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The records named in ``ids(record_id)``: places from the index, then only their frames are unpacked.

    Only bundles that hold one are read: the archives lie in folders by bundle. ``refers_to`` of a
    revisit is the record id to fetch for its payload.
    """
    places = spark.read.parquet(f"{path}/index").join(ids.select("record_id").distinct(), "record_id", "left_semi")
    per_bundle = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))  # as many as a bundle has records, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, content, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                offsets: dict[int, list[int]] = {}
                for place in wanted:
                    offsets.setdefault(place["frame"], []).append(place["offset"])
                for frame, data in frames_of(content.as_py(), set(offsets)):
                    yield _batch([[*_row(data, at, True)[0], bundle, frame, at] for at in sorted(offsets[frame])])

    return _archives(spark, path).join(per_bundle, "bundle").select("bundle", "content", "places").mapInArrow(run, RECORD)
