"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole records, and
a seek table in a skippable frame at its end. Record identifiers map to
(bundle, frame, offset in the frame), so that one record costs the
decompression of one frame.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import persisted

#: Bytes of records after which a frame is closed.
FRAME_BYTES = 1 << 20
#: Frames that one task reads back.
FRAMES_PER_TASK = 64
#: Fixed values of the seekable format: the skippable frame's number and the footer's number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Record headers.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The identifier of a page's record: the same for the same page and payload on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


# --- records ------------------------------------------------------------------------------------------------


def write_record(kind: str, rid: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, extra: dict[str, str]) -> bytes:
    """One WARC record. A revisit has no block; the payload's length is kept in a header of its own."""
    block = payload if kind == "response" else b""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _one_line(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8")]
    if kind == "revisit":
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to or "")]
    lines += [("X-Payload-Length", str(len(payload))), *extra.items(), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def read_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in a frame."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at + len(VERSION) : end].decode("utf-8").split("\r\n"))
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield at, headers, block
        at = end + 8 + size


# --- bundles ------------------------------------------------------------------------------------------------


class BundleWriter:
    """Appends records to a file object; closing it appends the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes, self.compress = out, frame_bytes, zstandard.ZstdCompressor(level=level).compress
        self.held, self.size, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """Where the record is: frame number and offset in the frame."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self._end_frame()
        place = (len(self.frames), self.size)
        self.held.append(record)
        self.size += len(record)
        return place

    def _end_frame(self) -> None:
        packed = self.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * n)
        table = source.read(8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)


def _open(path: str, mode: str):
    """A file of any store that pyarrow can reach, by URI or local path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return open(path, mode)
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_output_stream(inner) if "w" in mode else fs.open_input_file(inner)


# --- jobs ---------------------------------------------------------------------------------------------------

_INDEX = "record_id string, bundle string, frame long, `offset` long"
_RECORD = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
#: Rows up to which the table of shared payloads is broadcast (some 60 bytes each). A larger one is shuffled.
BROADCAST_ROWS = 400_000


def _write_batches(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bundle for each task attempt; the index rows name it, and only a successful attempt's rows are kept."""
    path, out, writer = f"{folder}/{uuid.uuid4().hex}.warc.zst", None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if writer is None:
            out = _open(path, "wb")
            writer = BundleWriter(out)
        rids, frames, offsets = [], [], []
        for page, url, html, sha, main in zip(*batch.columns):
            page_id, main_id, digest = page.as_py(), main.as_py(), base64.b32encode(bytes.fromhex(sha.as_py())).decode()
            kind = "response" if page_id == main_id else "revisit"
            extra = {"X-Page-ID": "" if page_id is None else str(page_id)}
            if kind == "revisit":
                extra["X-Refers-To-Page-ID"] = "" if main_id is None else str(main_id)
            rid = record_id(page_id, digest)
            frame, offset = writer.add(write_record(kind, rid, url.as_py(), html.as_py().encode(), digest, record_id(main_id, digest), extra))
            rids.append(rid)
            frames.append(frame)
            offsets.append(offset)
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.string()), pa.array([path] * len(rids), pa.string()), pa.array(frames, pa.int64()), pa.array(offsets, pa.int64())], ["record_id", "bundle", "frame", "offset"])
    if writer is not None:
        writer.close()
        out.close()


def _read_batches(payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    number = lambda x: int(x) if x else None
    for batch in batches:
        source, name, reader = None, None, None
        for bundle, frame in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if bundle != name:
                if source is not None:
                    source.close()
                source, name = _open(bundle, "rb"), bundle
                reader = BundleReader(source)
            rows = []
            for _, h, block in read_records(reader.frame(frame)):
                digest, response = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "response"
                if response and (payload_digest(block) != digest or len(block) != int(h["X-Payload-Length"])):
                    raise ValueError(f"payload of {h['WARC-Record-ID']} has changed")
                text = block.decode() if response and payload else None
                rows.append((h["WARC-Record-ID"], number(h["X-Page-ID"]), h["WARC-Target-URI"], h["WARC-Type"], int(h["X-Payload-Length"]), digest, number(h.get("X-Refers-To-Page-ID", "")), text))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if source is not None:
            source.close()


@dataclass
class Archive:
    """Bundles in ``folder``, and the index: record_id, bundle, frame, offset."""

    folder: str
    index: DataFrame

    def records(self, payload: bool = True) -> DataFrame:
        """Every record, read back from the bundles one frame at a time, digests checked; ``payload`` false leaves that null."""
        return _frames(self.index).mapInArrow(lambda b: _read_batches(payload, b), _RECORD)

    def lookup(self, record_ids: DataFrame) -> DataFrame:
        """The records of a column record_id; only the frames that hold them are read."""
        wanted = record_ids.select("record_id").distinct()
        found = _frames(self.index.join(wanted, "record_id")).mapInArrow(lambda b: _read_batches(True, b), _RECORD)
        return found.join(wanted, "record_id", "left_semi")


def _frames(index: DataFrame) -> DataFrame:
    """The frames of an index, dealt out over as many tasks as they need."""
    frames = persisted(index.select("bundle", "frame").distinct(), "frames")
    return frames.repartition(max(1, -(-frames.count() // FRAMES_PER_TASK)))


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> Archive:
    """Write a record for every row of ``pages`` (page_id, url, html) to bundles in ``folder``.

    The payload is the html in UTF-8, a null html an empty one. Of records
    with equal payloads of at least ``min_revisit_bytes`` bytes, the one with
    the largest page_id is a response, the others are revisits of it; smaller
    payloads are all responses. Rows that repeat a page_id and its html are
    all responses if one is, with the same identifier; a null page_id is
    less than others, and its rows are revisits if any other row has the
    payload. Other columns are ignored, whatever their names. An empty table
    makes an empty index and no bundle.

    Only page ids and digests are sorted out by payload; the html itself is
    joined by page_id and digest, so a payload that a third of the pages share
    is no task of its own. The index is written to the shared folder by
    Spark, which keeps the rows of successful task attempts alone: bundles of
    others are left over and never read.
    """
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keyed = given.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    ids = persisted(keyed.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "sha"), "payloads")
    shared = ids.groupBy("sha").agg(F.max("page_id").alias("main"), F.count("*").alias("n")).where("n > 1").select("sha", "main")
    shared = persisted(shared, "shared")  # a join of plain tables, of which a payload that very many pages share can be split
    mains = persisted(ids.join(shared, "sha").select("page_id", "sha", "main", F.lit(True).alias("known")).distinct(), "mains")
    if mains.count() <= BROADCAST_ROWS:
        mains = F.broadcast(mains)
    joined = keyed.alias("k").join(mains.alias("m"), F.expr("k.page_id <=> m.page_id AND k.sha = m.sha"), "left")
    records = joined.select("k.page_id", "url", "html", "k.sha", F.when(F.col("known"), F.col("main")).otherwise(F.col("k.page_id")).alias("main"))
    return Archive(folder, persisted(records.mapInArrow(lambda b: _write_batches(folder, b), _INDEX), "warc-index"))
