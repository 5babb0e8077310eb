"""WARC records in seekable Zstandard bundles (operator 7).

A bundle is a file of independent Zstandard frames, each with whole records.
Two skippable frames end it: an index that maps record ids to (frame, offset in
the frame, length), and the seek table of the public seekable format, so any
record is read by decompressing one frame. Bundles are written and read through
a Spark data source: a task writes files under names of its own, and only those
in the manifest, written when all tasks have committed, are ever read; a lost
executor or a second attempt leaves nothing that counts.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import scratch_path

# Fixed values of the public formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
MANIFEST = "manifest.json"
ID_PREFIX = "urn:kinweave:record:"
#: Equal payloads shorter than this are all stored.
REVISIT_BYTES = 1000

ROW = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _line(text: str) -> str:
    """A header value: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def encode_record(row: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head but no payload."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = head if row["record_type"] == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{ID_PREFIX}{_line(row['record_id'] or '')}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{_line(row['refers_to'] or '')}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """The row of a record; raises ValueError where length or digest disagree with the header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a WARC payload doesn't match its digest")

    def record_id(name: str) -> str | None:
        return fields[name][1 + len(ID_PREFIX) : -1] or None if name in fields else None

    return {"record_id": record_id("WARC-Record-ID"), "record_type": fields["WARC-Type"], "target_uri": fields.get("WARC-Target-URI"), "payload_digest": digest, "payload_bytes": length, "refers_to": record_id("WARC-Refers-To"), "payload": None if revisit else payload}


class BundleWriter:
    """Appends records to one bundle; :meth:`close` adds index and seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress
        self.buffer, self.sizes, self.index, self.written = io.BytesIO(), [], [], 0

    def add(self, record_id: str | None, record: bytes) -> None:
        if self.buffer.tell() and self.buffer.tell() + len(record) > self.frame_bytes:
            self._flush()
        self.index.append((record_id, len(self.sizes), self.buffer.tell(), len(record)))
        self.buffer.write(record)

    def _flush(self) -> None:
        raw = self.buffer.getvalue()
        packed = self.compress(raw)
        self.sink.write(packed)
        self.sizes.append((len(packed), len(raw)))
        self.written += len(packed)
        self.buffer = io.BytesIO()

    def close(self) -> None:
        if self.buffer.tell():
            self._flush()
        ids, frames, offsets, sizes = zip(*self.index, strict=True) if self.index else ((), (), (), ())
        table = pa.record_batch([pa.array(ids, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "frame", "offset", "length"])
        out = io.BytesIO()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_batch(table)
        body = zstandard.ZstdCompressor().compress(out.getvalue())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        entries = [*self.sizes, (len(body) + 8, 0)]
        table_body = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table_body)) + table_body)
        self.sink.close()


class BundleReader:
    """Random access to one bundle; holds its index and one frame."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("no seek table ends this file")
        source.seek(size - 9 - 8 * frames)
        entries = list(struct.iter_unpack("<II", source.read(8 * frames)))
        self.starts, at = [], 0
        for packed, _ in entries:
            self.starts.append(at)
            at += packed
        self.sizes = entries
        source.seek(self.starts[-1] + 8)
        body = zstandard.ZstdDecompressor().decompress(source.read(entries[-1][0] - 8))
        self.index = pa.ipc.open_stream(body).read_all()
        self._frame: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self._frame[0] != frame:
            self.source.seek(self.starts[frame])
            self._frame = frame, zstandard.ZstdDecompressor().decompress(self.source.read(self.sizes[frame][0]), max_output_size=self.sizes[frame][1])
        return self._frame[1][offset : offset + length]

    def find(self, record_id: str) -> list[dict]:
        """The records of an id, by their frame-relative offsets."""
        rows = self.index.filter(pa.compute.equal(self.index["id"], record_id)).to_pylist()
        return [decode_record(self.record(r["frame"], r["offset"], r["length"])) for r in rows]

    def __iter__(self) -> Iterator[dict]:
        for batch in self.index.to_batches():
            for frame, offset, length in zip(*(batch[c].to_pylist() for c in ("frame", "offset", "length")), strict=True):
                yield decode_record(self.record(frame, offset, length))


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


@dataclass
class _Bundle(InputPartition):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.bundle_bytes, self.frame_bytes = int(options.get("bundle_bytes", BUNDLE_BYTES)), int(options.get("frame_bytes", FRAME_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        names, bundle = [], None
        for batch in iterator:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k].as_py() for j, c in enumerate(batch.schema.names)}
                if bundle is None:
                    names.append(f"bundle-{uuid.uuid4().hex}.warc.zst")
                    bundle = BundleWriter(fs.open_output_stream(f"{root}/{names[-1]}", compression=None), self.frame_bytes)
                bundle.add(row["record_id"], encode_record(row))
                if bundle.written >= self.bundle_bytes:
                    bundle.close()
                    bundle = None
        if bundle is not None:
            bundle.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        before = _committed(fs, root)
        if not self.overwrite:
            names = before + names
        with fs.open_output_stream(f"{root}/.{MANIFEST}.part") as out:
            out.write(json.dumps(names).encode())
        fs.move(f"{root}/.{MANIFEST}.part", f"{root}/{MANIFEST}")
        for n in set(before).difference(names):
            fs.delete_file(f"{root}/{n}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                fs.delete_file(f"{root}/{n}")


def _committed(fs, root: str) -> list[str]:
    """The bundles that the manifest names; none where nothing was committed."""
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/{MANIFEST}") as source:
        return json.loads(source.read())


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as source:
            return [_Bundle(n) for n in json.loads(source.read())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "name", None):
            return
        fs, root = _open(self.path)
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        with fs.open_input_file(f"{root}/{partition.name}") as source:
            rows, size = [], 0
            for row in BundleReader(source):
                rows.append(row)
                size += row["payload_bytes"]
                if size >= 4 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcBundles(DataSource):
    """``spark.read/df.write.format("warc_bundles")``; option ``path``, writing also ``bundle_bytes, frame_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc_bundles"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """A WARC record row (``ROW``) for each page.

    The payload is the text in UTF-8, null as empty. Of equal payloads of at
    least ``least`` bytes the page of the largest id is the response and the
    others revisit it; shorter ones are all responses. A page with a null id is
    a response only where its group has no other id. Rows that repeat the
    largest id are all responses. Other columns are left out.
    """
    raw = pages.select(F.col(id_col).alias("p_id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    raw = raw.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "x_same": F.sha2("payload", 256)})
    # a map-side combine meets a payload that fills a third of the pages; the join may split it
    groups = raw.where(F.col("payload_bytes") >= least).groupBy("x_same").agg(F.max("p_id").alias("x_first"), F.count(F.lit(1)).alias("x_n"))
    groups = groups.where(F.col("x_n") > 1).select(F.col("x_same").alias("g_same"), "x_first")
    joined = raw.join(groups, F.col("x_same") == F.col("g_same"), "left")
    revisit: Column = F.col("x_first").isNotNull() & ~F.col("p_id").eqNullSafe(F.col("x_first"))
    return joined.select(
        F.col("p_id").cast("string").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.sha1("payload").alias("payload_digest"), "payload_bytes", F.when(revisit, F.col("x_first").cast("string")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_bundles(rows: DataFrame, path: str, mode: str = "append", **options: int) -> None:
    """Write ``rows`` (``ROW``) beside what was committed under ``path``, or in its place with ``mode="overwrite"``.

    One writer at a time: a commit replaces the manifest by one that names the
    old bundles and its own.
    """
    rows.sparkSession.dataSource.register(WarcBundles)
    writer = rows.write.format("warc_bundles").mode(mode)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the committed bundles under ``path``, each checked against its digest."""
    spark.dataSource.register(WarcBundles)
    return spark.read.format("warc_bundles").load(path)


def archive_and_read(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **names: str) -> DataFrame:
    """Write ``pages`` to bundles (in the shared scratch folder unless ``path`` is given) and read them back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``;
    an empty table writes no bundle and gives an empty result.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write_bundles(records(pages, id_col, **names), path)
    kind = pages.schema[id_col].dataType.simpleString()
    found = read_bundles(pages.sparkSession, path)
    return found.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
