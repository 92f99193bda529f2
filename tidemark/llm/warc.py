"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``, each compressed on its
own. A bundle is frames one after another and, in a skippable frame at its end,
the seek table of the public seekable format: compressed and plain size of every
frame. The index maps a record to its bundle, frame and offset inside the frame,
so a record is read with the bundle's footer and one frame.

Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the
largest id is a response and the others revisit it. Groups are aggregated before
any shuffle; texts are shuffled once, by id and digest.

Every attempt of a task writes bundles of its own names below the given folder;
the index names those of the attempts that counted.

Defined results: null html is an empty payload; null ids are smallest and null
in the result; of rows with equal id and payload of a revisited kind one is the
response and the others revisit it; null or unprintable urls are left out or
percent-encoded in the header; an empty table gives no bundle and no row;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, small_batches
from tidemark.session import scratch_path, stage

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
REVISIT_BYTES = 1000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

# fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")  # frames, descriptor, magic
ENTRY = struct.Struct("<II")  # compressed size, plain size
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, at int, size int"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/[^/]", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def record_id(page_id, digest: str, nth: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}|{digest}|{nth}').urn}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, digest: str, nth: int, refers_to: str | None) -> tuple[str, bytes]:
    """Id and bytes of a page's record; a revisit if ``refers_to`` names a record."""
    rid = record_id(page_id, digest, nth)
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE)]
    if url:
        headers.append(("WARC-Target-URI", re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
        return rid, _record(headers, http)
    return rid, _record(headers, http + payload)


@dataclass
class Bundle:
    """Writes frames and, when closed, the seek table."""

    path: str
    sizes: list[tuple[int, int]] = field(default_factory=list)
    written: int = 0

    def __post_init__(self):
        filesystem, path = _open(self.path)
        self.out = filesystem.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.written += len(packed)

    def close(self) -> None:
        table = b"".join(ENTRY.pack(*s) for s in self.sizes) + FOOTER.pack(len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, path: str):
        self.path = path
        filesystem, local = _open(path)
        self.file = filesystem.open_input_file(local)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        frames, _, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(size - FOOTER.size - frames * ENTRY.size)
        at, self.frames = 0, []
        for packed, plain in ENTRY.iter_unpack(self.file.read(frames * ENTRY.size)):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, n: int) -> bytes:
        at, packed, plain = self.frames[n]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and its payload, without the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha1("payload"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write a record per page below ``folder``; the index (record_id, bundle, frame, at, size) is written and returned."""
    small_batches(pages.sparkSession)
    rows = _pages(pages, id_col, url_col, html_col)
    narrow = stage(rows.filter(F.octet_length("payload") >= revisit_bytes).select("id", "digest"), "digests")
    groups = narrow.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = narrow.distinct().join(groups, "digest").select(row_key(F.col("id"), F.col("digest")).alias("_key"), F.col("keep"), F.lit(True).alias("shared"))
    wide = rows.withColumn("_key", row_key(F.col("id"), F.col("digest"))).repartition("_key").join(shared, "_key", "left")
    wide = wide.sortWithinPartitions("_key", "url").select("id", "url", "payload", "digest", "_key", "keep", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, frame, index, filled, last, nth = None, [], [], 0, None, 0
        names = ["record_id", "bundle", "frame", "at", "size"]

        def flush() -> None:
            nonlocal filled
            bundle.frame(b"".join(frame))
            frame.clear()
            filled = 0

        def told() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            index.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, key, keep, is_shared = (b.column(c)[i].as_py() for c in range(7))
                nth = nth + 1 if key == last else 0
                last = key
                first = record_id(keep, digest, 0)
                rid, data = page_record(page_id, url, payload, digest, nth, first if is_shared and (page_id != keep or nth) else None)
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                index.append((rid, bundle.path, len(bundle.sizes), filled, len(data)))
                frame.append(data)
                filled += len(data)
                if filled >= frame_bytes:
                    flush()
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
                        yield told()
            if len(index) > 10_000:
                yield told()
        if bundle is not None:
            if frame:
                flush()
            bundle.close()
        if index:
            yield told()

    filesystem, path = _open(folder)
    filesystem.create_dir(path, recursive=True)
    return stage(wide.mapInArrow(run, INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """Records of an index, read by frame.

    Gives record_id, page_id (string), url, record_type, payload (null for a
    revisit), refers_to_record.
    """
    places = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, data = None, None, b""
        for b in batches:
            out, size = [], 0
            for row in b.to_pylist():
                if reader is None or reader.path != row["bundle"]:
                    if reader:
                        reader.close()
                    reader, held = BundleReader(row["bundle"]), None
                if held != row["frame"]:
                    held, data = row["frame"], reader.frame(row["frame"])
                headers, payload = parse_record(data[row["at"]:row["at"] + row["size"]])
                if headers["WARC-Record-ID"] != row["record_id"]:
                    raise ValueError(f"{row['bundle']} has another record at the place of {row['record_id']}")
                revisit = headers["WARC-Type"] == "revisit"
                out.append((
                    row["record_id"], headers.get("WARC-Page-ID"), headers.get("WARC-Target-URI"), headers["WARC-Type"],
                    None if revisit else payload, headers.get("WARC-Refers-To"),
                ))
                size += len(payload)
                if size >= 16 << 20:
                    yield _records(out)
                    out, size = [], 0
            if out:
                yield _records(out)
        if reader:
            reader.close()

    return places.mapInArrow(run, "record_id string, page_id string, url string, record_type string, payload binary, refers_to_record string")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
    names = ["record_id", "page_id", "url", "record_type", "payload", "refers_to_record"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_pages(index: DataFrame) -> DataFrame:
    """Figures of all records, revisits resolved: record_id, page_id, record_type, payload_bytes, payload_digest, refers_to."""
    got = read_records(index).select(
        "record_id", "page_id", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "refers_to_record",
    )
    got = stage(got, "records")
    response = got.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")
    )
    # one row per revisited record; revisits of one record are many, and adaptive execution splits them
    out = got.join(response, "refers_to_record", "left")
    return out.select(
        "record_id", "page_id", "record_type", F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"), "refers_to",
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", folder: str | None = None, **options) -> DataFrame:
    """Write the pages' archives and read them back; ids have their kind again."""
    index = write_archives(pages, folder or scratch_path(pages.sparkSession, "warc"), id_col, **options)
    kind = pages.schema[id_col].dataType
    return read_pages(index).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
