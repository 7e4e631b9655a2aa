"""WARC archives in seekable Zstandard bundles: written by Spark tasks, mapped by an index, read back at random.

A bundle is a row of independent frames, each with a group of WARC records, and ends with the seek table of the public
seekable format (a skippable frame). The index maps a record to its bundle, frame, and offset within the frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .shared import join_groups, keep, new_path, open_shared, within_bounds

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame and in a bundle, before compression; least payload that a revisit record stands for.
FRAME_BYTES, BUNDLE_BYTES, LEAST_PAYLOAD = 1 << 18, 1 << 26, 100
#: Groups of copies up to this number are broadcast; of more only the large ones are, and the rest are joined by shuffle.
MOST_BROADCAST = 500_000


def page_uri(page_id) -> str:
    """The name of a page's record; ids are escaped, so that any of them stands on one line, and null has a name of its own."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(uri: str) -> str | None:
    return None if uri == "<urn:page>" else unquote(uri[10:-1])


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """A WARC record. A revisit has no block; it names the record that holds its payload, and the payload's length."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_uri(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_uri(refers_to)}"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


class BundleWriter:
    """One bundle file. A retried task writes another file; only files that the index names count."""

    def __init__(self, folder: str) -> None:
        self.path, self.size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
        self.out, self.frame, self.table = open_shared(self.path, "wb"), bytearray(), []

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it at which the record stands."""
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.table), len(self.frame)
        self.frame += data
        self.size += len(data)
        return at

    def flush(self) -> None:
        packed = zstandard.ZstdCompressor(level=3).compress(bytes(self.frame))
        self.out.write(packed)
        self.table.append((len(packed), len(self.frame)))
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle; the last frame is kept."""

    def __init__(self, path: str) -> None:
        self.file = open_shared(path, "rb")
        self.file.seek(0, 2)
        end = self.file.tell()
        self.file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", self.file.read(8 * n)))
        self.at, place = [], 0
        for packed, size in sizes:
            self.at.append((place, packed, size))
            place += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, no: int) -> bytes:
        if self.last[0] != no:
            place, packed, size = self.at[no]
            self.file.seek(place)
            self.last = no, zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        return self.last[1]

    def close(self) -> None:
        self.file.close()


def payload_kinds(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, kind, refers_to): of equal payloads the smallest page_id is the response."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest")
    )
    groups = rows.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest").agg(
        F.min("page_id").alias("response"), F.count("*").alias("n")
    )
    groups = keep(groups.where("n > 1"), "copies")
    if groups.count() <= MOST_BROADCAST:
        found = rows.join(F.broadcast(groups), "digest", "left")
    else:
        found = join_groups(rows, groups, "digest", "n", pages.count(), "left")
    again: Column = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return found.select(
        "page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("response")).alias("refers_to")
    )


@within_bounds
def write_archives(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes a record for each row and returns the index: page_id, bundle, frame, start, length. No page is shuffled
    while the groups of copies can be broadcast; a task writes its rows in bundles of BUNDLE_BYTES."""
    rows = payload_kinds(pages, **columns)
    folder = folder or new_path(pages.sparkSession, "warc")
    kind = dict(rows.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            ids, where = batch.column("page_id"), []
            for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is not None and bundle.size > BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                bundle = bundle or BundleWriter(folder)
                data = record(page, url, html.encode(), digest, kind, refers)
                where.append((bundle.path, *bundle.add(data), len(data)))
            cols = list(zip(*where, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["page_id", "bundle", "frame", "start", "length"]
            )
        if bundle is not None:
            bundle.close()

    index = rows.mapInArrow(run, f"page_id {kind}, bundle string, frame long, start long, length long")
    return keep(index, "warc_index")


def read_archives(index: DataFrame) -> DataFrame:
    """The records that the index names, as rows of read_record: page_id, payload_bytes, payload_digest, record_type,
    refers_to. The digest of a response is computed from the payload read; a revisit has it in its header."""
    kind = dict(index.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        for batch in batches:
            out = []
            for _, bundle, frame, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != path:
                    if reader is not None:
                        reader.close()
                    reader, path = BundleReader(bundle), bundle
                headers, block = parse(reader.frame(frame)[start : start + length])
                said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                revisit = headers["WARC-Type"] == "revisit"
                digest = said if revisit else hashlib.sha256(block).hexdigest()
                if digest != said:
                    raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not match its digest")
                refers = page_of(headers["WARC-Refers-To"]) if revisit else None
                out.append((page_of(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]) if revisit else len(block), digest, headers["WARC-Type"], refers))
            cols = list(zip(*out, strict=True)) or [(), (), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "payload_bytes", "payload_digest", "record_type", "refers"]
            )
        if reader is not None:
            reader.close()

    # bundles are of one size, so dealing them out by name evens the tasks; frames are read in order
    dealt = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "start")
    read = dealt.mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers string")
    return read.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


def archived_pages(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, a row each.

    The payload is the html in UTF-8, null as empty. Rows that repeat page_id and payload are all of the same type: a
    page never revisits itself. A null page_id revisits a page with the same payload that has one. An empty table
    gives an empty result; other columns are ignored.
    """
    return read_archives(write_archives(pages, **columns))
