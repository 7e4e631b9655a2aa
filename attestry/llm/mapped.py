"""Sorted keys and Bloom filters as files of the shared folder that workers map: lookups of any size without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .kernels import mix
from .shared import keep, map_file, new_path, open_shared

#: Filter bits for each row, hash functions, rows of a segment and hashes that a task holds before it sends them on.
BITS_PER_ROW, HASHES, SEGMENT_ROWS, HELD = 16, 4, 1 << 21, 1 << 18
#: Keys of one mapped file, until there are MANY_FILES of them.
FILE_KEYS, MANY_FILES = 1 << 16, 4096


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns, the first one sorted and stored as differences."""
    first = columns[0].astype(np.uint64)
    first = np.diff(first, prepend=np.uint64(0))
    body = b"".join(np.ascontiguousarray(c.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (first, *columns[1:]))
    return len(columns).to_bytes(1, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> list[np.ndarray]:
    n, body = data[0], zstandard.ZstdDecompressor().decompress(data[1:])
    size = len(body) // n
    out = []
    for i in range(n):
        planes = np.frombuffer(body, np.uint8, size, i * size).reshape(8, -1)
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1))
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


class RepeatFilter:
    """Where the segments lie. A segment has a bit for each slot that two rows set, in 2**bits slots."""

    def __init__(self, rows: int, folder: str) -> None:
        self.folder, self.segments = folder, max(1, -(-rows // SEGMENT_ROWS))
        self.bits = max(10, int(max(1, rows * BITS_PER_ROW // self.segments) - 1).bit_length())
        self.paths: dict[int, str] = {}
        self.maps: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (mix(h, 3) % np.uint64(self.segments)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """HASHES slots for each hash, as rows."""
        a, b = mix(h, 1), mix(h, 2) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b) >> np.uint64(7)) & np.uint64((1 << self.bits) - 1) for i in range(HASHES)]).astype(np.int64)

    def add(self, h: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        """Sets the slots of rows of one segment in two bitmaps: those set at all, and those set by two rows."""
        for part in np.array_split(h, max(1, len(h) // 100_000)):
            slots = np.sort(self.slots(part), axis=0)
            new = np.ones(slots.shape, bool)
            new[1:] = slots[1:] != slots[:-1]  # a slot that one row hits twice counts once
            hit, n = np.unique(slots[new], return_counts=True)
            bit = (128 >> (hit & 7)).astype(np.uint8)
            again = (n > 1) | ((once[hit >> 3] & bit) > 0)
            np.bitwise_or.at(twice, hit[again] >> 3, bit[again])
            np.bitwise_or.at(once, hit >> 3, bit)

    def may_repeat(self, h: np.ndarray) -> np.ndarray:
        """False only for hashes that one row has."""
        out, own = np.zeros(len(h), bool), self.segment(h)
        for s in np.unique(own).tolist():
            if s in self.paths:
                if s not in self.maps:
                    self.maps[s] = map_file(self.paths[s])
                mine = np.flatnonzero(own == s)
                slots = self.slots(h[mine])
                out[mine] = ((self.maps[s][slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=0)
        return out


def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)


def repeat_filter(rows_in: DataFrame, rows: int, of: Callable[[pa.RecordBatch], np.ndarray] = hashes_of) -> RepeatFilter:
    """The filter of `rows` hashes, in one pass; a hash that repeats has all its slots set in its segment. `of` gives
    the hashes of a batch, by default those of its only column.

    Tasks send their hashes by segment, packed, and of each hash at most two: a text that a third of the rows have does
    not swell its segment. The driver gets a path for each segment.
    """
    made = RepeatFilter(rows, new_path(rows_in.sparkSession, "bloom"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            h = h[np.concatenate([np.ones(min(2, len(h)), bool), h[2:] != h[:-2]])]
            own = made.segment(h)
            order = np.argsort(own, kind="stable")
            edges = np.searchsorted(own[order], np.arange(made.segments + 1))
            some = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array([pack(h[order[edges[s] : edges[s + 1]]]) for s in some], pa.binary())], ["segment", "data"]
            )

        for batch in batches:
            h = of(batch)
            if len(h):
                held.append(h)
            if sum(map(len, held)) > HELD:
                yield flush()
                held = []
        if held:
            yield flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task come sorted by segment; one segment's bitmaps are held at a time."""
        now, once, twice = None, None, None

        def close() -> pa.RecordBatch:
            path = f"{made.folder}/{uuid.uuid4().hex}.bits"
            with open_shared(path, "wb") as out:
                out.write(twice.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([path])], ["segment", "path"])

        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != now:
                    if now is not None:
                        yield close()
                    now, once, twice = s, np.zeros(1 << made.bits - 3, np.uint8), np.zeros(1 << made.bits - 3, np.uint8)
                made.add(unpack(data.as_buffer().to_pybytes())[0], once, twice)
        if now is not None:
            yield close()

    sent = rows_in.mapInArrow(deal, "segment long, data binary")
    dealt = sent.repartition(made.segments, "segment").sortWithinPartitions("segment")
    found = keep(dealt.mapInArrow(build, "segment long, path string"), "segments")
    made.paths = {r["segment"]: r["path"] for r in found.collect()}
    return made


class KeyFiles:
    """Sorted keys, each with a number, in files that workers map; a key's file is the remainder of its hash."""

    def __init__(self, paths: dict[int, tuple[str, int]], files: int) -> None:
        self.paths, self.files, self.maps = paths, files, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its number) for each key."""
        hit, out = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        own = (mix(keys.view(np.uint64), 5) % np.uint64(self.files)).astype(np.int64)
        for f in np.unique(own).tolist():
            if f in self.paths:
                path, n = self.paths[f]
                if f not in self.maps:
                    self.maps[f] = map_file(path).view(np.int64).reshape(2, n)
                have, number = self.maps[f]
                mine = np.flatnonzero(own == f)
                at = np.minimum(np.searchsorted(have, keys[mine]), n - 1)
                found = have[at] == keys[mine]
                hit[mine], out[mine] = found, np.where(found, number[at], 0)
        return hit, out


def key_files(keys: DataFrame) -> KeyFiles:
    """Writes keys (key, number), distinct, to mapped files; the driver gets a path for each file."""
    keys = keep(keys.select("key", "number"), "keys")
    files = max(1, min(-(-keys.count() // FILE_KEYS), MANY_FILES))
    folder = new_path(keys.sparkSession, "key_files")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (mix(batch.column(0).to_numpy().view(np.uint64), 5) % np.uint64(files)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], ["file", "key", "number"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by file and key; the columns of one file are held at a time."""
        now, held = None, []

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.keys"
            with open_shared(path, "wb") as out:
                for column in ("key", "number"):
                    for part in held:
                        out.write(part.column(column).to_numpy().tobytes())
            n = sum(p.num_rows for p in held)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([path]), pa.array([n])], ["file", "path", "n"])

        for batch in batches:
            file = batch.column("file").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    if file[a] != now:
                        if held:
                            yield close()
                        now, held = int(file[a]), []
                    held.append(batch.slice(a, b - a))
        if held:
            yield close()

    dealt = keys.mapInArrow(deal, "file long, key long, number long").repartition(files, "file").sortWithinPartitions("file", "key")
    found = keep(dealt.mapInArrow(write, "file long, path string, n long"), "key_files").collect()
    return KeyFiles({r["file"]: (r["path"], r["n"]) for r in found}, files)
