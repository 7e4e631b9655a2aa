"""Token ids as binary files: Simple-8b words in blocks, written by ranges of doc_id, decoded by whole arrays.

A word of 64 bits has a selector in its top 4 bits and as many ids in the other 60 as the selector says. An id of more than
60 bits is an escape: its word holds its place among the block's escapes, which follow the block's words in full.

A file: MAGIC; blocks of BLOCK ids, one after another over the ends of documents (the last one may be shorter); an Arrow
table of the documents (doc_id, n); the table of blocks (two little-endian 64-bit numbers each: first word, number of
words); a trailer of five such numbers (words of all blocks with escapes, bytes of the document table, blocks, ids, BLOCK) and MAGIC.
"""

from __future__ import annotations

import io
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .kernels import raw, text_parts
from .shared import keep, new_path, open_shared, within_bounds

MAGIC = b"S8BWORD1"
BLOCK = 512
# Fixed values of the coding: how many ids a word of each selector holds, and the bits of each. The last one is the escape.
HOLDS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_ESCAPE = 16
#: Selector numbers are stored in 4 bits: the runs of 240 and 120 zeros share number 0, told apart by the word's low bit.
_STORED = np.array([0, 0, *range(1, 15), 15], np.uint64)
_FROM = np.array([0, *range(2, 16), _ESCAPE])
_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 1 << 18


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, as bytes."""
    if not len(ids) or ids.max() < 1 << 16:
        return _BITS[ids.astype(np.uint16)]
    out = np.zeros(len(ids), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        big = ids >= (np.uint64(1) << np.uint64(shift))
        if big.any():
            out[big] += np.uint8(shift)
            ids = np.where(big, ids >> np.uint64(shift), ids)
    return out + (ids > 0).astype(np.uint8)


def selectors(bits: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each id, the selector of a word that would begin there: the one that holds most ids, all within its block."""
    n = len(bits)
    left = (block - np.arange(n) % block).astype(np.int16)
    left = np.minimum(left, n - np.arange(n))
    out = np.full(n, _ESCAPE, np.uint8)
    out[bits <= 60] = 15
    widest = {1: bits}  # the most bits of the next c ids, built up from smaller counts
    for i in range(14, -1, -1):
        c, w = int(HOLDS[i]), int(WIDTH[i])
        half = max(k for k in widest if k < c)  # at least half of c
        a = widest[half]
        most = np.full(n, 255, np.uint8)
        if n >= c:
            most[: n - c + 1] = np.maximum(a[: n - c + 1], a[c - half : n - half + 1])
        widest[c] = most
        fits = (most <= w) & (left >= c)
        out[fits] = i
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words of each block) of ids as unsigned 64-bit numbers. Blocks are walked side by side."""
    ids = ids.astype(np.uint64)
    n, blocks = len(ids), -(-len(ids) // block)
    chosen = selectors(bit_lengths(ids), block)
    step = np.append(HOLDS, 1)[chosen]
    at, end = np.arange(blocks) * block, np.minimum(np.arange(1, blocks + 1) * block, n)
    places, of, live = [], [], np.arange(blocks)
    while len(live):
        places.append(at[live])
        of.append(live)
        at[live] += step[at[live]]
        live = live[at[live] < end[live]]
    if not places:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place, of = np.concatenate(places), np.concatenate(of)
    order = np.argsort(place)
    place, of = place[order], of[order]
    kind = chosen[place]
    words = _STORED[kind] << np.uint64(60)
    words[kind == 1] |= np.uint64(1)  # 120 zeros
    for s in range(2, 16):
        mine = np.flatnonzero(kind == s)
        if len(mine):
            c, w = int(HOLDS[s]), int(WIDTH[s])
            for j in range(c):
                words[mine] |= ids[place[mine] + j] << np.uint64(j * w)
    size = np.bincount(of, minlength=blocks)
    odd = np.flatnonzero(kind == _ESCAPE)
    if len(odd):  # escapes go behind the words of their block
        own = of[odd]
        first = np.searchsorted(own, own)
        words[odd] |= (np.arange(len(odd)) - first).astype(np.uint64)
        words = np.insert(words, np.cumsum(size)[own], ids[place[odd]])
        size = size + np.bincount(own, minlength=blocks)
    return words, size


def decode(words: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of blocks that have `size` words, escapes included, and `counts` ids each."""
    kind = _FROM[(words >> np.uint64(60)).astype(np.int64)]
    kind = np.where((kind == 0) & ((words & np.uint64(1)) > 0), 1, kind)
    holds = np.append(HOLDS, 1)[kind]
    first_word, ends = np.cumsum(size) - size, np.cumsum(size)
    block = np.repeat(np.arange(len(size)), size)
    before = np.cumsum(holds) - holds
    code = np.ones(len(words), bool)
    if (kind == _ESCAPE).any():  # once all ids of a block are there, the rest of its words are escapes
        into = before - before[first_word[block]]
        code = into < counts[block]
        total = np.cumsum(code) - code
        holds = np.where(code, holds, 0)
        before = np.cumsum(holds) - holds
        escapes = first_word + np.append(total, total[-1] + code[-1])[ends] - total[first_word]
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero((kind == s) & code)
        if len(mine):
            c, w = int(HOLDS[s]), int(WIDTH[s])
            mask = np.uint64((1 << w) - 1)
            for j in range(c):
                out[before[mine] + j] = (words[mine] >> np.uint64(j * w)) & mask
    odd = np.flatnonzero((kind == _ESCAPE) & code)
    if len(odd):
        number = (words[odd] & np.uint64((1 << 60) - 1)).astype(np.int64)
        out[before[odd]] = words[escapes[block[odd]] + number]
    return out


class TokenWriter:
    """Writes one file, block by block; what does not fill a block waits for more."""

    def __init__(self, path: str) -> None:
        self.out, self.held, self.sizes, self.docs, self.ids, self.words = open_shared(path, "wb"), np.zeros(0, np.uint64), [], [], 0, 0
        self.out.write(MAGIC)

    def _write(self, ids: np.ndarray) -> None:
        words, size = encode(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.sizes.append(size)
        self.words += len(words)

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64())], ["doc_id", "n"]))
        self.ids += len(ids)
        ids = np.concatenate([self.held, ids.astype(np.uint64)])
        whole = len(ids) // BLOCK * BLOCK
        self._write(ids[:whole])
        self.held = ids[whole:].copy()

    def close(self) -> int:
        self._write(self.held)
        size = np.concatenate(self.sizes)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, self.docs[0].schema) as table:
            for batch in self.docs:
                table.write_batch(batch)
        self.out.write(sink.getvalue())
        self.out.write(np.stack([np.cumsum(size) - size, size], axis=1).astype("<u8").tobytes())
        self.out.write(np.array([self.words, len(sink.getvalue()), len(size), self.ids, BLOCK], "<u8").tobytes() + MAGIC)
        self.out.close()
        return self.ids


class TokenFile:
    """Reads a file: its documents, and any stretch of its ids by the blocks that hold it."""

    def __init__(self, path: str) -> None:
        self.file = open_shared(path, "rb")
        self.file.seek(0, 2)
        length = self.file.tell()
        self.file.seek(length - 48)
        tail = self.file.read(48)
        if tail[40:] != MAGIC:
            raise ValueError(f"{path} is no whole token file")
        words, table, blocks, self.ids, self.block = np.frombuffer(tail[:40], "<u8").astype(np.int64).tolist()
        self.file.seek(8 + 8 * words)
        self.docs = pa.ipc.open_stream(self.file.read(table)).read_all()
        self.blocks = np.frombuffer(self.file.read(16 * blocks), "<u8").astype(np.int64).reshape(blocks, 2)

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from the one numbered start."""
        if n <= 0:
            return np.zeros(0, np.uint64)
        a, b = start // self.block, -(-(start + n) // self.block)
        size = self.blocks[a:b, 1]
        self.file.seek(8 + 8 * int(self.blocks[a, 0]))
        words = np.frombuffer(self.file.read(8 * int(size.sum())), "<u8").astype(np.uint64)
        counts = np.minimum(self.block, self.ids - np.arange(a, b) * self.block)
        return decode(words, size, counts)[start - a * self.block :][:n]


def _letters(piece: bytes) -> bool:
    """Whether a piece is letters only, also after its normal form and lower case."""
    text = piece.decode()
    return text.isalpha() and unicodedata.is_normalized("NFC", text) and text.lower().isalpha()


class PieceCoder:
    """The ids of whole texts, through the tokenizer's ids of their pieces.

    It is for tokenizers whose normalizer and pre-tokenizer drop white space, keep letters and other signs apart, take digits
    one by one and never look further (`word_bpe_49k`): the ids of a text are then those of its pieces one after another, and a
    piece is encoded once for all its places. Texts are cut at white space, and between ASCII letters, digits and signs where no
    contraction or added token can go over the cut; all else stays together, whatever its length.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        kinds = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 digit, 3 sign, 4 what is never cut at
        for c in range(0x21, 0x7F):
            kinds[c] = 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3
        kinds[[0x20, *range(0x09, 0x0E)]] = 0
        kinds[ord("'")] = 4
        for token in self.tokenizer.get_added_tokens_decoder().values():  # a sign beside a letter of an added token
            for x, y in zip(token.content, token.content[1:], strict=False):
                for sign, other in ((x, y), (y, x)):
                    if ord(sign) < 128 and kinds[ord(sign)] == 3 and other.isalnum():
                        kinds[ord(sign)] = 4
        self.kinds, self.plain = kinds, bytes(np.flatnonzero((kinds > 0) & (kinds < 4)).tolist())
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None  # whether an id ends a word
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        pair = np.zeros((5, 5), bool)
        pair[1:4, 1:4] = ~np.eye(3, dtype=bool)
        pair[2, 2] = True
        pair[0, 1:] = True
        self.begins = pair.reshape(-1)  # by 5 * kind of the byte before + kind
        self.numbers: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers.clear()
        self.flat, self.used, self.start, self.count = np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece). Pieces of one kind are encoded as one text: each ends with the id of a word's end."""
        lone = [i for i, p in enumerate(pieces) if p.translate(None, self.plain) and not _letters(p)] if self.ends is not None else range(len(pieces))
        size = np.zeros(len(pieces), np.int64)
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i].decode() for i in lone], add_special_tokens=False)]
        size[lone] = [len(x) for x in coded]
        if len(lone) < len(pieces):
            rest = np.ones(len(pieces), bool)
            rest[lone] = False
            text = b" ".join(pieces[i] for i in np.flatnonzero(rest).tolist()).decode()
            together = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[together]) + 1
            if len(last) != rest.sum() or last[-1] != len(together):
                raise ValueError("a piece of one kind is not one word of this tokenizer")
            size[rest] = np.diff(last, prepend=0)
        start = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.uint32)
        for i, x in zip(lone, coded, strict=True):
            flat[start[i] : start[i] + len(x)] = x
        if len(lone) < len(pieces):
            flat[np.repeat(rest, size)] = together
        return flat, size

    def _learn(self, pieces: list[bytes]) -> None:
        for a in range(0, len(pieces), 4096):
            part = pieces[a : a + 4096]
            flat, size = self._ids(part)
            known = len(self.numbers)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while known + len(part) > len(self.start):
                self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[known : known + len(part)] = self.used + np.cumsum(size) - size
            self.count[known : known + len(part)] = size
            self.numbers.update(zip(part, range(known, known + len(part)), strict=True))
            self.used += len(flat)

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces of all texts, first piece of each text and the end)."""
        data, offsets = raw(texts)
        kind = self.kinds[data]
        before = np.zeros_like(kind)
        before[1:] = kind[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        before[first] = 0  # a text begins a piece
        starts = np.flatnonzero(self.begins[5 * before + kind])
        inside = kind > 0
        place = np.concatenate([[0], np.cumsum(inside)])  # of a byte among those that are no space
        at = np.append(place[starts], place[-1])
        body = data[inside]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())])
        return pieces, np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text), each text followed by the id `end`."""
        pieces, first = self.pieces(texts)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [p for p in names if p not in self.numbers]
        if len(self.numbers) + len(new) > REMEMBERED or self.used > 8 * REMEMBERED:
            self._forget()
            new = names
        self._learn(new)
        number = np.array([self.numbers[p] for p in names], np.int64)
        piece = number[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        size = self.count[piece]
        total = np.concatenate([[0], np.cumsum(size)])
        counts = total[first[1:]] - total[first[:-1]]
        at = np.arange(total[-1]) + np.repeat(self.start[piece] - total[:-1], size)
        ids = self.flat[at]
        if end is not None:
            ids = np.insert(ids, total[first[1:]], end)
            counts = counts + 1
        return ids, counts


_coders: dict[str, PieceCoder] = {}


def coder_of(path: str) -> PieceCoder:
    """The coder of a worker, which goes on with what it has learnt in earlier tasks."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


@within_bounds
def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end: int | None = 1,
) -> DataFrame:
    """Writes the ids of all texts to files of `folder`, in ascending order of doc_id, and gives a row for each file: file
    (its number in order), path, docs, ids, start (ids of all files before it).

    Documents are dealt by ranges of doc_id; of equal ids, those of a larger hash of the text come later, so that no id makes
    one range hot. Null ids come first. Null texts are empty: such a document has the end id only. A task streams its range
    through one file; a lost task writes another one, and only the file of the task that ended well is listed.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out, path, n = coder_of(tokenizer), None, f"{folder}/{uuid.uuid4().hex}.s8b", 0
        for whole in batches:
            for batch in text_parts(whole, most=1 << 21):
                if out is None:
                    out = TokenWriter(path)
                ids, counts = coder.encode(batch.column("text"), end)
                out.add(batch.column("doc_id"), counts, ids)
                n += batch.num_rows
        if out is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([n], pa.int64()), pa.array([out.close()], pa.int64())], ["file", "path", "docs", "ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "text")
    files = keep(dealt.mapInArrow(write, "file long, path string, docs long, ids long"), "token_files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))
    return keep(files, "token_manifest")


def read_tokens(files: DataFrame, kind: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files, one task a file; files come from write_tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = TokenFile(path)
                before = 0
                for part in file.docs.to_batches(max_chunksize=4096):
                    counts = part.column("n").to_numpy()
                    starts = before + np.cumsum(counts) - counts
                    digests = np.zeros(len(counts), np.int64)
                    a = 0
                    while a < len(counts):  # about 4 MB of ids at once
                        b = max(a + 1, int(np.searchsorted(starts, starts[a] + (1 << 20))))
                        raw = file.read(int(starts[a]), int(starts[b - 1] + counts[b - 1] - starts[a])).astype("<u4")
                        for i in range(a, b):
                            digests[i] = zlib.crc32(raw[starts[i] - starts[a] :][: counts[i]])
                        a = b
                    before += int(counts.sum())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base + starts), pa.array(counts), pa.array(digests)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    spread = files.select("file", "path", "start").repartitionByRange(n, "file")
    return spread.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int | None = 1) -> DataFrame:
    """One row a document, from the files that write_tokens made of all of them: doc_id, start (ids of all documents
    before it), n_tokens (with the end id), ids_crc32 (of its ids as little-endian unsigned 32-bit integers).

    Rows that repeat a doc_id are documents each. An empty table gives no file and no row. Other columns are ignored.
    """
    files = write_tokens(docs, tokenizer, new_path(docs.sparkSession, "tokens"), doc_id, text, end)
    return read_tokens(files, dict(docs.dtypes)[doc_id])


def read_documents(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, ids): the ids of each document, for training input."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file, at = TokenFile(path), 0
                for part in file.docs.to_batches(max_chunksize=256):
                    counts = part.column("n").to_numpy()
                    ids = file.read(at, int(counts.sum()))
                    at += int(counts.sum())
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])

    return files.select("file", "path").repartitionByRange(max(1, files.count()), "file").mapInArrow(read, f"doc_id {kind}, ids array<long>")
