"""Language model: interpolated modified Kneser-Ney bigrams, counted in Spark and kept as sorted hash arrays.

Counting tasks send sorted, packed counts to buckets of the hash; a bucket is one shard of the model, written to the
shared folder. Workers map the shards into memory and look words up by binary search. A bigram is the upper halves of
two word hashes, scrambled by an invertible product, so a frequent context is spread over all shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import text_parts, words
from .mapped import pack, unpack
from .shared import bucket_of, keep, map_file, new_path, open_shared, text_or_empty, within_bounds

#: Hashes of the end of a text, which is a token, and of its start, which is only a context.
END, START = np.uint64(0x5DEECE66D1CE4E5B), np.uint64(0x9E3779B97F4A7C15)
_R = 0xD1B54A32D192ED03
_R_INV = pow(_R, -1, 1 << 64)
#: Tokens that a task counts before it sends them on, and tokens of the input for each shard.
TASK_TOKENS, SHARD_TOKENS = 3_000_000, 4_000_000
_HALF = np.uint64(32)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of the one before, first token of each row and the end); each row ends with END."""
    h, first, _, _ = words(column)
    rows = len(first) - 1
    out = np.full(len(h) + rows, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(first))] = h
    at = first + np.arange(rows + 1)
    before = np.full(len(out), START, np.uint64)
    before[1:] = out[:-1]
    before[at[:-1]] = START
    return out, before, at


def bigrams(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    return ((before >> _HALF << _HALF) | (h >> _HALF)) * np.uint64(_R)


def halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) of scrambled bigrams, as 32-bit hashes."""
    key = key * np.uint64(_R_INV)
    return (key >> _HALF).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the upper half of a hash, so that the shards of sorted keys are stretches."""
    top = key >> _HALF if key.dtype == np.uint64 else key.astype(np.uint64)
    return (top * np.uint64(shards) >> _HALF).astype(np.int64)


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns added up by the first one, sorted by it."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    key = columns[0][order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [key[at], *[np.add.reduceat(c[order], at) if len(at) else c for c in columns[1:]]]


def of_counts(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((c == i).sum()) for i in range(1, 5)]


def write_arrays(folder: str, arrays: list[np.ndarray]) -> str:
    path = f"{folder}/{uuid.uuid4().hex}.arrays"
    with open_shared(path, "wb") as out:
        for a in arrays:
            out.write(a.tobytes())
    return path


def map_arrays(path: str, n: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a shard, mapped into memory."""
    if n == 0:
        return [np.zeros(0, k) for k in kinds]
    data, out, at = map_file(path), [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(data[at : at + size].view(k))
        at += size
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return tuple(float(np.clip(d, 0.05, i + 0.95)) for i, d in enumerate(raw))  # type: ignore[return-value]


def discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


_GRAM, _WORD, _STATE = ("u8", "u4"), ("u8", "u8"), ("u4", "u8", "u4", "u4", "u4", "u4")


@dataclass
class Model:
    """Paths and sizes of the shards, and the few numbers that all lookups share."""

    grams: list[tuple[str, int]]
    words: list[tuple[str, int]]
    states: list[tuple[str, int]]
    tokens: int
    vocabulary: int
    continuations: int
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    below: float  # weight of the uniform distribution under the continuation counts

    def open(self) -> Lookup:
        return Lookup(self)


class Lookup:
    """The model as a worker sees it."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.maps: dict[tuple[str, int], list[np.ndarray]] = {}

    def _find(self, name: str, kinds: tuple[str, ...], keys: np.ndarray) -> list[np.ndarray]:
        """The columns behind sorted keys; 0 for keys that are not there."""
        shards = getattr(self.model, name)
        out = [np.zeros(len(keys), k) for k in kinds[1:]]
        edges = np.searchsorted(shard_of(keys, len(shards)), np.arange(len(shards) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            path, n = shards[s]
            if not n:
                continue
            if (name, s) not in self.maps:
                self.maps[name, s] = map_arrays(path, n, kinds)
            have = self.maps[name, s]
            q = keys[edges[s] : edges[s + 1]]
            at = np.minimum(np.searchsorted(have[0], q), n - 1)
            hit = have[0][at] == q
            for o, column in zip(out, have[1:], strict=True):
                o[edges[s] : edges[s + 1]] = np.where(hit, column[at], 0)
        return out

    def scores(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, base log10 probability, model's log10 probability) of each token."""
        m = self.model
        u, inverse = np.unique(h, return_inverse=True)
        (c,) = self._find("words", _WORD, u)
        base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
        low, low_at = np.unique((h >> _HALF).astype(np.uint32), return_inverse=True)
        cont = self._find("states", _STATE, low)[4].astype(float)
        p1 = np.maximum(cont - discount(cont, m.d1), 0) / max(1, m.continuations) + m.below / (m.vocabulary + 1)
        ctx, ctx_at = np.unique((before >> _HALF).astype(np.uint32), return_inverse=True)
        total, n1, n2, n3, _ = self._find("states", _STATE, ctx)
        back = np.where(total > 0, (m.d2[0] * n1 + m.d2[1] * n2 + m.d2[2] * n3) / np.maximum(total, 1), 1.0)
        g, g_at = np.unique(bigrams(h, before), return_inverse=True)
        (cg,) = self._find("grams", _GRAM, g)
        top = np.maximum(cg - discount(cg, m.d2), 0)
        p = top[g_at] / np.maximum(total, 1)[ctx_at] + back[ctx_at] * p1[low_at]
        return c[inverse], base[inverse], np.log10(p)


def train(rows: DataFrame, total_bytes: int, folder: str) -> Model:
    """Counts the bigrams and words of all rows and writes the shards of the model."""
    shards = max(4, total_bytes // 6 // SHARD_TOKENS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                key, c = np.unique(np.concatenate([x[kind] for x in held]), return_counts=True)
                edges = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(edges))
                blobs = [pack(key[edges[s] : edges[s + 1]], c[edges[s] : edges[s + 1]]) for s in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), kind)), pa.array(some), pa.array(blobs, pa.binary())], ["kind", "shard", "data"]
                )
            held.clear()

        size = 0
        for whole in batches:
            for batch in text_parts(whole):
                h, before, _ = tokens(batch.column("text"))
                held.append([bigrams(h, before), h])
                size += len(h)
                if size > TASK_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def shard(part: pa.Table) -> pa.Table:
        kind, no = part["kind"][0].as_py(), part["shard"][0].as_py()
        key, c = merged([unpack(x.as_py()) for x in part["data"]])
        path = write_arrays(folder, [key, c.astype(np.uint32 if kind == 0 else np.uint64)])
        rows = [{"kind": kind, "shard": no, "path": path, "n": len(key), "total": int(c.sum()), "counts": of_counts(c), "data": None}]
        if kind == 0:
            left, right = halves(key)
            order = np.argsort(left, kind="stable")
            ctx, cl = left[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            add = lambda x: np.add.reduceat(x.astype(np.uint64), at)
            zero = np.zeros(len(at), np.uint64)
            contexts = [ctx[at].astype(np.uint64), add(cl), add(cl == 1), add(cl == 2), add(cl > 2), zero]
            w, n = np.unique(right, return_counts=True)
            zeros = np.zeros(len(w), np.uint64)
            state = merged([contexts, [w.astype(np.uint64), zeros, zeros, zeros, zeros, n.astype(np.uint64)]])
            edges = np.searchsorted(shard_of(state[0].astype(np.uint32), shards), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                data = pack(*[x[edges[s] : edges[s + 1]] for x in state])
                rows.append({"kind": 2, "shard": s, "path": None, "n": 0, "total": 0, "counts": None, "data": data})
        return pa.Table.from_pylist(rows, schema)

    def states(part: pa.Table) -> pa.Table:
        columns = merged([unpack(x.as_py()) for x in part["data"]])
        path = write_arrays(folder, [x.astype(k) for x, k in zip(columns, _STATE, strict=True)])
        cont = columns[-1]
        used = cont[cont > 0]
        row = {"kind": 2, "shard": part["shard"][0].as_py(), "path": path, "n": len(cont), "total": int(used.sum()), "counts": [*of_counts(used), len(used)], "data": None}
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema([("kind", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("counts", pa.list_(pa.int64())), ("data", pa.binary())])
    ddl = "kind long, shard long, path string, n long, total long, counts array<long>, data binary"
    sent = rows.select("text").mapInArrow(count, "kind long, shard long, data binary")
    first = keep(sent.groupBy("kind", "shard").applyInArrow(shard, ddl), "shards")
    second = keep(first.where("kind = 2").select("kind", "shard", "data").groupBy("shard").applyInArrow(states, ddl), "states")
    # one row a shard: paths and sizes, no counts of words
    found = first.where("kind < 2").drop("data").unionByName(second.drop("data")).collect()
    place = {(r["kind"], r["shard"]): (r["path"], r["n"]) for r in found}
    lists = [[place.get((k, s), ("", 0)) for s in range(shards)] for k in range(3)]
    sums = [np.sum([r["counts"][:4] for r in found if r["kind"] == k] or [[0] * 4], axis=0).tolist() for k in range(3)]
    used = sum(r["counts"][4] for r in found if r["kind"] == 2)
    d1 = discounts(sums[2])
    cont = sum(r["total"] for r in found if r["kind"] == 2)
    more = used - sum(sums[2][:2])
    below = (d1[0] * sums[2][0] + d1[1] * sums[2][1] + d1[2] * more) / cont if cont else 1.0
    return Model(
        *lists, tokens=sum(r["total"] for r in found if r["kind"] == 1), vocabulary=sum(r["n"] for r in found if r["kind"] == 1),
        continuations=cont, d2=discounts(sums[0]), d1=d1, below=below,
    )


def language_model(rows: DataFrame, folder: str | None = None) -> Model:
    """A model of all texts of rows (column text, not null)."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return train(rows, size, folder or new_path(rows.sparkSession, "lm"))


@within_bounds
def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, held_out: int = 0) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from all documents whose crc32(doc_id as text) mod folds is not held_out, a null doc_id among them,
    and scores every whole text. Null counts as empty: one token, the end. Rows that repeat a doc_id are scored each
    for itself. With no training text all words are unknown and the model is uniform. An empty table gives an empty
    result; other columns are ignored.
    """
    kind = dict(docs.dtypes)[doc_id]
    aside = F.coalesce(bucket_of(F.col(doc_id), "", folds) == held_out, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), aside.alias("held_out"), text_or_empty(text).alias("text"))
    model = language_model(rows.where(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value.open()
        for whole in batches:
            for batch in text_parts(whole, most=1 << 23):
                h, before, at = tokens(batch.column("text"))
                c, base, score = lookup.scores(h, before)
                add = lambda x, at=at: np.add.reduceat(x, at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at)), pa.array(add((c > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(score))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
