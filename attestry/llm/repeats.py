"""Suffix-array dedup: passages that repeat across documents, by a sparse suffix array sorted in Spark.

Suffixes are kept at minimiser positions: of each WINDOW consecutive grams the smallest hash. Two documents that share a
passage of LEAST words keep the same positions inside it, and the first of them has at least SURE words of the passage
behind it. So a suffix whose first SURE words occur in another document marks a repeat, and chains of such suffixes
cover it up to less than WINDOW words at both ends. A chain may begin or end with a suffix that a third document shares
but the passage's partner does not keep, so every suffix within WINDOW words of an end is extended: they are sorted by
what precedes and what follows them and compared with their neighbours.

Texts are never shuffled. Three passes read them: the first sends the keys of the suffixes, the second finds the hits,
the third what stands around those that must be extended. The keys that a pass looks for are sorted arrays in the
shared folder, which the workers map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .kernels import mix, powers, text_parts, words
from .mapped import KeyFiles, key_files
from .shared import keep, text_or_empty, within_bounds

#: Least words of a passage that must be found; words of a gram; grams of a window.
LEAST, GRAM, WINDOW = 50, 20, 16
#: Words behind the first kept position of each such passage.
SURE = LEAST - WINDOW + 1
#: Suffixes that a task sorts.
SORTED_ROWS = 200_000


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def kept_positions(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the flat array, key) of the minimisers of each row that have SURE words behind them."""
    g = run_hashes(h, GRAM)
    if len(g) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    span = WINDOW + GRAM - 1
    whole = row[: len(h) - span + 1] == row[span - 1 :]
    views = np.lib.stride_tricks.sliding_window_view(mix(g, 31), WINDOW)
    at = np.unique((np.flatnonzero(whole) + views.argmin(axis=1)[whole]))
    at = at[at + SURE <= first[row[at] + 1]]
    return row[at], at, run_hashes(h, SURE)[at].view(np.int64) if len(at) else at


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.withColumn("node", F.xxhash64("doc_id", "text"))


def kept_keys(rows: DataFrame) -> DataFrame:
    """(node, key): the hash of the first SURE words of each kept suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_parts(whole):
                h, first, _, _ = words(batch.column("text"))
                row, _, key = kept_positions(h, first)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("node").to_numpy()[row]), pa.array(key)], ["node", "key"])

    return rows.select("node", "text").mapInArrow(run, "node long, key long")


def hits_of(h: np.ndarray, first: np.ndarray, node: np.ndarray, shared: KeyFiles) -> dict[str, np.ndarray]:
    """The kept suffixes that other documents have too: row, at, key, stays (whether this is the node that keeps it),
    and start and last, the first and the last of its run, whose hits' first SURE words touch."""
    row, at, key = kept_positions(h, first)
    hit, number = shared.look_up(key)
    row, at, key, number = row[hit], at[hit], key[hit], number[hit]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + SURE)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    start, last = np.repeat(at[begin], size), np.repeat(at[begin + size - 1] if len(begin) else at, size)
    return {"row": row, "at": at, "key": key, "stays": number == node[row], "start": start, "last": last}


def hits(rows: DataFrame, shared: KeyFiles) -> DataFrame:
    """(doc_id, node, pos, key, stays, start, last): all hits; positions count words of the document."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_parts(whole):
                h, first, _, _ = words(batch.column("text"))
                node = batch.column("node").to_numpy()
                x = hits_of(h, first, node, shared)
                base = first[x["row"]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(x["row"])), pa.array(node[x["row"]]), pa.array(x["at"] - base), pa.array(x["key"]),
                     pa.array(x["stays"]), pa.array(x["start"] - base), pa.array(x["last"] - base)],
                    ["doc_id", "node", "pos", "key", "stays", "start", "last"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, node long, pos long, key long, stays boolean, start long, last long")


def contexts(rows: DataFrame, ends: KeyFiles) -> DataFrame:
    """(node, pos, key, left, right) of each kept suffix whose key is in ends: up to WINDOW words before it, backwards,
    and as many after its SURE words.

    A word is 4 bytes, so contexts sort as the words do, and equal bytes are equal words; 0 stands where a text ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_parts(whole):
                h, first, _, _ = words(batch.column("text"))
                row, at, key = kept_positions(h, first)
                hit, _ = ends.look_up(key)
                row, at, key = row[hit], at[hit], key[hit]
                if not len(at):
                    continue
                short = np.append(np.maximum(h >> np.uint64(32), np.uint64(1)).astype(">u4"), np.zeros(1, ">u4"))
                step = np.arange(WINDOW)
                before, after = at[:, None] - 1 - step, at[:, None] + SURE + step
                sides = []
                for spot, good in ((before, before >= first[row][:, None]), (after, after < first[row + 1][:, None])):
                    data = short[np.where(good, spot, len(h))].tobytes()
                    offsets = np.arange(len(at) + 1, dtype=np.int32) * (4 * WINDOW)
                    sides.append(pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("node").to_numpy()[row]), pa.array(at - first[row]), pa.array(key), *sides], ["node", "pos", "key", "left", "right"]
                )

    return rows.select("node", "text").mapInArrow(run, "node long, pos long, key long, left binary, right binary")


def common_words(keys: np.ndarray, nodes: np.ndarray, words_of: np.ndarray) -> np.ndarray:
    """For suffixes sorted by key and words, the most words that each shares with the nearest other document's on either
    side, as rows of WINDOW words, 0 where a text ends."""
    n = len(keys)
    best = np.zeros(n, np.int64)
    for back in (True, False):
        k, d, w = (keys, nodes, words_of) if back else (keys[::-1], nodes[::-1], words_of[::-1])
        new = np.ones(n, bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        held = np.maximum.accumulate(np.where(new, np.arange(n), 0)) - 1  # the last suffix of the run before
        some = np.flatnonzero((held >= 0) & (k[held] == k))
        same = (w[some] == w[held[some]]) & (w[some] != 0)
        more = np.zeros(n, np.int64)
        more[some] = np.minimum.accumulate(same, axis=1).sum(axis=1)
        best = np.maximum(best, more if back else more[::-1])
    return best


def extensions(found: DataFrame, side: str) -> DataFrame:
    """(node, pos, more): how many words the match of a suffix goes on at a side, from its neighbours in sorted order.

    The suffixes are sorted over all partitions. Those at the edges of partitions, which are at either end the rows up to the
    first that another document or key has, are compared once more with the edges that they stand next to: the last rows of a
    partition with the first ones of the next that has another document or key.
    """

    def run(batches: Iterator[pa.RecordBatch], edges: bool = True) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        keys, nodes = table["key"].to_numpy(), table["node"].to_numpy()
        data = b"".join(x.as_buffer().to_pybytes() for x in table[side])
        more = common_words(keys, nodes, np.frombuffer(data, ">u4").reshape(len(keys), WINDOW))
        head, tail = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        solid = False
        if edges:
            other = (keys != keys[0]) | (nodes != nodes[0])
            solid = not other.any()
            head[: len(keys) if solid else int(other.argmax()) + 1] = True
            other = (keys != keys[-1]) | (nodes != nodes[-1])
            tail[0 if solid else int(np.flatnonzero(other)[-1]) :] = True
        kept = pa.array(head | tail)
        batch = pa.table({
            "node": table["node"], "pos": table["pos"], "more": pa.array(more), "key": table["key"],
            side: pc.if_else(kept, table[side].combine_chunks(), pa.scalar(None, pa.binary())), "head": pa.array(head), "tail": pa.array(tail),
            "part": pa.array(np.full(len(keys), TaskContext.get().partitionId())), "solid": pa.array(np.full(len(keys), solid)),
        })
        yield from batch.combine_chunks().to_batches(max_chunksize=50_000)

    ddl = f"node long, pos long, more long, key long, {side} binary, head boolean, tail boolean, part long, solid boolean"
    parts = max(4, found.count() // SORTED_ROWS)
    dealt = found.select("node", "pos", "key", side).repartitionByRange(parts, "key", side, "node").sortWithinPartitions("key", side, "node")
    done = keep(dealt.mapInArrow(run, ddl), "sorted")
    # border b stands between the partitions b and b + 1; a partition that is empty or of one document and key joins its borders
    borders = done.where("not solid").select("part").distinct().withColumn("new", F.lit(1))
    borders = found.sparkSession.range(-1, parts).join(F.broadcast(borders), F.col("id") == F.col("part"), "left")
    group = F.coalesce(F.sum("new").over(Window.orderBy("id")), F.lit(0))
    borders = borders.select(F.col("id").alias("border"), group.alias("group"))
    sides = F.explode(F.array_compact(F.array(F.when(F.col("head"), F.col("part") - 1), F.when(F.col("tail"), F.col("part")))))
    edges = done.where("head or tail").select("node", "pos", "key", side, sides.alias("border")).join(F.broadcast(borders), "border")
    edges = edges.repartition("group").sortWithinPartitions("group", "key", side, "node").select("node", "pos", "key", side)
    again = edges.mapInArrow(lambda batches: run(batches, False), ddl)
    return done.select("node", "pos", "more").unionByName(again.select("node", "pos", "more")).groupBy("node", "pos").agg(F.max("more").alias("more"))


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, number, n) of the suffixes that several documents have: number is the least of their nodes, n the rows."""
    counts = kept_keys(rows).groupBy("key").agg(F.min("node").alias("number"), F.max("node").alias("hi"), F.count("*").alias("n"))
    return keep(counts.where("number < hi").drop("hi"), "shared")


@within_bounds
def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each repeated passage of a document: doc_id, start_word, end_word (exclusive), n_words, stays.

    Every passage of LEAST words or more that another document has too lies in a row of each of its documents. A row
    is a union of stretches of at least SURE words that each occur in another document, and has LEAST words or more.
    stays: of the documents that share any of the row's stretches this is the one that keeps it, which is that with the
    least hash of doc_id and text; every stretch stays in one document (drop_repeated_passages).
    Words are compared with A-Z lower-cased, over whole texts. Null or short texts have no rows. Rows that repeat
    doc_id and text are one document and do not repeat each other; those that share only a doc_id are documents of
    their own. An empty table gives an empty result; other columns are ignored.
    """
    rows = _texts(docs, doc_id, text)
    shared = shared_keys(rows)
    found = keep(hits(rows, key_files(shared)).distinct(), "hits")
    edges = found.where((F.col("pos") < F.col("start") + WINDOW) | (F.col("pos") > F.col("last") - WINDOW))
    ends = edges.select("key").distinct().select("key", F.lit(0).cast("long").alias("number"))
    around = keep(contexts(rows, key_files(ends)).distinct(), "contexts")
    left = extensions(around, "left").withColumnRenamed("more", "before")
    right = extensions(around, "right").withColumnRenamed("more", "after")
    ways = edges.select("node", "pos", "start", "last").join(left, ["node", "pos"], "left").join(right, ["node", "pos"], "left")
    ways = ways.groupBy("node", "start", "last").agg(
        F.min(F.col("pos") - F.coalesce("before", F.lit(0))).alias("start_word"), F.max(F.col("pos") + SURE + F.coalesce("after", F.lit(0))).alias("end_word")
    )
    runs = found.groupBy("doc_id", "node", "start", "last").agg(F.min("stays").alias("stays"))
    out = runs.join(ways, ["node", "start", "last"]).where(F.col("end_word") - F.col("start_word") >= LEAST)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "stays")


@within_bounds
def drop_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the words of repeated stretches cut from all texts but one.

    A stretch is the SURE words from a kept suffix on. It stays in the document with the least hash of doc_id and text
    of those that have it, but for words that it shares with a stretch that stays elsewhere. What stands between the
    words that are left stays as it is. Null texts stay null; rows that repeat doc_id and text are cut alike.
    """
    shared = key_files(shared_keys(_texts(docs, doc_id, text)))

    @F.pandas_udf("string")
    def cut(nodes: pd.Series, texts: pd.Series) -> pd.Series:
        whole = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], ["node", "text"])
        out: list[str | None] = []
        for batch in text_parts(whole):
            h, first, start, end = words(batch.column("text"))
            x = hits_of(h, first, batch.column("node").to_numpy(), shared)
            gone = np.zeros(len(h) + 1, np.int64)
            np.add.at(gone, x["at"][~x["stays"]], 1)
            np.add.at(gone, x["at"][~x["stays"]] + SURE, -1)
            gone = np.cumsum(gone[:-1]) > 0
            base = 0
            for r, said in enumerate(batch.column("text").to_pylist()):
                data = (said or "").encode()
                own = slice(int(first[r]), int(first[r + 1]))
                if gone[own].any():
                    left = np.ones(len(data), bool)
                    for a, b in zip((start[own] - base)[gone[own]].tolist(), (end[own] - base)[gone[own]].tolist(), strict=True):
                        left[a:b] = False
                    said = np.frombuffer(data, np.uint8)[left].tobytes().decode()
                base += len(data)
                out.append(said)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, cut(F.xxhash64(F.col(doc_id), text_or_empty(text)), F.col(text)))
