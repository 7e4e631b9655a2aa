"""Toxicity: obfuscated words are decoded through a noisy channel, then the restored text is scored.

A word written with digits, signs, spacing or repeated letters becomes a lattice of readings for each character; the
Viterbi path under a character trigram model, counted over all documents, is its restored form. The score comes from
weights of words and word beginnings, learnt from labelled documents in a hashed table of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import mix, raw, runs, span_hashes, text_parts
from .shared import bucket_of, keep, text_or_empty, within_bounds

# What a written character may stand for, besides itself if it is a letter.
READINGS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "+": "t", "|": "il", "(": "c",
}
SEPARATORS = " .-_*"
#: Costs, as log-probabilities, of a changed character, a dropped separator and a dropped repetition.
CHANGED, DROPPED, REPEATED = -1.0, -0.1, -0.5
#: Hashed features; rows of the prior that each feature's counts are joined with; longest stretch that is remembered.
BUCKETS, PRIOR_ROWS, LONGEST = 1 << 22, 10.0, 40
PREFIXES = (4, 5)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WORDLIKE = _LETTER.copy()
_WORDLIKE[0x80:] = True
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in READINGS]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ",.;:!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def letter_model(rows: DataFrame) -> np.ndarray:
    """Log-probabilities of a letter after two others; 0 stands for all that is no letter. All texts are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for whole in batches:
            for batch in text_parts(whole):
                c = _CODE[raw(batch.column("text"))[0]]
                if len(c) > 2:
                    total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(total[t])], ["t", "n"])

    found = rows.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(27**3)
    n[found["t"].to_numpy()] = found["n"].to_numpy()
    n = n.reshape(27, 27, 27)
    two = n.sum(0)  # letter after one other, as the prior of the trigram
    prior = (two + 0.5) / (two.sum(-1, keepdims=True) + 0.5 * 27)
    return np.log((n + 5 * prior[None]) / (n.sum(-1, keepdims=True) + 5))


def decode(written: str, model: np.ndarray, breaks: bool = False) -> str:
    """The most likely word behind a written one: Viterbi over (last two letters), one lattice column a character.

    A path is a chain of (chain before, letter), so time and memory grow with the length only. With `breaks` a separator
    may also end a word, and the words are parted by spaces.
    """
    if breaks:
        model = model.copy()
        model[0, 0] = np.log(np.exp(model[:, 0]).mean(0))
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ch in written.lower():
        column: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(state: tuple[int, int], value: float, said: tuple | None, column=column) -> None:
            if state not in column or value > column[state][0]:
                column[state] = (value, said)

        letters = [(c, CHANGED) for c in READINGS.get(ch, "")] + ([(ch, 0.0)] if "a" <= ch <= "z" else [])
        for (a, b), (value, said) in best.items():
            for c, cost in letters:
                code = ord(c) - 96
                offer((b, code), value + cost + model[a, b, code], (said, c))
                if code == b:
                    offer((a, b), value + REPEATED, said)
            if ch in SEPARATORS or ch == "!" or not letters:  # an exclamation mark may be just that
                offer((a, b), value + DROPPED, said)
            if breaks and b and ch in SEPARATORS:
                for state in ((b, 0), (0, 0)):  # a word begins after this one or after any
                    offer(state, value + model[a, b, 0], (said, " "))
        best = column
    _, said = max(((v + (model[a, b, 0] if b else 0.0), s) for (a, b), (v, s) in best.items()), key=lambda x: x[0])
    out = []
    while said:
        said, c = said
        out.append(c)
    return "".join(reversed(out))


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the stretches that may hide a word: signs beside letters, letters thrice, letters apart."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < 3:
        return empty, empty, empty
    first, start, end = runs(data, offsets, ~_BLANK[data])
    small = data | np.where(_LETTER[data], 0x20, 0).astype(np.uint8)
    mark = np.zeros(n, bool)
    mark[:-1] |= _LEET[data[:-1]] & _LETTER[data[1:]]
    inside = np.ones(n, bool)
    inside[start] = False
    mark[1:] |= _LETTER[data[:-1]] & (_LEET & ~_END)[data[1:]] & inside[1:]
    mark[2:] |= (small[2:] == small[1:-1]) & (small[1:-1] == small[:-2]) & _LETTER[data[2:]]
    apart = np.zeros(n, bool)
    apart[1:-1] = _SEPARATOR[data[1:-1]] & (_LETTER | _LEET)[data[:-2]] & (_LETTER | _LEET)[data[2:]]
    sums = np.zeros((2, n + 1), np.int64)
    np.cumsum(mark, out=sums[0, 1:])
    np.cumsum(apart & ~_BLANK[data], out=sums[1, 1:])
    size = end - start
    odd = (sums[0, end] > sums[0, start]) | (2 * (sums[1, end] - sums[1, start]) + 1 >= size) & (size >= 7)
    row = np.searchsorted(first, np.arange(len(start)), "right") - 1
    # four or more single letters in a row
    single = ((size == 1) | (size == 2) & _END[data[end - 1]]) & (_LETTER | _LEET)[data[start]]
    near = np.zeros(len(start), bool)
    near[1:] = (start[1:] - end[:-1] <= 2) & (row[1:] == row[:-1])
    head = single & ~(near & np.concatenate([[False], single[:-1]]))
    group = np.cumsum(head)[single]
    at = np.flatnonzero(single)
    _, a, count = np.unique(group, return_index=True, return_counts=True)
    long = count >= 4
    s, e = start[at[a[long]]], end[at[a[long] + count[long] - 1]]
    # the first letter may be a word of its own, so the rest is read without it too
    rest = count[long] > 4
    own, later = row[at[a[long]]], start[at[a[long][rest] + 1]]
    return (
        np.concatenate([row[odd], own, own[rest]]), np.concatenate([start[odd], s, later]), np.concatenate([end[odd], e, e[rest]])
    )


def features(column: pa.Array, model: np.ndarray, memo: dict[bytes, str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct features of each text and of its restored words, sorted."""
    data, offsets = raw(column)
    row, start, end = suspects(data, offsets)
    held, of = [], []
    for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
        written = data[a:b].tobytes()
        said = memo.get(written)
        if said is None:
            said = decode(written.decode("utf-8", "ignore"), model)
            if b - a <= LONGEST:
                if len(memo) > 200_000:
                    memo.clear()
                memo[written] = said
        # a spelled run may be several words
        parted = decode(written.decode("utf-8", "ignore"), model, True) if _SEPARATOR[data[a:b]].any() else ""
        for found in {said, parted}:
            if len(found) > 2:
                held.append(found)
                of.append(r)
    rows, buckets = [], []
    for source, at, owner in ((data, offsets, None), (*raw(pa.array(held, pa.string())), np.array(of, np.int64))):
        if not len(source):
            continue
        first, a, b = runs(source, at, _WORDLIKE[source])
        own = np.searchsorted(first, np.arange(len(a)), "right") - 1
        own = own if owner is None else owner[own]
        value = span_hashes(source)
        for k, size in enumerate((None, *PREFIXES)):
            some = slice(None) if size is None else b - a > size
            h = value(a[some], b[some] if size is None else a[some] + size)
            rows.append(own[some])
            buckets.append((mix(h, 20 + k) >> np.uint64(42)).astype(np.int64))
    key = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets)) if rows else np.zeros(0, np.int64)
    return key // BUCKETS, key % BUCKETS


def feature_weights(labelled: DataFrame, model: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-odds of each bucket against the prior, and the prior; counts are added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, str] = {}
        for whole in batches:
            for batch in text_parts(whole):
                row, bucket = features(batch.column("text"), model, memo)
                y = batch.column("label").to_numpy()[row]
                b, inverse = np.unique(bucket, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b), pa.array(np.bincount(inverse, y == 0, len(b)).astype(np.int64)), pa.array(np.bincount(inverse, y == 1, len(b)).astype(np.int64))],
                    ["b", "n0", "n1"],
                )

    counts = labelled.select("text", "label").mapInArrow(run, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = counts.toArrow()
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    n0, n1 = found["n0"].to_numpy(), found["n1"].to_numpy()
    p = (n1 + PRIOR_ROWS * prior) / (n0 + n1 + PRIOR_ROWS)
    w = np.zeros(BUCKETS, np.float32)
    w[found["b"].to_numpy()] = np.log(p / (1 - p)) - math.log(prior / (1 - prior))
    return w, prior


def evidence(row: np.ndarray, bucket: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """The largest weight of each row and half the second largest; 0 where there is none above 0."""
    w = weights[bucket]
    out = np.zeros(rows)
    for share in (1.0, 0.5):
        top = np.zeros(rows)
        np.maximum.at(top, row, w)
        out += share * top
        peak = np.flatnonzero((w == top[row]) & (w > 0))
        _, once = np.unique(row[peak], return_index=True)
        w = w.copy()
        w[peak[once]] = 0
    return out


@within_bounds
def toxicity_scores(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    folds: int = 5, held_out: int = 0, most_labels: int = 100_000,
) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted.

    Weights are fitted on most_labels labelled ids at most, those with the least hashes; the letter model counts all rows.

    Labels are learnt only from rows whose crc32(doc_id as text) mod folds is not held_out; a document with several
    labels takes the largest. Only the text is used for a score; null counts as empty, and an empty text has the lowest
    score. Rows that repeat a doc_id are scored each for itself. A null doc_id is never labelled or held out. Without
    labels all scores are the prior, below 0.5. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    model = letter_model(rows)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("long").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(bucket_of(F.col("doc_id"), "", folds) != held_out)
    # bounded by most_labels, so these rows can be broadcast at any size and the texts are never shuffled
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    labelled = keep(rows.join(F.broadcast(known), "doc_id"), "labelled")
    weights, _ = feature_weights(labelled, model)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, str] = {}
        for whole in batches:
            for batch in text_parts(whole):
                row, bucket = features(batch.column("text"), model, memo)
                z = evidence(row, bucket, shared.value, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(z)], ["doc_id", "label", "z"])

    kind = dict(docs.dtypes)[doc_id]
    # where the classes part: counts of the evidence of labelled documents, in steps of 0.1
    seen = labelled.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, label long, z double")
    steps = seen.groupBy(F.floor(F.col("z") * 10).alias("step"), "label").agg(F.count("*").alias("n")).collect()
    cut = best_cut({(r["step"], r["label"]): r["n"] for r in steps})
    out = rows.withColumn("label", F.lit(0).cast("long")).mapInArrow(run, f"doc_id {kind}, label long, z double")
    score = 1 / (1 + F.exp(F.lit(cut) - F.col("z")))
    return out.select(
        "doc_id", F.coalesce(bucket_of(F.col("doc_id"), "", folds) == held_out, F.lit(False)).alias("held_out"),
        score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
    )


def best_cut(counts: dict[tuple[int, int], int]) -> float:
    """The evidence at which the fewest labelled rows stand on the wrong side; the middle of the best stretch."""
    steps = sorted({s for s, _ in counts})
    if not steps or not any(y for _, y in counts):
        return 8.0
    wrong = {}
    for s in range(steps[0], steps[-1] + 2):
        wrong[s] = sum(n for (t, y), n in counts.items() if (t >= s) != (y == 1))
    least = min(wrong.values())
    good = [s for s in wrong if wrong[s] == least]
    return (good[0] + good[-1]) / 20
