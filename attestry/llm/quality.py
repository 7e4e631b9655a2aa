"""Quality classifier: a regularised quadratic discriminant over transformed statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import raw, shingles, text_parts, words
from .shared import bucket_of, keep, text_or_empty, within_bounds

#: Share of a class covariance that is shrunk to its diagonal, and the least variance.
SHRINK, FLOOR = 0.1, 1e-3
#: Divides the log-density difference, so that scores do not run into 0 and 1. It moves no prediction.
TEMPERATURE = 8.0

STATISTICS = (
    "words", "symbols", "upper", "word_length", "repeats", "distinct", "stops", "digits", "pipes", "bangs", "lines", "line_length",
)


def _table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode() if isinstance(chars, str) else chars, np.uint8)] = True
    return out


_SYMBOL, _UPPER = _table("*$%&#@^~<>{}[]\\/=+_|!"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT, _STOP = _table("0123456789"), _table(".,;:?")


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics of each text: logs of smoothed ratios, so that short texts stand near the middle."""
    data, at = raw(column)
    h, first, start, end = words(column)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    n = np.diff(first).astype(float)
    size = np.diff(at).astype(float)
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same[2:] = np.cumsum(h[1:] == h[:-1])
    edge = np.minimum(first[:-1] + 1, first[1:])
    repeats = same[first[1:]] - same[edge]
    length = np.zeros(len(h) + 1, np.int64)
    np.cumsum(end - start, out=length[1:])
    inside = length[first[1:]] - length[first[:-1]]
    _, row = shingles(h, first, 1)
    distinct = np.bincount(row, minlength=len(n))
    lines = count(_table("\n"))
    ratio = lambda a, b, mean, weight=20.0: np.log((a + mean * weight) / (b + weight))
    return np.stack([
        np.log1p(n), ratio(count(_SYMBOL), size, 0.002, 100), ratio(count(_UPPER), count(_LETTER), 0.05, 50),
        ratio(inside, n, 6.0, 10), ratio(repeats, n, 0.01), ratio(distinct, n**0.9, 1.0), ratio(count(_STOP), n, 0.15),
        ratio(count(_DIGIT), size, 0.002, 100), ratio(count(_table("|")), n, 0.002, 50), ratio(count(_table("!")), n, 0.002, 50),
        ratio(lines, n, 0.03), ratio(n, lines + 1, 25.0, 1),
    ], axis=1)


def document_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, x): the array of statistics of each whole text."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_parts(whole):
                x = statistics(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def _moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(rows, sums, sums of products) of each class, added up in Spark; the driver gets a few hundred numbers."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("label").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                if len(own):
                    v = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c)), pa.array(np.arange(len(v))), pa.array(v)], ["c", "j", "v"])

    sums = labelled.select("x", F.col("label").cast("long").alias("label")).mapInArrow(run, "c long, j long, v double")
    found = sums.groupBy("c", "j").agg(F.sum("v").alias("v")).toArrow()
    out = {}
    for c in (0, 1):
        own = found["c"].to_numpy() == c
        if own.any():
            v = np.zeros(1 + d + d * d)
            v[found["j"].to_numpy()[own]] = found["v"].to_numpy()[own]
            out[c] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


class Discriminant:
    """Two Gaussians with shrunk covariances; the Cholesky factors are kept, and scoring solves with them."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        self.parts, total = [], sum(m[0] for m in moments.values())
        if len(moments) < 2 or min(m[0] for m in moments.values()) < 2:
            self.prior = (moments[1][0] if 1 in moments else 0.0) / total if total else 0.5
            return
        for c in (0, 1):
            n, s, p = moments[c]
            mean = s / n
            cov = p / n - np.outer(mean, mean)
            cov = (1 - SHRINK) * cov + SHRINK * np.diag(np.diag(cov)) + FLOOR * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(factor), np.log(n / total) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.prior)
        low, high = (log - 0.5 * (((x - mean) @ solve.T) ** 2).sum(1) for mean, solve, log in self.parts)
        return 1 / (1 + np.exp(np.clip((low - high) / TEMPERATURE, -700, 700)))


def fitted(rows: DataFrame, labels: DataFrame, doc_id: str, label: str, folds: int, held_out: int) -> Discriminant:
    """The discriminant of the statistics of all labelled rows that are not held out."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.where(bucket_of(F.col("doc_id"), "", folds) != held_out)
    return Discriminant(_moments(rows.join(known, "doc_id")))


@within_bounds
def quality_scores(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    folds: int = 3, held_out: int = 1,
) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted.

    Labels are learnt only from rows whose crc32(doc_id as text) mod folds is not held_out; a document with several
    labels takes the smallest. Only the text is used for a score; null counts as empty. Rows that repeat a doc_id are
    scored each for itself. A null doc_id is never labelled or held out. Without two rows of each class the score is the
    share of label 1, and 0.5 without labels. An empty table gives an empty result; other columns are ignored.
    """
    rows = keep(document_statistics(docs, doc_id, text), "statistics")
    model = fitted(rows, labels, doc_id, label, folds, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)[doc_id]
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", F.coalesce(bucket_of(F.col("doc_id"), "", folds) == held_out, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@within_bounds
def keep_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """docs without the documents that the classifier rejects (score below 0.5); null text counts as empty.

    No document is shuffled, and only texts go to Python, which sends a verdict back.
    """
    model = fitted(document_statistics(docs, doc_id, text), labels, doc_id, label, 3, 1)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        return pd.Series(np.concatenate([model.score(statistics(b.column(0))) >= 0.5 for b in text_parts(batch)] or [np.zeros(0, bool)]))

    return docs.where(good(text_or_empty(text)))
