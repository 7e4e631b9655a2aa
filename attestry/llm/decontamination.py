"""Benchmark decontamination: a BM25 index of the test items, searched with every training passage.

The index is an inverted file of the items. Scores are divided by what an item must reach, so one bound of 1 serves
all items. As in WAND with block maxima, a passage opens a block of items only if the block's bound can reach 1, and
an item only if its own can: the most frequent terms of an item, which cannot reach 1 together, open nothing alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import mix, text_parts, words
from .shared import keep, text_or_empty, within_bounds, without

#: BM25 parameters; items of one index (a larger benchmark takes several); items of a block.
K1, B, INDEX_ITEMS, BLOCK = 1.2, 0.75, 20_000, 16
#: Words from one passage to the next, at least.
LEAST_STRIDE = 32
#: Share of an item's own score that a passage must reach; words of a gram; share of grams of question and of answer.
SCORE, GRAM, OVERLAP = 0.5, 3, 0.5


@dataclass
class Index:
    ids: list
    terms: np.ndarray  # sorted hashes
    item_terms: list[np.ndarray]  # numbers of the terms of each item
    item_weights: list[np.ndarray]
    rest: np.ndarray  # what the terms that open nothing can add
    start: np.ndarray  # opening postings of each term, by item
    item: np.ndarray
    weight: np.ndarray
    block_start: np.ndarray  # the same by block, with the block's maximum
    block: np.ndarray
    block_weight: np.ndarray
    block_rest: np.ndarray
    grams: list[tuple[int, np.ndarray, np.ndarray]]  # words of a gram, grams of question and of answer
    stride: int


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Distinct hashes of the n-word runs; fewer words are one run."""
    n = max(1, min(n, len(h)))
    if not len(h):
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i], i)
    return np.unique(out)


def item_grams(h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(words of a gram, grams of the question, grams of the answer). An item whose halves are too short for grams is
    one gram, without an answer, so that only its whole run of words is a repeat."""
    if len(h) < 2 * GRAM:
        return len(h), grams(h, len(h)), grams(h[:0])
    return GRAM, grams(h[: (len(h) + 1) // 2]), grams(h[(len(h) + 1) // 2 :])


def item_words(texts: list[str]) -> list[np.ndarray]:
    h, first, _, _ = words(pa.array(texts, pa.string()))
    return [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def length_class(words: int) -> int:
    """The stride of an item's passages: its number of words, rounded up to a power of two, LEAST_STRIDE at least."""
    return max(LEAST_STRIDE, 1 << (words - 1).bit_length())


def build_indexes(ids: list, item_hashes: list[np.ndarray], terms: np.ndarray, df: np.ndarray, docs: int) -> list[Index]:
    """An index for each class of lengths: what one item finds does not depend on the lengths of the others."""
    by: dict[int, list[int]] = {}
    for i, h in enumerate(item_hashes):
        by.setdefault(length_class(len(h)), []).append(i)
    out = []
    for own in by.values():
        hashes = [item_hashes[i] for i in own]
        mine = np.unique(np.concatenate(hashes))
        out.append(build_index([ids[i] for i in own], hashes, mine, df[np.searchsorted(terms, mine)], docs))
    return out


def build_index(ids: list, item_hashes: list[np.ndarray], terms: np.ndarray, df: np.ndarray, docs: int) -> Index:
    """df: in how many of the `docs` training documents each term occurs. Items are of one class of lengths, whose stride
    stands for their mean length."""
    idf = np.log1p((docs - np.minimum(df, docs) + 0.5) / (df + 0.5))
    stride = length_class(max(map(len, item_hashes), default=1))
    its, ws, rest, post = [], [], np.zeros(len(ids)), []
    for i, h in enumerate(item_hashes):
        t, tf = np.unique(h, return_counts=True)
        no = np.searchsorted(terms, t)
        w = idf[no] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / stride))
        w = w / (SCORE * w.sum())
        its.append(no)
        ws.append(w)
        order = np.argsort(-df[no], kind="stable")  # most frequent first
        quiet = order[np.cumsum(w[order]) < 1 - 1e-9]
        rest[i] = w[quiet].sum()
        opens = np.ones(len(no), bool)
        opens[quiet] = False
        post.append(np.stack([no[opens].astype(float), np.full(opens.sum(), i, float), w[opens]]))
    p = np.concatenate(post, axis=1) if post else np.zeros((3, 0))
    p = p[:, np.lexsort((p[1], p[0]))]
    term, item = p[0].astype(np.int64), p[1].astype(np.int64)
    every = np.arange(len(terms) + 1)
    pairs, inverse = np.unique(term * (len(ids) // BLOCK + 1) + item // BLOCK, return_inverse=True)
    top = np.zeros(len(pairs))
    np.maximum.at(top, inverse, p[2])
    bt, bb = pairs // (len(ids) // BLOCK + 1), pairs % (len(ids) // BLOCK + 1)
    block_rest = np.zeros(len(ids) // BLOCK + 1)
    np.maximum.at(block_rest, np.arange(len(ids)) // BLOCK, rest)
    parts = [item_grams(h) for h in item_hashes]
    return Index(ids, terms, its, ws, rest, np.searchsorted(term, every), item, p[2], np.searchsorted(bt, every), bb, top, block_rest, parts, stride)


def _spread(of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of `of`, posting) for each posting of each term in `of`."""
    n = start[of + 1] - start[of]
    which = np.repeat(np.arange(len(of)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[of], n)


def _sums(a: np.ndarray, b: np.ndarray, width: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, inverse = np.unique(a * width + b, return_inverse=True)
    return key // width, key % width, np.bincount(inverse, w, len(key))


def term_numbers(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number of each word's term, -1 without one."""
    if not len(terms):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1)


def search(index: Index, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(row, item, first word of the passage, score, question overlap, answer overlap) of all that reach 1.

    A passage holds 2 * stride words and starts at each multiple of stride, so that no copy of an item is cut.
    """
    no = term_numbers(index.terms, h)
    at = np.flatnonzero(no >= 0)
    row = np.searchsorted(first, at, "right") - 1
    piece = (at - first[row]) // index.stride
    per_row = np.diff(first) // index.stride + 2
    base = np.cumsum(per_row) - per_row  # passage number j of a row is base + j
    cell = base[row] + piece
    passage = np.concatenate([cell, cell[piece > 0] - 1])
    term = np.concatenate([no[at], no[at[piece > 0]]])
    key = np.unique(passage * len(index.terms) + term)
    passage, term = key // max(1, len(index.terms)), key % max(1, len(index.terms))
    which, post = _spread(term, index.block_start)
    p, b, bound = _sums(passage[which], index.block[post], len(index.block_rest), index.block_weight[post])
    good = bound + index.block_rest[b] >= 1 - 1e-9
    opened = np.unique(p[good] * len(index.block_rest) + b[good])
    some = np.isin(passage, p[good])
    passage, term = passage[some], term[some]
    which, post = _spread(term, index.start)
    inside = np.isin(passage[which] * len(index.block_rest) + index.item[post] // BLOCK, opened)
    which, post = which[inside], post[inside]
    p, i, bound = _sums(passage[which], index.item[post], max(1, len(index.ids)), index.weight[post])
    good = bound + index.rest[i] >= 1 - 1e-9
    for cell, item in zip(p[good].tolist(), i[good].tolist(), strict=True):
        r = int(np.searchsorted(base, cell, "right") - 1)
        a = int(first[r] + (cell - base[r]) * index.stride)
        e = int(min(first[r + 1], a + 2 * index.stride))
        score = float(index.item_weights[item][np.isin(index.item_terms[item], no[a:e])].sum())
        if score >= 1 - 1e-9:
            n, *parts = index.grams[item]
            near = grams(h[a:e], n) if e - a >= n else h[:0]
            over = [float(np.isin(g, near).mean()) if len(g) else 1.0 for g in parts]
            yield r, item, a - int(first[r]), score * SCORE, over[0], over[1]


def _document_counts(rows: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many rows each term occurs; all rows count."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for whole in batches:
            for batch in text_parts(whole):
                h, first, _, _ = words(batch.column("text"))
                no = term_numbers(shared.value, h)
                at = np.flatnonzero(no >= 0)
                row = np.searchsorted(first, at, "right") - 1
                seen = np.unique(row * len(total) + no[at])
                total += np.bincount(seen % max(1, len(total)), minlength=len(total))
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(total[t])], ["t", "n"])

    out = np.zeros(len(terms), np.int64)
    found = rows.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out[found["t"].to_numpy()] = found["n"].to_numpy()
    return out


@within_bounds
def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each document and item whose question and answer it repeats: doc_id, text_hash, item_id, word_start
    (first word of the best passage), score (share of the item's own BM25 score), question_overlap, answer_overlap.

    An item's question is the first half of its words, its answer the rest; a passage, of two to four times the item's words
    (2 * LEAST_STRIDE at least), repeats it if it reaches SCORE of the item's score and OVERLAP of the word grams of both. An item of fewer than 2 * GRAM words is repeated by its whole
    run of words only, even by a single word. Whole texts are searched, A-Z lower-cased. Null or blank
    texts and items match nothing; null ids are ids. Of rows that repeat doc_id and text, or items that repeat item_id,
    the best match is kept. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    total = rows.count()
    kinds = dict(docs.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    items = benchmark.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("text")).where(F.trim("text") != "")
    items = keep(items, "items")
    parts = max(1, -(-items.count() // (INDEX_ITEMS // 2)))
    out = spark.createDataFrame([], f"doc_id {kinds[0]}, text_hash long, item_no long, item_id {kinds[1]}, word_start long, score double, question_overlap double, answer_overlap double")
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        hashes = item_words(own["text"].to_pylist())
        terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        ids = own["item_id"].to_pylist()
        # an item's number takes the place of its id, which may be null
        indexes = build_indexes(list(range(len(ids))), hashes, terms, _document_counts(rows, terms), max(1, total))
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in text_parts(whole):
                    h, first, _, _ = words(batch.column("text"))
                    if not len(h):
                        continue
                    found = [(x[0], index.ids[x[1]], *x[2:]) for index in shared.value for x in search(index, h, first) if min(x[4:]) >= OVERLAP]
                    if found:
                        r, i, start, score, q, a = map(list, zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(r)), batch.column("text_hash").take(pa.array(r)), pa.array(i, pa.int64()), pa.array(start, pa.int64()), pa.array(score), pa.array(q), pa.array(a)],
                            ["doc_id", "text_hash", "item_no", "word_start", "score", "question_overlap", "answer_overlap"],
                        )

        hits = rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            run, f"doc_id {kinds[0]}, text_hash long, item_no long, word_start long, score double, question_overlap double, answer_overlap double"
        )
        names = spark.createDataFrame(list(enumerate(ids)), f"item_no long, item_id {kinds[1]}")
        hits = keep(hits.join(F.broadcast(names), "item_no"), "hits")
        out = out.unionByName(hits)
    best = F.max(F.struct("score", -F.col("word_start"), "question_overlap", "answer_overlap")).alias("m")
    out = out.groupBy("doc_id", "text_hash", "item_id").agg(best)
    return out.select("doc_id", "text_hash", "item_id", (-F.col("m.col2")).alias("word_start"), "m.score", "m.question_overlap", "m.answer_overlap")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that repeat a test item; all other rows stay as they are, null ids and texts among them."""
    return without(docs, contaminated(docs, benchmark, doc_id, text), doc_id, text)
