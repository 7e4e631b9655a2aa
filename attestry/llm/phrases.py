"""Phrase collocations: position bitmaps of words, extended depth-first by shift and AND; popcounts are added over shards.

A shard is a stretch of documents of one task. Its words stand at positions, with a gap after each piece. A word's
bitmap has a bit for each position; only bytes that are not zero are stored, as rows (byte number, word, bits). The
bitmap of a phrase marks where its last word stands: shifted by one and ANDed with the bitmap of a word, it is the
bitmap of the longer phrase. Phrases of one length go over all shards before the next, so that only what is frequent
everywhere is extended; a filter of fixed size tells shards which phrases those are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .kernels import mix, raw, runs, span_hashes, text_parts
from .shared import keep, within_bounds

#: Least occurrences of a phrase, most words of one, and phrases that are returned for each lang.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of the filter of frequent phrases (16 MB at any size of the corpus), and slots of each phrase in it.
FILTER_BITS, SLOTS = 27, 2
#: Words of a shard, and rows of an AND at once.
SHARD_WORDS, ROWS = 1 << 20, 1 << 20

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False
_COUNTS = "parent long, last long, n long"


def joined(parent: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The id of a phrase from that of its first words and its last word."""
    return mix(mix(parent, 11) + last, 12)


def word_id(lang: str, hashes: np.ndarray) -> np.ndarray:
    """Words of different langs are different words."""
    own = span_hashes(np.frombuffer(lang.encode(), np.uint8), lower=False)(np.array([0]), np.array([len(lang.encode())]))
    return joined(np.broadcast_to(own, len(hashes)), hashes)


def pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word ids, whether the next word stands in the same piece, first byte, end) of the words of a batch (lang, text)."""
    data, offsets = raw(batch.column("text"))
    first, starts, ends = runs(data, offsets, _INSIDE[data])
    h = span_hashes(data)(starts, ends)
    row = np.searchsorted(first, np.arange(len(h)), "right") - 1
    lang = batch.column("lang").dictionary_encode()
    own = lang.indices.to_numpy()[row]
    for i, name in enumerate(lang.dictionary.to_pylist()):
        mine = own == i
        h[mine] = word_id(name, h[mine])
    cuts = np.concatenate([[0], np.cumsum(_ENDS[data])])
    on = np.zeros(len(h), bool)
    on[:-1] = (row[1:] == row[:-1]) & (cuts[starts[1:]] == cuts[ends[:-1]])
    return h, on, starts, ends


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word ids, same piece) of about SHARD_WORDS words each; a document is not cut."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for whole in batches:
        for batch in text_parts(whole, most=1 << 21):
            held.append(pieces(batch)[:2])
            if sum(len(x[0]) for x in held) >= SHARD_WORDS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, id, n) of the words of each batch."""
    for whole in batches:
        for batch in text_parts(whole, most=1 << 21):
            h, _, starts, ends = pieces(batch)
            data, offsets = raw(batch.column("text"))
            ids, at, n = np.unique(h, return_index=True, return_counts=True)
            row = np.searchsorted(offsets, starts[at], "right") - 1
            lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            words = [lower[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            lang = batch.column("lang").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([lang, pa.array(words, pa.binary()).cast(pa.string()), pa.array(ids.view(np.int64)), pa.array(n)], ["lang", "word", "id", "n"])


def slots(ids: np.ndarray, bits: int = FILTER_BITS) -> list[np.ndarray]:
    return [((ids >> np.uint64(bits * i)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(SLOTS)]


def frequent_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter that has the slots of all ids set: 2**bits bits, however many ids there are."""
    slot = F.explode(F.array(*[F.shiftrightunsigned("id", bits * i).bitwiseAND((1 << bits) - 1) for i in range(SLOTS)]))
    cells = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("word"))
    found = cells.toArrow()
    out = np.zeros(1 << bits - 5, np.uint32)
    out[found["at"].to_numpy()] = found["word"].to_numpy().astype(np.uint32)
    return out


def may_be(held: np.ndarray, ids: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """False only for ids that are not in the filter."""
    out = np.ones(len(ids), bool)
    for s in slots(ids, bits):
        out &= ((held[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)
    return out


class Bitmaps:
    """The bitmaps of a shard's words, by byte of positions: rows (byte, word, bits), sorted by byte."""

    def __init__(self, ids: np.ndarray, on: np.ndarray, frequent: np.ndarray) -> None:
        gap = np.zeros(len(ids), np.int64)
        gap[1:] = ~on[:-1]
        place = np.arange(len(ids)) + np.cumsum(gap)  # a position is left out after each piece
        kept = np.flatnonzero(may_be(frequent, ids))
        self.words, of = np.unique(ids[kept], return_inverse=True)
        place = place[kept]
        key = (place >> 3) * max(1, len(self.words)) + of
        order = np.argsort(key, kind="stable")
        key, bit = key[order], (1 << (place[order] & 7)).astype(np.uint8)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.bits = np.bitwise_or.reduceat(bit, new) if len(new) else bit
        self.byte, self.word = key[new] // max(1, len(self.words)), key[new] % max(1, len(self.words))
        self.start = np.searchsorted(self.byte, np.arange((int(self.byte[-1]) if len(new) else 0) + 3))

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, byte, bits): the bitmaps of some words at a time, about ROWS / 8 rows."""
        order = np.argsort(self.word, kind="stable")
        edge = np.searchsorted(self.word[order], np.arange(len(self.words) + 1))
        at = 0
        while at < len(self.words):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + ROWS // 8, "right")) - 1)
            own = order[edge[at] : edge[to]]
            yield self.word[own], self.byte[own], self.bits[own]
            at = to

    def extend(self, phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase, word, byte, bits): each phrase's bitmap shifted by one and ANDed with those of the words that have
        a bit in the same bytes. What is shifted out of a byte goes to the next one."""
        over = bits >> np.uint8(7)
        more = np.flatnonzero(over)
        phrase = np.concatenate([phrase, phrase[more]])
        byte = np.concatenate([byte, byte[more] + 1])
        moved = np.concatenate([bits << np.uint8(1), over[more]])
        some = np.flatnonzero(moved)
        phrase, byte, moved = phrase[some], byte[some], moved[some]
        out: list[tuple[np.ndarray, ...]] = []
        n = self.start[byte + 1] - self.start[byte]
        total = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(phrase):  # at most ROWS rows at once
            b = max(a + 1, int(np.searchsorted(total, total[a] + ROWS, "right")) - 1)
            which = np.repeat(np.arange(a, b), n[a:b])
            row = np.arange(total[b] - total[a]) - np.repeat(total[a:b] - total[a] - self.start[byte[a:b]], n[a:b])
            both = moved[which] & self.bits[row]
            hit = np.flatnonzero(both)
            out.append((phrase[which[hit]], self.word[row[hit]], byte[which[hit]], both[hit]))
            a = b
        if not out:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint8))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def counts(self, filters: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(parent, last word, popcount) of the phrases of len(filters) + 1 to `most` words whose beginnings are in the
        filters: filters[k] has those of k + 2 words. Depth first: some words' phrases are followed to the end before the next words."""
        for word, byte, bits in self.chunks():
            ids, own = self.words, word
            for length in range(2, most + 1):
                phrase, last, byte, bits = self.extend(own, byte, bits)
                key, own = np.unique(phrase * len(self.words) + last, return_inverse=True)
                if not len(key):
                    break
                parent, end = ids[key // len(self.words)], self.words[key % len(self.words)]
                ids = joined(parent, end)
                if length > len(filters) + 1:
                    yield parent, end, np.bincount(own, np.bitwise_count(bits), len(key)).astype(np.int64)
                else:
                    good = may_be(filters[length - 2], ids)[own]
                    own, byte, bits = own[good], byte[good], bits[good]


def _counter(frequent, filters: list, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, on in _shards(batches):
            for parent, last, n in Bitmaps(ids, on, frequent.value).counts([f.value for f in filters], most):
                yield pa.RecordBatch.from_arrays([pa.array(parent.view(np.int64)), pa.array(last.view(np.int64)), pa.array(n)], ["parent", "last", "n"])

    return run


def _with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = joined(*(b.column(c).to_numpy().view(np.uint64) for c in ("parent", "last")))
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), *b.columns], ["id", *b.schema.names])


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k, left, right): the ids of both parts of each phrase (id, words) after its first k words."""
    for b in batches:
        ids, words = b.column("id").to_numpy(), b.column("words")
        size = words.value_lengths().to_numpy()
        flat, first = words.flatten().to_numpy().view(np.uint64), np.cumsum(size) - size
        for m in np.unique(size).tolist():
            rows = np.flatnonzero(size == m)
            w = flat[first[rows][:, None] + np.arange(m)]
            for k in range(1, m):
                parts = []
                for a, e in ((0, k), (k, m)):
                    part = w[:, a]
                    for i in range(a + 1, e):
                        part = joined(part, w[:, i])
                    parts.append(pa.array(part.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(len(rows), k)), *parts], ["id", "k", "left", "right"])


def _only(table: DataFrame, what: str) -> DataFrame:
    """The table, after a check that no two of its rows have the same id."""
    twice = table.groupBy("id").count().where("count > 1")
    if twice.limit(1).count():
        raise ValueError(f"two {what} have the same 64-bit hash")
    return table


@within_bounds
def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): words (lang, word, id, n) are all that occur; phrases (id, parent, last, n, words) are those of 2 to
    `longest` words with n >= least; `words` has the ids of their words in order. Counts are exact: filters only leave out
    what is certainly rarer."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = rows.mapInArrow(_vocabulary, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))
    words = _only(keep(words, "words"), "words")
    frequent = spark.sparkContext.broadcast(frequent_filter(words.where(F.col("n") >= least).select("id")))
    filters: list = []
    found = spark.createDataFrame([], "id long, parent long, last long, n long, words array<long>")
    before = None
    lengths = [*range(2, min(3, longest) + 1), *([longest] if longest > 3 else [])]  # beyond three words few are left: one pass
    for most in lengths:
        counted = rows.mapInArrow(_counter(frequent, filters, most), _COUNTS).groupBy("parent", "last").agg(F.sum("n").alias("n"))
        new = _only(keep(counted.where(F.col("n") >= least).mapInArrow(_with_id, f"id long, {_COUNTS}"), "phrases"), "phrases")
        rest, length = new, len(filters) + 2
        while length <= most:
            if before is None:
                here = rest.withColumn("words", F.array("parent", "last"))
            else:
                here = rest.join(before.select(F.col("id").alias("parent"), F.col("words").alias("w")), "parent").withColumn("words", F.concat("w", F.array("last"))).drop("w")
            before = keep(here.select("id", "parent", "last", "n", "words"), f"phrases_{length}")
            found = found.unionByName(before)
            length += 1
        if most < longest:
            filters.append(spark.sparkContext.broadcast(frequent_filter(before.select("id"))))
    return words, found


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
) -> DataFrame:
    """The first `top` phrases of each lang: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at . , ; : ! ? and at line ends, words at spaces and tabs. a is how often the phrase
    stands within pieces of the lang, overlaps included, at least `least`; n is the number of words of the lang. A cut
    into two parts that occur l and r times has the score floor(1000 a n / (l r)); the cut of the lowest score counts, the
    first of equal ones. A phrase within a longer candidate that occurs as often is dropped. Order: score, a, then phrase
    in byte order. A null lang is `und`, a null text empty; repeated rows count each for itself; an empty table gives no
    rows. Other columns are ignored.
    """
    words, found = phrase_counts(docs, lang, text, least, longest)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = words.where(F.col("n") >= least).select("id", "n").unionByName(found.select("id", "n"))
    cuts = found.select("id", "words").mapInArrow(_cuts, "id long, k long, left long, right long")
    cuts = keep(cuts, "cuts")
    sized = cuts.join(counts.select(F.col("id").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("id").alias("right"), F.col("n").alias("r")), "right")
    # a phrase of one word less is the left part before the last word, or the right part after the first
    last = found.select("id", F.size("words").alias("m"), "n")
    parts = cuts.join(last, "id").where("m > 2 and (k = 1 or k = m - 1)")
    inner = F.explode(F.filter(F.array(F.when(F.col("k") == F.col("m") - 1, F.col("left")), F.when(F.col("k") == 1, F.col("right"))), lambda x: x.isNotNull()))
    longer = parts.select(inner.alias("id"), F.col("n").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
    kept = found.join(longer, "id", "left").where(F.coalesce(F.col("longer") < F.col("n"), F.lit(True)))
    names = F.broadcast(total.withColumnRenamed("n", "total")) if total.count() <= 10_000 else total.withColumnRenamed("n", "total")
    of = words.where(F.col("n") >= least).select(F.col("id").alias("w"), "lang", "word")
    spelled = kept.select("id", F.col("n").alias("a"), F.posexplode("words").alias("i", "w")).join(of, "w")
    spelled = spelled.groupBy("id", "a", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    scored = spelled.join(names, "lang").join(sized, "id")
    whole: Column = F.expr("cast(1000 as decimal(38,0)) * a * total div (cast(l as decimal(38,0)) * r)")
    best = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(whole.alias("score"), "k", "l", "r")).alias("cut"))
    out = best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), F.col("cut.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
