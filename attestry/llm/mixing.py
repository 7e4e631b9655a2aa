"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import keep, text_or_empty, within_bounds

#: The Weyl step nearest the golden ratio modulo 2**31; products of two 31-bit numbers fit a long.
MODULUS, GOLDEN = 1 << 31, 1327217885
#: Slices of the unit interval by which slots and sources are matched.
SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, source_no, target) of a table (source, source_size) with a row for each source.

    Sources in code point order, null last, get the weights in turn. The targets share `share` times all sizes by
    weight; none exceeds `most` times its source's size, and what is cut is shared again by weight among the others.
    With sources sorted by size / weight, those cut are the first ones, so one ordered pass finds them. The windows
    run over one narrow row for each source.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source"))
    no = F.row_number().over(by_code)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(no - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", no.alias("source_no"), weight.alias("w"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    tight = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*", (F.sum("source_size").over(every) * F.lit(float(share))).alias("total"), F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("cap").over(tight), F.lit(0.0)).alias("cut"),
        F.coalesce(F.sum("w").over(tight), F.lit(0.0)).alias("cut_w"),
    )
    # the level at which a source is met if all sources before it are cut and it is not
    s = s.withColumn("level", (F.col("total") - F.col("cut")) / (F.col("all_w") - F.col("cut_w")))
    full = F.col("level") * F.col("w") >= F.col("cap")
    order = [(F.col("cap") / F.col("w")).alias("r"), F.col("source_no").alias("n")]
    s = s.withColumn("first", F.min(F.when(~full, F.struct(*order, "level"))).over(every))
    cut = F.col("first").isNull() | (F.struct(*order) < F.struct("first.r", "first.n"))
    target = F.when(cut, F.col("cap")).otherwise(F.least(F.col("first.level") * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", "source_no", target.alias("target"))


def _ranked(df: DataFrame, key: str, order: str, chunk: Column, value: Column, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of the same key before this one in order.

    Sums go up in two steps, within chunks of the order and over the chunks, so a key with a third of all rows is
    spread over as many tasks as it has chunks.
    """
    df = df.withColumn("__c", chunk).withColumn("__v", value)
    parts = df.groupBy(key, "__c").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(key).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "__c", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__c").orderBy(*order.split(",")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return df.join(parts, [key, "__c"]).withColumn(out, (F.col("__base") + F.col("__in")).cast("long")).drop(
        "__c", "__v", "__base", "__in"
    )


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, block, width): the order in which blocks of the sources are taken.

    Slot i has the point i * golden ratio modulo 1; the source whose stretch of the cumulative target weights holds
    the point gets the slot, as its block number 0, 1, 2, ... A source that has reached its target drops its further
    slots and one that falls short gets its last blocks at the end of the schedule, so sources meet their targets.
    """
    spark = targets.sparkSession
    upto = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    t = targets.where("target >= 1").select(
        "source_no", F.floor("target").alias("words"), F.sum(F.floor("target")).over(upto).alias("hi"),
        F.sum(F.floor("target")).over(Window.partitionBy(F.lit(0))).alias("all"),
    )
    # stretches in units of 1 / MODULUS; the last one ends at MODULUS exactly
    edge = lambda c: F.floor(c.cast("decimal(38,0)") * MODULUS / F.col("all")).cast("long")
    t = keep(t.select("source_no", "words", edge(F.col("hi") - F.col("words")).alias("lo"), edge(F.col("hi")).alias("hi")), "stretches")
    slots = -(-int(t.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]) // block)
    step = MODULUS // SLICES
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(MODULUS)) * F.lit(GOLDEN), F.lit(MODULUS)).alias("point")
    ).withColumn("slice", F.floor(F.col("point") / step))
    cover = t.where("hi > lo").select(
        "source_no", "words", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("slice")
    )
    drawn = points.join(cover, "slice").where("point >= lo and point < hi").select("slot", "source_no", "words")
    # the chunks grow with the square root of the slots: neither a chunk nor the list of chunks gets large
    size = max(64, math.isqrt(max(1, slots)))
    drawn = _ranked(drawn, "source_no", "slot", F.floor(F.col("slot") / size), F.lit(1), "block")
    drawn = keep(drawn.where(F.col("block") * block < F.col("words")), "slots")
    have = drawn.groupBy("source_no").agg(F.count("*").alias("have"))
    short = t.join(have, "source_no", "left").select(
        "source_no", "words", F.coalesce("have", F.lit(0)).alias("have"), F.ceil(F.col("words") / block).alias("need")
    ).where("have < need")
    late = short.select("source_no", "words", F.explode(F.sequence("have", F.col("need") - 1)).alias("block"))
    late = late.select((F.lit(slots) + F.xxhash64("block", "source_no").bitwiseAND(F.lit(MODULUS - 1))).alias("slot"), "source_no", "words", "block")
    return drawn.select("slot", "source_no", "words", "block").unionByName(late).select(
        "slot", "source_no", "block", F.least(F.lit(block), F.col("words") - F.col("block") * block).alias("width")
    )


@within_bounds
def mix_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 256,
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7,
) -> DataFrame:
    """The mix, piece by piece: row (a number of the row that docs has), doc_id, source, size, source_size, target, slot, block, epoch, first_word, end_word.

    The documents of a source stand one after another in an order shuffled by a hash; the line of their words is cut
    into blocks of `block` words, and runs on from its start when it has been used up. Each slot takes a block. A
    piece is the part of a document in one block; a document that the mix does not take has one row with null slot.

    Null or blank text has size 0. Null sources are one source. Rows that repeat a doc_id are taken as they stand,
    each with its own words. An empty table gives an empty result. Other columns are ignored.
    """
    sized = keep(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")).withColumn("row", F.monotonically_increasing_id()), "sizes"
    )
    targets = keep(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    slots = slot_schedule(targets, block)
    rows = sized.count()
    # sources are joined by broadcast only below a known size; a hot source is spread by salt beyond it
    known = targets.select(F.col("source").alias("__s"), "source_size", "source_no", "target")
    match = F.col("source").eqNullSafe(F.col("__s"))
    if targets.count() <= 100_000:
        placed = sized.join(F.broadcast(known), match).drop("__s")
    else:
        salts = 64
        left = sized.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        right = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        placed = left.join(right, match & (left["__salt"] == right["__salt"])).drop("__s", "__salt")
    chunks = max(1, math.isqrt(max(1, rows)))
    placed = placed.withColumn("__order", F.xxhash64(F.lit(seed), "doc_id"))
    placed = _ranked(placed, "source_no", "__order,doc_id,size", F.pmod(F.col("__order").bitwiseAND(F.lit((1 << 62) - 1)), F.lit(chunks)), F.col("size"), "start")
    # where the document's words stand on its source's line, in the first and in each further round
    rounds = F.greatest(F.lit(1), F.ceil((F.col("target") - F.col("start")) / F.greatest(F.col("source_size"), F.lit(1)))).cast("int")
    laid = placed.select(
        "row", "doc_id", "source", "size", "source_size", "target", "source_no", "start",
        F.explode(F.sequence(F.lit(0), F.least(rounds, F.lit(math.ceil(most))) - 1)).alias("epoch"),
    ).withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
    end = F.greatest(F.col("from") + F.col("size") - 1, F.col("from"))
    cut = laid.select(
        "*", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor(end / block))).alias("block")
    )
    joined = cut.join(slots, ["source_no", "block"], "left")
    a = F.greatest(F.col("from"), F.col("block") * block)
    b = F.least(F.col("from") + F.col("size"), F.col("block") * block + F.col("width"))
    taken = F.col("slot").isNotNull() & (b > a)
    return joined.select(
        "row", "doc_id", "source", "size", "source_size", "target", "start", "epoch", "block",
        F.when(taken, F.col("slot")).alias("slot"),
        F.when(taken, a - F.col("from")).alias("first_word"), F.when(taken, b - F.col("from")).alias("end_word"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    pieces = mix_pieces(docs, **options)
    return pieces.groupBy("row", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("end_word") - F.col("first_word")), F.lit(0)).cast("long").alias("taken"),
    ).select("doc_id", "size", "source_size", "target", "taken")
