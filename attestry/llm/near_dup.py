"""N-gram Jaccard join by a token-group matrix: groups of similar documents, their token unions, and bounded opening.

Shingles stand in one global order: by hash, with very frequent ones last. Two sets whose Jaccard similarity reaches
the threshold share at least `l` of the first `p + l - 1` shingles of either one, where p - 1 is the most that a set
can lack in its partner. All candidate search therefore runs on these prefixes, and no link is lost.

A group is a leader and the sets that are most like it. The matrix holds, for each group, the union of its members'
prefixes. A set opens another group only if it shares as many shingles with the group's union as a link needs. A set
that opens a group is compared with its leader, and stands in the group by its difference from the leader: the
distance of two sets is that of their differences. So the members are never paired with one another; a second prefix
search, over the few shingles of the differences, finds the links of those that do not link to the leader themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .kernels import mix, shingles, text_parts, words
from .mapped import key_files, repeat_filter
from .shared import components, join_groups, keep, text_or_empty, within_bounds, without

#: A shingle of so many documents, or of this share of them, is frequent: it stands last in the global order.
FREQUENT, FREQUENT_PART = 50, 4096
#: Rounds in which sets without a link meet the leader of a group.
LEADER_ROUNDS = 2
#: Bytes of sets that are compared in one group.
COMPARE_BYTES = 2 << 20
#: Words of 64 bits of the bitmap of a difference.
BITMAP = 4
_BITS = np.uint64(16)
_SPAN = 1 << 48


def _need(n, percent: int):
    """The least overlap of a set of n shingles with any partner that reaches the threshold."""
    return (percent * n + 99) // 100


def prefix_sizes(n, percent: int):
    """(length of the prefix of a set of n shingles, how many of them a partner of at least that size shares)."""
    need = _need(n, percent)
    least = np.minimum(1 + (n - need + 1) // 2, np.maximum(need, 1))
    return np.minimum(n - need + least, n), least


def least_shared(n: Column, percent: int) -> Column:
    """The second of prefix_sizes, as a column. Two sets share the smaller of theirs."""
    need = F.floor((n * percent + 99) / 100)
    return F.least(F.lit(1) + F.floor((n - need + 1) / 2), F.greatest(need, F.lit(1))).cast("long")


def least_of_any(n: Column, percent: int) -> Column:
    """What a set of n shingles shares with any partner: least_shared of the smallest set that can be one."""
    return least_shared(F.floor((n * percent + 99) / 100), percent)


def _pack(x: np.ndarray) -> bytes:
    """48-bit numbers in 6 bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column of packed sets, and the row of each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return _unpack(data), np.repeat(np.arange(len(column)), np.diff(offsets) // 6)


def packed_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, classes, shingles, first shingle of each set and the end): the sorted sets of texts in 48-bit numbers."""
    h, firsts, _, _ = words(column)
    s, row = shingles(h, firsts, k)
    at = np.searchsorted(row, np.arange(len(column) + 1))
    n = np.diff(at)
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s, 11), out=total[1:])
    cls = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)
    s = s >> _BITS
    # hashes that become equal in 48 bits count once, so that sets stay sets
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return n, cls, s[new], np.searchsorted(row[new], np.arange(len(column) + 1))


def frequent_shingles(rows: DataFrame, k: int, total: int) -> np.ndarray:
    """The shingles of about 1/FREQUENT_PART of all documents and of FREQUENT ones at least, sorted; all rows are read.

    Their number is bounded by a multiple of FREQUENT_PART times the mean size of a set, whatever the number of
    documents. Counts leave out shingles that some hundred thousand neighbours hold once: which shingles stand last is
    a matter of speed only, for any one global order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t[c > 1].astype(np.int64)), pa.array(c[c > 1])], ["t", "c"])

        for whole in batches:
            for batch in text_parts(whole):
                t = packed_sets(batch.column("text"), k)[2]
                held, size = [*held, t], size + len(t)
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    least = max(FREQUENT, total // FREQUENT_PART)
    counts = rows.select("text").mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
    found = counts.where(F.col("c") >= least // 2).select("t").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.uint64))


def prefix_sets(rows: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, node, n_shingles, cls, n, prefix): cls tells sets apart, n is the size of the packed set, and
    prefix has, packed, the first shingles of the set in the global order."""
    kind = dict(rows.dtypes)["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for whole in batches:
            for batch in text_parts(whole):
                n_shingles, cls, t, at = packed_sets(batch.column("text"), k)
                n = np.diff(at)
                row = np.repeat(np.arange(batch.num_rows), n)
                hot = np.zeros(len(t), bool)
                if len(often):
                    hot = often[np.minimum(np.searchsorted(often, t), len(often) - 1)] == t
                order = np.argsort(row * 2 + hot, kind="stable")
                rank = np.arange(len(t)) - np.repeat(at[:-1], n)
                size = prefix_sizes(n, percent)[0]
                t = t[order][rank < np.repeat(size, n)]
                edges = np.concatenate([[0], np.cumsum(size)])
                prefix = [_pack(t[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "text_hash", "node")), pa.array(n_shingles, pa.int64()), pa.array(cls), pa.array(n, pa.int64()), pa.array(prefix, pa.binary())],
                    ["doc_id", "text_hash", "node", "n_shingles", "cls", "n", "prefix"],
                )

    return rows.select("doc_id", "text_hash", "node", "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, node long, n_shingles long, cls long, n long, prefix binary"
    )


def members(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, node, n, w, items): a row for each different set that shares enough of its prefix with other sets.

    items are the shingles of the prefix that other sets may have in theirs, by a Bloom filter over all prefixes: a
    shingle of one set only opens nothing. w is their share of the set.
    """
    copies = sets.groupBy("cls").agg(F.min("row").alias("number"), F.count("*").alias("c")).where("c > 1")
    first = key_files(copies.withColumnRenamed("cls", "key"))

    def one_of_each(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of the copies of a set only the row that stands first."""
        hit, number = first.look_up(batch.column("cls").to_numpy())
        return batch.filter(pa.array(~hit | (number == batch.column("row").to_numpy())))

    def all_shingles(whole: pa.RecordBatch) -> np.ndarray:
        return _sets(one_of_each(whole).column("prefix"))[0]

    total = sets.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 6
    made = repeat_filter(sets.select("cls", "row", "prefix"), total, all_shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = one_of_each(whole)
            t, row = _sets(batch.column("prefix"))
            good = made.may_repeat(t)
            t, row = t[good], row[good]
            n = batch.column("n").to_numpy()
            k = np.bincount(row, minlength=batch.num_rows)
            enough = k >= prefix_sizes(_need(n, percent), percent)[1]
            size = k[enough]
            t = t[enough[row]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(t.astype(np.int64)))
            cls, node = (batch.column(c).to_numpy()[enough] for c in ("cls", "node"))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(node), pa.array(n[enough]), pa.array(size / n[enough]), lists], ["cls", "node", "n", "w", "items"])

    return sets.select("cls", "row", "node", "n", "prefix").mapInArrow(run, "cls long, node long, n long, w double, items array<long>")


def whole_sets(rows: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """(cls, items): the whole packed sets of the rows of `some` (cls, node), from their texts; others are not hashed."""
    wanted = key_files(some.select(F.col("node").alias("key"), F.col("cls").alias("number")).dropDuplicates(["key"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            hit, _ = wanted.look_up(whole.column("node").to_numpy())
            for batch in text_parts(whole.filter(pa.array(hit))):
                _, cls, t, at = packed_sets(batch.column("text"), k)
                packed = [_pack(t[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(packed, pa.binary())], ["cls", "items"])

    return rows.select("node", "text").mapInArrow(run, "cls long, items binary")


def compared(pairs: DataFrame, own: DataFrame, percent: int, groups: int, guests: bool = False) -> DataFrame:
    """pairs (a, b) with n, m (sizes), similar (the exact test of the threshold), diff, the shingles of one only, and
    their bitmap.

    The shingles of b, the leader, that a lacks have _SPAN added, so that they stand behind what only a has. Each set
    is sent once to each group of pairs that names it, not once a pair. diff is null where a is too far from b to be a
    member; for guests, where a is too far from b to link to any set that is a member.
    """

    def most(n: int, m: int) -> float:
        if not guests:
            return (n + m) / 3
        other = n * 100 / percent  # the largest partner of a
        return (100 - percent) / (100 + percent) * (n + other) + (other + m) / 3 + 1

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        at = dict(zip(sets["cls"].to_pylist(), range(sets.num_rows), strict=True))
        items, lists = sets["items"].combine_chunks(), []
        similar, size, bits = [], [], []
        for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            x, y = (_unpack(np.frombuffer(items[at[c]].as_buffer(), np.uint8)) for c in (x, y))
            both = np.concatenate([x << np.uint64(1), (y << np.uint64(1)) | np.uint64(1)])
            both.sort()
            shingle = both >> np.uint64(1)
            same = np.flatnonzero(shingle[1:] == shingle[:-1])
            similar.append(100 * len(same) >= percent * (len(both) - len(same)))
            size.append((len(x), len(y)))
            one = np.ones(len(both), bool)
            one[same], one[same + 1] = False, False
            one = both[one]
            diff = np.sort((one >> np.uint64(1)) + (one & np.uint64(1)) * np.uint64(_SPAN)).astype(np.int64)
            near = len(diff) <= most(*size[-1])
            lists.append(diff if near else None)
            bitmap = np.zeros(BITMAP, np.uint64)
            at_bit = mix(diff.view(np.uint64), 17) % np.uint64(64 * BITMAP)
            np.bitwise_or.at(bitmap, (at_bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at_bit & np.uint64(63)))
            bits.append(bitmap.view(np.int64) if near else None)
        n, m = zip(*size, strict=True) if size else ((), ())
        return pa.table({
            "a": pairs["a"], "b": pairs["b"], "n": pa.array(n, pa.int64()), "m": pa.array(m, pa.int64()),
            "similar": pa.array(similar, pa.bool_()), "diff": pa.array(lists, pa.list_(pa.int64())),
            "bits": pa.array(bits, pa.list_(pa.int64())),
        })

    pairs = keep(pairs.select("a", "b").withColumn("g", F.pmod(F.xxhash64("a"), F.lit(groups))), "pairs")
    firsts = own.withColumn("h", F.pmod(F.xxhash64("cls"), F.lit(groups)))
    if 2 * pairs.count() < own.count():
        firsts = firsts.join(pairs.select(F.col("a").alias("cls")), "cls", "left_semi")
    leaders = pairs.select(F.col("g").alias("h"), F.col("b").alias("cls")).distinct().join(own, "cls")
    dealt = firsts.select("h", "cls", "items").unionByName(leaders.select("h", "cls", "items"))
    return pairs.groupBy("g").cogroup(dealt.groupBy("h")).applyInArrow(
        run, "a long, b long, n long, m long, similar boolean, diff array<long>, bits array<long>"
    )


def near_links(sets: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between set classes that connect exactly those classes that links of the full join connect."""
    some = keep(members(sets, percent), "members")
    own = keep(whole_sets(rows, some, k), "whole_sets")
    size = own.agg(F.coalesce(F.sum(F.octet_length("items")), F.lit(0))).first()[0]
    parts = int(max(8, 2 * size // COMPARE_BYTES))
    hits = some.select("cls", "n", "w", "items")
    met = None
    for _ in range(LEADER_ROUNDS):
        free = hits
        if met is not None:
            linked = met.where("similar")
            free = hits.join(linked.select(F.col("a").alias("cls")).unionByName(linked.select(F.col("b").alias("cls"))).distinct(), "cls", "left_anti")
        pairs = _leaders(free.select("cls", "n", "w", F.explode("items").alias("t")), percent)
        if met is not None:
            pairs = pairs.join(met.select("a", "b"), ["a", "b"], "left_anti")
        found = keep(compared(pairs, own, percent, parts), "met")
        met = found if met is None else met.unionByName(found)
    groups = keep(_groups(hits, met), "groups")
    guests = keep(compared(_opened(hits, groups, percent), own, percent, parts, True), "guests")
    links = met.where("similar").select("a", "b").unionByName(guests.where("similar").select("a", "b"))
    return links.unionByName(_inner_links(groups, guests, percent))


def _leaders(hits: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each set the leader with which it shares the most shingles; each shingle has one leader, that whose
    set shares the most with others: it is likely what they were copied from."""
    lead = F.max(F.struct("w", "cls", "n")).over(Window.partitionBy("t"))
    met = hits.withColumn("l", lead).select("cls", "n", F.col("l.cls").alias("b"), F.col("l.n").alias("m"))
    met = met.where("cls <> b and 2 * least(n, m) >= greatest(n, m)")
    met = met.groupBy(F.col("cls").alias("a"), "n", "b").agg(F.count("*").alias("k")).where(2 * F.col("k") >= least_of_any(F.col("n"), percent))
    return met.groupBy("a").agg(F.max(F.struct("k", "b")).alias("m")).select("a", "m.b")


def _groups(hits: DataFrame, met: DataFrame) -> DataFrame:
    """(cls, g, n, m, similar, diff, bits): the group of each set, which is the class of its leader, and its difference.

    Every set that leads another one leads a group of its own; of the leaders that a set has met it goes to the nearest.
    """
    near = met.where("diff is not null")
    best = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    best = best.groupBy("a").agg(F.min(F.struct(F.size("diff").alias("d"), "b", "n", "m", "similar", "diff", "bits")).alias("x"))
    best = best.select(F.col("a").alias("cls"), F.col("x.b").alias("g"), "x.n", "x.m", "x.similar", "x.diff", "x.bits")
    none = F.array().cast("array<bigint>")
    alone = hits.select("cls", "n").join(best.select("cls"), "cls", "left_anti")
    alone = alone.select("cls", F.col("cls").alias("g"), "n", F.col("n").alias("m"), F.lit(True).alias("similar"), none.alias("diff"), none.alias("bits"))
    return best.unionByName(alone)


def _opened(hits: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): the sets a and the leaders b of the other groups that they open.

    The matrix has a row for each group and shingle of its union, with the least and the greatest size of the members
    that have it. A set counts only shingles of sets that it may link to. Of two groups, the sets of the smaller one
    open the other, so that the members of a large group do not each meet all the small groups around it.
    """
    sizes = groups.groupBy("g").agg(F.count("*").alias("size"))
    placed = keep(join_groups(groups.select("cls", "g"), sizes, "g", "size", groups.count()), "placed")
    named = hits.select("cls", "n", "items").join(placed, "cls").select(F.explode("items").alias("t"), "cls", "n", "g", "size")
    named = named.repartition("t")  # neither the matrix nor the join deals its rows again
    union = named.groupBy("t", F.col("g").alias("u"), F.col("size").alias("u_size")).agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    may = named.join(union, "t").where("size < u_size or (size = u_size and g < u)")
    may = may.where((F.col("n_hi") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("n_lo") * percent))
    count = may.groupBy(F.col("cls").alias("a"), "n", F.col("u").alias("b")).agg(F.count("*").alias("k"))
    return count.where(F.col("k") >= least_of_any(F.col("n"), percent)).select("a", "b")


def _inner_links(groups: DataFrame, guests: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) within the groups, guests among their members, that links to the leaders do not imply.

    With c = (100 - percent) / (100 + percent) and v = |d| - c |x| for a set x and its difference d from the leader,
    two sets link if their differences share at least o = (v + v') / 2 shingles. A set that does not link to the leader
    has a greater v than all that do, and one of the two is such. So a set meets another one on the first |d| - o + 1
    shingles of its difference, with the least o that its partners in the group leave it. A pair that meets must have o
    shingles from there on, and o bits in common with the other's bitmap, before it is tested.
    """
    rows = groups.withColumn("guest", F.lit(False)).unionByName(
        guests.where("diff is not null").select(F.col("a").alias("cls"), F.col("b").alias("g"), "n", "m", "similar", "diff", "bits", F.lit(True).alias("guest"))
    )
    c = (100 - percent) / (100 + percent)
    rows = rows.where("size(diff) > 0").drop("m").withColumn("d", F.size("diff")).withColumn("v", F.col("d") - c * F.col("n"))
    # only groups with a row that does not link to the leader, and one more
    least = rows.groupBy("g").agg(F.count("*").alias("k"), F.min(F.when(F.col("similar"), F.col("v"))).alias("v_in"), F.min(F.when(~F.col("similar"), F.col("v"))).alias("v_out"))
    least = least.where("v_out is not null and k > 1").select("g", F.coalesce("v_in", "v_out").alias("v_in"), "v_out")
    rows = keep(rows.join(least, "g"), "rows")
    sure = lambda o: F.greatest(F.lit(1), F.ceil(o - 1e-6))
    first = F.col("d") - sure((F.col("v") + F.when(F.col("similar"), F.col("v_out")).otherwise(F.least("v_in", "v_out"))) / 2) + 1
    sent = rows.select(
        "g", "cls", "n", "similar", "guest", "d", "v", "bits", F.posexplode(F.slice("diff", F.lit(1), F.greatest(F.lit(0), first).cast("int"))).alias("pos", "t")
    )
    # x never links to the leader; y either does, or does not and has the smaller v
    x, y = (sent.select("g", "t", *[F.col(v).alias(f"{v}_{s}") for v in ("cls", "n", "similar", "guest", "d", "v", "bits", "pos")]) for s in "xy")
    share = (F.col("v_x") + F.col("v_y")) / 2 - 1e-6
    lacking = lambda p, q: sum((F.bit_count(F.get(p, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(q, F.lit(i))))) for i in range(BITMAP)), F.lit(0))
    meets = F.expr("cls_x <> cls_y and not (guest_x and guest_y) and (similar_y or v_y < v_x or (v_y = v_x and cls_y < cls_x))") & _sizes("n_x", "n_y", percent)
    meets = meets & (F.least(F.col("d_x") - F.col("pos_x"), F.col("d_y") - F.col("pos_y")) >= share)
    meets = meets & (F.col("d_x") - lacking("bits_x", "bits_y") >= share) & (F.col("d_y") - lacking("bits_y", "bits_x") >= share)
    pairs = x.where("not similar_x").join(y, (x["g"] == y["g"]) & (x["t"] == y["t"]) & meets)
    pairs = pairs.select(x["g"], F.col("cls_x").alias("a"), F.col("cls_y").alias("b")).distinct()
    side = lambda s, name: rows.select("g", F.col("cls").alias(name), F.col("n").alias(f"n_{s}"), F.col("diff").alias(f"d_{s}"))
    tested = pairs.join(side("x", "a"), ["g", "a"]).join(side("y", "b"), ["g", "b"])
    apart = F.size("d_x") + F.size("d_y") - 2 * F.size(F.array_intersect("d_x", "d_y"))
    both = (F.col("n_x") + F.col("n_y") - apart) / 2
    return tested.where(100 * both >= percent * (F.col("n_x") + F.col("n_y") - both)).select("a", "b")


def _sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


@within_bounds
def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, and text_hash.

    A document's set holds its distinct k-word shingles, A-Z lower-cased; with fewer words the whole sequence is one.
    Two documents link when 100 * intersection >= percent * union. component_id is the smallest doc_id that links
    reach. A document without words, or with null text, has an empty set and its own doc_id. Rows that repeat a doc_id
    are documents of their own; a null doc_id is no component_id unless all of the component's are null. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("node", F.xxhash64("doc_id", "text"))
    often = frequent_shingles(rows, k, rows.count())
    sets = keep(prefix_sets(rows, often, k, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    some = sets.where("n_shingles > 0")
    label = components(near_links(some, rows, k, percent))
    # one row a class: copies share it, and a hot class is combined before the shuffle
    least = some.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
    named = least.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left")
    named = named.withColumn("label", F.coalesce("label", "cls"))
    tops = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("docs").alias("in_component"))
    classes = named.where("docs > 1 or label <> cls").unionByName(
        named.where("docs = 1 and label = cls")
    ).join(tops, "label").where("in_component > 1").select("cls", "component_id")
    classes = keep(classes, "classes")
    out = sets.join(classes, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose component has a smaller doc_id: one document of each group stays.

    Rows with null doc_id stay. Rows that repeat doc_id and text stay or go together.
    """
    found = near_duplicates(docs, doc_id, text, k, percent)
    return without(docs, found.where("component_id < doc_id"), doc_id, text)
