"""What the training-data operators share: the shared folder, skew-proof joins and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key with at least 1/HEAVY_PARTS of all rows is heavy; there are at most HEAVY_PARTS such keys.
HEAVY_PARTS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attestry/{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_UNITS = {"": 1, "b": 1, **{u + e: 1 << 10 * i for i, u in enumerate("kmgtp", 1) for e in ("", "b")}}


def byte_size(value: str) -> int:
    """A size as Spark's settings write it: a number, with a unit or none."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", value.lower()).groups()
    return int(number) * _UNITS[unit]


def set_bounds(spark: SparkSession, most: int = 2 << 20, rows: int = 512) -> dict[str, str]:
    """Bounds what is held of long texts at once: `most` bytes in an Arrow batch to Python, `rows` rows in one that the
    Parquet reader makes. Lower settings stay. Returns the settings as they were; for a session of one's own."""
    settings = {"spark.sql.execution.arrow.maxBytesPerBatch": most, "spark.sql.parquet.columnarReaderBatchSize": rows}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        if byte_size(before[name]) > value:
            spark.conf.set(name, str(value))
    return before


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """set_bounds while it lasts; all settings are put back afterwards."""
    before = set_bounds(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def within_bounds(operator):
    """Runs an operator on a DataFrame within `bounded`: what it writes on the way is bounded so. The plan that it returns
    runs later, under the session's own settings."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options):
        with bounded(df.sparkSession):
            return operator(df, *args, **options)

    return run


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where docs has such a column already."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def local_path(path: str) -> str | None:
    """The path of a file that is mounted on this machine; None where another file system holds it."""
    if path.startswith(("file:", "/")):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None


def open_shared(path: str, mode: str):
    """Opens a file of the shared folder in a task: mode "rb" can seek, "wb" writes a new file."""
    local = local_path(path)
    if local is not None:
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    system, inner = fs.FileSystem.from_uri(path)
    if mode == "wb":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_input_file(inner) if mode == "rb" else system.open_output_stream(inner)


def map_file(path: str) -> np.ndarray:
    """The bytes of a shared file that is not empty, mapped into memory; without a mount it is copied to an unnamed file."""
    local = local_path(path)
    if local is None:
        local = tempfile.TemporaryFile()
        with open_shared(path, "rb") as source:
            while chunk := source.read(1 << 22):
                local.write(chunk)
        local.flush()
    return np.memmap(local, np.uint8, "r")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str, most: int = 2_000_000) -> DataFrame:
    """docs without the rows that gone (doc_id, text_hash) names; null ids are ids. A list of up to `most` is broadcast."""
    a, b = unused(docs, "gone_id", "gone_hash")
    gone = keep(gone.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)).distinct(), "gone")
    match = docs[doc_id].eqNullSafe(gone[a]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone[b])
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, match, "left_anti")


def bucket_of(spark_id: Column, salt: str, modulus: int) -> Column:
    """The remainder of crc32 of an id written as text; the split of the held-out rows."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), spark_id.cast("string")).cast("binary")), F.lit(modulus))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key, size = the key's rows in rows), without a hot task.

    Keys that hold 1/HEAVY_PARTS of total or more are broadcast: there are at most HEAVY_PARTS of them.
    All others are too small to be hot and are joined by shuffle.
    """
    least = max(2, -(-total // HEAVY_PARTS))
    heavy = F.broadcast(groups.where(F.col(size) >= least))
    light = groups.where(F.col(size) < least)
    return rows.join(heavy, key).unionByName(
        rows.join(heavy.select(key), key, "left_anti").join(light, key, how), allowMissingColumns=True
    )


#: Edges of one task when components are contracted.
CHUNK_EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a task as stars: an edge from each node to the least node that these edges lead to."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        while ((further := new[new]) != new).any():
            new = further
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of the edges: label is the smallest node that can be reached.

    Tasks contract CHUNK_EDGES edges each to stars, where they lie. As long as more than one task is needed, rounds of
    alternating large stars and small stars join what the tasks found. A round groups by node only to find a minimum,
    which is combined before the shuffle, so a node with very many neighbours is no hot task. The driver sees one count
    a round.
    """
    hooks = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    hooks = keep(hooks, "edges")
    last = None
    for _ in range(max_rounds):
        count, digest = hooks.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, digest) == last:
            break
        last = (count, digest)
        chunks = max(1, -(-count // CHUNK_EDGES))
        hooks = keep(hooks.coalesce(chunks).mapInArrow(_contract, "u long, v long"), "edges")
        if chunks == 1:
            break
        # large star: every larger neighbour of u hangs on the smallest of u's closed neighbourhood
        both = hooks.unionByName(hooks.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u")
        hooks = keep(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_min.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = hooks.select(F.col("v").alias("node")).distinct()
    return hooks.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
