"""What is kept between runs in folders that the driver and all executors share: generations of tables, and replies of a
call that are asked for once."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset and Spark runs in one process, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/attestry/{uuid.uuid4().hex}/{name}"


class Generations:
    """Tables that change together. A generation is a manifest, {number}.json, that names a folder for each table; the one of the
    largest number is current. Tables are written to folders of their own first, so a reader that has fixed a generation goes on
    seeing it, and a write that fails changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self.files = self._path("manifests").getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        root = self._path("manifests")
        names = [s.getPath().getName() for s in self.files.listStatus(root)] if self.files.exists(root) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def current(self) -> int:
        """The number of the current generation, 0 before the first."""
        return max(self.numbers(), default=0)

    def manifest(self, generation: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{generation:010}.json", wholetext=True).first()[0])

    def read(self, table: str, generation: int | None = None) -> DataFrame | None:
        """A table of a generation, by default of the current one; None before the first one that has it."""
        generation = self.current() if generation is None else generation
        path = self.manifest(generation).get(table) if generation else None
        return self.spark.read.parquet(f"{self.folder}/{path}") if path else None

    def publish(self, tables: dict[str, DataFrame], after: int | None = None) -> int:
        """Writes tables, and makes them current in one step, with those of the generation before that are not given. Returns the
        number of the new generation. Fails, and changes nothing, where another writer was faster."""
        after = self.current() if after is None else after
        named = dict(self.manifest(after)) if after else {}
        for name, rows in tables.items():
            named[name] = f"data/{uuid.uuid4().hex}/{name}"
            rows.write.parquet(f"{self.folder}/{named[name]}")
        ready, place = self._path(f"pending/{uuid.uuid4().hex}"), self._path(f"manifests/{after + 1:010}.json")
        out = self.files.create(ready, False)
        out.write(bytearray(json.dumps(named).encode()))
        out.close()
        self.files.mkdirs(self._path("manifests"))
        if self.files.exists(place) or not self.files.rename(ready, place):
            raise FileExistsError(f"generation {after + 1} of {self.folder} is there already")
        return after + 1

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the last generations and what only they name."""
        every = self.numbers()
        stay = {p for n in every[-keep:] for p in self.manifest(n).values()}
        for n in every[:-keep]:
            for path in set(self.manifest(n).values()) - stay:
                self.files.delete(self._path(path.rpartition("/")[0]), True)
            self.files.delete(self._path(f"manifests/{n:010}.json"), False)


def asked_once(
    texts: DataFrame, call: Callable[[list[str]], list], kind: str, path: str, column: str = "text", batch: int = 10,
) -> DataFrame:
    """texts with reply: what `call` gives for each text, a value of the type `kind`; e.g. an embedder or a text generator.

    Replies are kept at `path` by the SHA-256 of the text, and only texts that have none there are asked, each once however often it
    stands, in lists of at most `batch`. Null texts get a null reply. A call that fails fails the job; nothing is kept then. One
    writer at a time.
    """
    spark = texts.sparkSession
    named = texts.withColumn("_sha256", F.sha2(F.col(column), 256))
    wanted = named.where(F.col(column).isNotNull()).groupBy("_sha256").agg(F.any_value(column).alias("text"))
    try:
        wanted = wanted.join(spark.read.parquet(path).select(F.col("sha256").alias("_sha256")), "_sha256", "left_anti")
    except AnalysisException:  # nothing has been asked yet
        pass

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                some = part.iloc[a : a + batch]
                replies = call(some["text"].tolist())
                if len(replies) != len(some):
                    raise ValueError(f"{len(replies)} replies to {len(some)} texts")
                yield pd.DataFrame({"sha256": some["_sha256"].to_numpy(), "reply": pd.Series(list(replies), dtype=object)})

    wanted.mapInPandas(run, f"sha256 string, reply {kind}").write.mode("append").parquet(path)
    kept = spark.read.parquet(path).select(F.col("sha256").alias("_sha256"), "reply")
    return named.join(kept, "_sha256", "left").drop("_sha256")


def threshold(value: Column, bounds: list[tuple[float, str]], beyond: str) -> Column:
    """The name of the first bound that a value is below, or `beyond`; null for null. Bounds that a user gives, as one expression."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in sorted(bounds):
        out = out.when(value < bound, name)
    return out.otherwise(beyond)
