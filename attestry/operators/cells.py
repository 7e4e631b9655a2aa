"""Cosine top-k from stored cells of vectors: only the cells that can hold a hit are read.

Vectors of length 1 are put into the cell of the nearest of some centres (k-means over a bounded sample), and each cell knows
how far its vectors lie from its centre. A question reads its nearest cells first; what it finds there bounds the distance of
anything better, and only cells that come as near as that are read besides. Vectors of length 0 are a cell of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .retrieve import Best, blocks_of, top_k

#: Vectors that centres are fitted on at most, and questions of a pass.
SAMPLE, QUESTIONS = 20_000, 5_000
#: Scores are rounded to so many digits; a bound must pass them by as much.
DIGITS, SLACK = 9, 1e-7


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.array(column.tolist(), float)
    return m.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def write_cells(vectors: DataFrame, folder: str, cells: int = 64, seed: int = 7) -> None:
    """Stores vectors (vec_id, embedding) by cell, all of them, and the table of cells: cell, centre, radius, n.

    Centres are fitted on SAMPLE vectors at most, those of the least hashes of vec_id. A cell that very many vectors fall into is
    written by several tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    unit = _unit(_matrix(sample["embedding"])) if len(sample) else np.zeros((0, 0))
    unit = unit[np.linalg.norm(unit, axis=1) > 0.5] if len(unit) else unit
    centres = np.zeros((0, unit.shape[1] if len(unit) else 0))
    if len(unit):
        rows = spark.createDataFrame([(x,) for x in unit.tolist()], "v array<double>").select(array_to_vector("v").alias("features"))
        centres = np.array(KMeans(k=max(2, min(cells, len(unit))), seed=seed, maxIter=10).fit(rows).clusterCenters())

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = _unit(_matrix(pdf["embedding"]))
            if len(centres):
                far = (v**2).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres**2).sum(axis=1)[None]
                cell = far.argmin(axis=1)
                away = np.linalg.norm(v - centres[cell], axis=1)
            else:
                cell, away = np.full(len(v), -1), np.zeros(len(v))
            none = np.linalg.norm(v, axis=1) < 0.5
            cell, away = np.where(none, -1, cell), np.where(none, 0.0, away)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "unit": list(v), "away": away, "cell": cell})

    placed = vectors.select("vec_id", "embedding").mapInPandas(assign, f"vec_id {dict(vectors.dtypes)['vec_id']}, unit array<double>, away double, cell int")
    placed.repartitionByRange("cell", "vec_id").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    known = spark.read.parquet(f"{folder}/vectors").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).toPandas()
    known["centre"] = [centres[c].tolist() if c >= 0 else [] for c in known["cell"]]
    rows = list(known[["cell", "centre", "radius", "n"]].itertuples(index=False, name=None))
    spark.createDataFrame(rows, "cell int, centre array<double>, radius double, n long").write.mode("overwrite").parquet(f"{folder}/cells")


def _hits(spark: SparkSession, folder: str, ids: np.ndarray, q: np.ndarray, wanted: dict[int, np.ndarray], k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): the best k of each task and question, of the vectors whose cells the question wants."""
    stored = spark.read.parquet(f"{folder}/vectors").where(F.col("cell").isin([c for c, some in wanted.items() if len(some)]))
    shared = spark.sparkContext.broadcast((ids, q, wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, wanted = shared.value
        best = Best(k, len(ids))
        for pdf in blocks_of(batches, len(ids)):
            for cell, part in pdf.groupby("cell"):
                some = wanted[cell]
                best.add((), some, part["vec_id"].to_numpy(), np.round(q[some] @ np.array(part["unit"].tolist()).T, DIGITS))
        for _, i, vec, score in best.hits():
            yield pd.DataFrame({"query_id": ids[i], "vec_id": vec, "score": score})

    return stored.select("vec_id", "unit", "cell").mapInPandas(run, f"query_id {kind}, vec_id {dict(stored.dtypes)['vec_id']}, score double")


def ask_cells(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, probes: int | None = 8, exact: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank) of queries (query_id, embedding), from the cells of write_cells.

    `probes` nearest cells are read for each question, or all with None. With `exact`, so are all cells that can hold a better hit than the k-th
    that was found: the result is that of retrieve.cosine_top_k. Questions go to the workers in passes of QUESTIONS.
    """
    from ..sources.store import scratch

    cells = spark.read.parquet(f"{folder}/cells").toPandas()
    real = cells[cells["cell"] >= 0]
    centres = np.array(real["centre"].tolist()) if len(real) else np.zeros((0, 0))
    numbers, radius = real["cell"].to_numpy(), real["radius"].to_numpy()
    kind, out = dict(queries.dtypes)["query_id"], None
    passes = max(1, -(-queries.count() // QUESTIONS))
    for part in range(passes):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == part).toPandas()
        ids, q = own["query_id"].to_numpy(), _unit(_matrix(own["embedding"])) if len(own) else np.zeros((0, centres.shape[1]))
        every = np.arange(len(ids))
        far = np.linalg.norm(q[:, None] - centres[None], axis=2) if len(centres) and len(ids) else np.zeros((len(ids), len(centres)))
        taken = np.ones(far.shape, bool)
        if probes is not None and probes < len(numbers):
            taken[:] = False
            np.put_along_axis(taken, np.argpartition(far, probes - 1, axis=1)[:, :probes], True, axis=1)
        wanted = {int(c): every[taken[:, i]] for i, c in enumerate(numbers)} | ({-1: every} if (cells["cell"] == -1).any() else {})
        path = scratch(spark, "hits")
        _hits(spark, folder, ids, q, wanted, k, kind).write.parquet(path)
        found = spark.read.parquet(path)
        if exact and not taken.all():
            best = top_k(found, k, ["query_id"], [F.desc("score"), F.col("vec_id")]).where(F.col("rank") == k).select("query_id", "score").toPandas()
            place = {x: i for i, x in enumerate(ids.tolist())}
            worst = np.full(len(ids), -1.0)
            worst[[place[x] for x in best["query_id"].tolist()]] = best["score"].to_numpy()
            reach = np.sqrt(np.maximum(0, 2 - 2 * worst)) + SLACK  # unit vectors of a score s are sqrt(2 - 2 s) apart
            unit = np.linalg.norm(q, axis=1) > 0.5
            more = ~taken & ((far - radius[None] <= reach[:, None]) | ~unit[:, None])
            wanted = {int(c): every[more[:, i]] for i, c in enumerate(numbers)}
            if more.any():
                found = found.unionByName(_hits(spark, folder, ids, q, wanted, k, kind))
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, ["query_id"], [F.desc("score"), F.col("vec_id")])
