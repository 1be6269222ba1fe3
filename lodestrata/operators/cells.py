"""An approximate index for vector search: coarse cells with inverted lists as partitioned Parquet.

Cells are the clusters of a bounded sample (spherical k-means on Spark); every row of the corpus is written to the cell
of its nearest centre. A search compares a query with the rows of its nearest ``probes`` cells only, so of the corpus it
reads the partitions that any query asks for and multiplies each row with the queries that ask for its cell.
``vector.knn`` is the exact search; queries whose cells hold fewer than k rows that fit are handed to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, over_blocks
from . import vector

#: Sampled rows for each cell, in expectation.
SAMPLED = 256
#: Rows of a cell that go to one file; larger cells are dealt over several writers.
FILE_ROWS = 1 << 20
FOUND = "query_id long, vec_id long, parent long, similarity double"


def _unit_column(name: str):
    norm = F.sqrt(F.aggregate(F.transform(name, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    return F.transform(name, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-300)))


def centres(corpus: DataFrame, cells: int, sampled: int = SAMPLED, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit vectors in the middle of up to ``cells`` clusters, fitted on ``cells`` * ``sampled`` rows in expectation."""
    share = min(1.0, cells * sampled / max(1, corpus.count()))
    drawn = corpus.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))
    rows = cut(drawn.select(_unit_column("vector").alias("v")).where(F.exists("v", lambda x: x != 0)).select(array_to_vector("v").alias("features")), "sample")
    if not rows.head(1):
        return np.zeros((0, 0))
    found = np.array(KMeans(k=max(2, cells), maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(rows).clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def build(corpus: DataFrame, path: str, cells: int, **fit) -> None:
    """Write the index of ``corpus`` (vec_id, parent, vector) to ``path``: a Parquet partition for each cell, and the
    centres. Every row is indexed; rows with a null vector are none."""
    spark, rows = corpus.sparkSession, corpus.where("vector is not null")
    middle = centres(rows, cells, **fit)
    shared = spark.sparkContext.broadcast(middle)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (vector._unit(batch.column(2)) @ shared.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["vec_id", "parent", "vector", "cell"])

    # cells are dealt by their size: a cell with a third of all rows has a third of the writers
    told = rows.select(F.col("vec_id").cast("long"), F.col("parent").cast("long"), F.col("vector").cast("array<float>")).mapInArrow(placed, "vec_id long, parent long, vector array<float>, cell int")
    told = cut(told, "placed")
    sizes = told.groupBy("cell").agg(F.count("*").alias("n"))  # a row for each cell
    part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / FILE_ROWS))
    told.join(F.broadcast(sizes), "cell").repartition("cell", part).drop("n").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middle)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, parent long, vector array<float>, cell int").parquet(f"{path}/lists")


def _nearest(matrix: np.ndarray, middle: np.ndarray, probes: int) -> np.ndarray:
    probes = min(probes, len(middle))
    return np.argsort(-(matrix @ middle.T), axis=1, kind="stable")[:, :probes]


def search(queries: DataFrame, path: str, k: int, probes: int = 8, least: float = -1.0) -> DataFrame:
    """(query_id, vec_id, parent, similarity, rank) as ``vector.knn`` gives it, from each query's nearest ``probes`` cells.

    ``queries``: (query_id, vector), a stated set, in blocks. A query that finds fewer than ``k`` rows in its cells is
    searched exactly over all of them, so nobody gets too little because of the index. Similarities are of the stored
    32-bit vectors.
    """
    spark = queries.sparkSession
    middle = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # a row for each cell

    def of_block(block: DataFrame) -> DataFrame:
        found = block.toArrow()
        matrix, ids = vector._unit(found.column("vector").combine_chunks()), found.column("query_id").to_numpy()
        asked: dict[int, list[int]] = {}
        for i, own in enumerate(_nearest(matrix, middle, probes) if len(ids) and len(middle) else []):
            for c in own.tolist():
                asked.setdefault(c, []).append(i)
        shared = spark.sparkContext.broadcast((ids, matrix, {c: np.array(v) for c, v in asked.items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, m, by_cell = shared.value
            best = vector.Best(m, k)
            for batch in batches:
                cell, vec, parent = batch.column(3).to_numpy(), batch.column(0).to_numpy(), vector._parents(batch.column(1))
                unit = vector._unit(batch.column(2))
                for c in np.unique(cell).tolist():
                    rows, every = by_cell[c], np.flatnonzero(cell == c)
                    step = max(1, vector.HELD // len(rows))
                    for at in (every[i : i + step] for i in range(0, len(every), step)):
                        best.add(rows, vec[at], parent[at], unit[at], m[rows] @ unit[at].T)
            best.settle()
            who, vec, parent, sims = best.kept
            good = sims >= least
            yield from vector._table(FOUND, [own[who[good]], vec[good], parent[good], sims[good]])

        kept = lists(spark, path).where(F.col("cell").isin(sorted(asked)))
        return kept.mapInArrow(run, FOUND)

    near = over_blocks(queries, "query_id", vector.BLOCK, of_block)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    best = cut(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "near")
    short = cut(queries.join(best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti").select("query_id", "vector"), "short")
    if not short.head(1):
        return best
    exact = vector.knn(short, lists(spark, path).drop("cell"), k, least)
    return best.join(short.select("query_id"), "query_id", "left_anti").unionByName(exact.select(*best.columns))


def measured(queries: DataFrame, corpus: DataFrame, path: str, k: int, probes: int) -> dict[str, float]:
    """``recall`` of the index against exact search; ``cells_share`` and ``rows_share`` of the index that a query is compared
    with, on average."""
    exact = vector.knn(queries, corpus, k).select("query_id", "vec_id")
    found = search(queries, path, k, probes).select("query_id", "vec_id")
    hit, of = found.join(exact, ["query_id", "vec_id"], "left_semi").count(), exact.count()
    spark = queries.sparkSession
    middle = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    size = np.zeros(len(middle), dtype=np.int64)
    for r in lists(spark, path).groupBy("cell").count().collect():
        size[r["cell"]] = r["count"]

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(vector._unit(batch.column(0)), middle, probes)
            yield pa.RecordBatch.from_arrays([pa.array(size[near].sum(axis=1))], ["n"])

    rows = queries.select("vector").mapInArrow(looked_at, "n long").agg(F.avg("n")).first()[0]
    return {"recall": hit / max(1, of), "cells_share": min(probes, len(middle)) / max(1, len(middle)), "rows_share": rows / max(1, int(size.sum()))}
