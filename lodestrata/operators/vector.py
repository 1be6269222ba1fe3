"""Vector search: cosine similarity of a stated query set against a whole corpus, in blocks of queries.

A block is a bounded matrix that is broadcast; each task multiplies it with a few rows at a time and keeps only partial
results over all its rows (best k per query, or sums per query and parent), so nothing of the size of queries x corpus
is made, in a task no more than HELD similarities at once. Of many blocks each one's result is written before the next is taken. ``operators/cells.py`` has the index that spares most of
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import over_blocks

#: Queries in a block.
BLOCK = 4096
#: Similarities that a task has at once; results that it keeps before it hands them on, by rows of OUT; pairs compared at once.
HELD, KEPT, OUT, PAIRS = 1 << 20, 1 << 21, 1 << 16, 1 << 13
#: By how much the product of two matrices may differ from a sum of products.
SLACK = 1e-12
#: Stands for a null parent.
NO_PARENT = np.iinfo(np.int64).min


def of_dimension(vectors: DataFrame, vector_col: str, dimension: int) -> DataFrame:
    """Rows whose vector has the corpus's dimension; null vectors and others go."""
    return vectors.where(F.size(vector_col) == dimension)


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _parents(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_PARENT).to_numpy()


def _table(schema: str, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in schema.split(", ")]
    for at in range(0, len(cols[0]), OUT):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + OUT], mask=c[at : at + OUT] == NO_PARENT if name == "parent" else None) for name, c in zip(names, cols)], names)


class Best:
    """The ``k`` most similar rows of each of the queries ``m`` (unit vectors) among those added so far; ties by id.

    A similarity beyond a query's k-th so far makes a row a candidate; candidates are compared by the sum of products of
    the two vectors alone, so equal vectors are equally similar wherever they stand.
    """

    def __init__(self, m: np.ndarray, k: int) -> None:
        self.m, self.k, self.bar = m, k, np.full(len(m), -np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.fresh: list[tuple] = []
        self.size = 0

    def add(self, who: np.ndarray, ids: np.ndarray, parents: np.ndarray, unit: np.ndarray, sims: np.ndarray) -> None:
        """``sims``: of the queries numbered ``who`` and the rows ``ids``, whose vectors are ``unit``."""
        fits = ~(sims < (self.bar[who] - SLACK)[:, None])
        if sims.shape[1] > self.k and np.count_nonzero(fits) > len(who) * self.k:
            kth = -np.partition(-sims, self.k - 1, axis=1)[:, self.k - 1]
            fits &= ~(sims < (kth - SLACK)[:, None])
        rows, at = np.nonzero(fits)
        if len(rows):
            own = who[rows]
            exact = np.concatenate([np.einsum("ij,ij->i", self.m[own[i : i + PAIRS]], unit[at[i : i + PAIRS]]) for i in range(0, len(own), PAIRS)])
            self.fresh.append((own, ids[at], parents[at], exact))
            self.size += len(own)
            if self.size - len(self.kept[0]) > len(self.m) * self.k:
                self.settle()

    def settle(self) -> None:
        if self.fresh:
            own, ids, parents, sims = (np.concatenate(c) for c in zip(self.kept, *self.fresh))
            order = np.lexsort((ids, -sims, own))
            place = np.arange(len(own)) - np.searchsorted(own[order], own[order])
            last = order[place == self.k - 1]
            self.bar[own[last]] = sims[last]
            order = order[place < self.k]
            self.kept, self.fresh, self.size = (own[order], ids[order], parents[order], sims[order]), [], len(order)


class _Nearest:
    """``Best`` over all rows, or with ``apart`` over those of each parent."""

    schema = "query_id long, vec_id long, parent long, similarity double"

    def __init__(self, own: np.ndarray, m: np.ndarray, k: int, least: float, apart: bool) -> None:
        self.own, self.m, self.k, self.least, self.apart = own, m, k, least, apart
        self.all, self.best = np.arange(len(own)), {}

    def add(self, ids: np.ndarray, parents: np.ndarray, unit: np.ndarray, sims: np.ndarray) -> None:
        for p in np.unique(parents).tolist() if self.apart else [None]:
            at = np.flatnonzero(parents == p) if self.apart else slice(None)
            self.best.setdefault(p, Best(self.m, self.k)).add(self.all, ids[at], parents[at], unit[at], sims[:, at])

    def full(self) -> bool:
        most = max(KEPT, 4 * len(self.own) * self.k)
        if sum(b.size for b in self.best.values()) + len(self.best) * len(self.own) <= most:
            return False
        for b in self.best.values():
            b.settle()
        return sum(b.size for b in self.best.values()) + len(self.best) * len(self.own) > most // 2

    def out(self) -> Iterator[pa.RecordBatch]:
        for b in self.best.values():
            b.settle()
            own, ids, parents, sims = b.kept
            good = ~(sims < self.least) if self.apart else sims >= self.least
            yield from _table(self.schema, [self.own[own[good]], ids[good], parents[good], sims[good]])


class _Statistics:
    schema = "query_id long, parent long, total double, most double, n long, vec_id long"

    def __init__(self, own: np.ndarray, m: np.ndarray) -> None:
        self.own, self.m, self.all, self.found = own, m, np.arange(len(own)), {}

    def add(self, ids: np.ndarray, parents: np.ndarray, unit: np.ndarray, sims: np.ndarray) -> None:
        for p in np.unique(parents).tolist():
            at = np.flatnonzero(parents == p)
            best, total, n = self.found.get(p) or (Best(self.m, 1), 0.0, 0)
            best.add(self.all, ids[at], parents[at], unit[at], sims[:, at])
            self.found[p] = best, total + sims[:, at].sum(axis=1), n + len(at)

    def full(self) -> bool:
        return 4 * len(self.found) * len(self.own) > KEPT

    def out(self) -> Iterator[pa.RecordBatch]:
        for best, total, n in self.found.values():
            best.settle()
            _, ids, parents, most = best.kept  # one row for each query
            yield from _table(self.schema, [self.own, parents, total, np.where(np.isnan(total), np.nan, most), np.full(len(self.own), n), ids])


class _Above:
    schema = "query_id long, item_id long, above long"

    def __init__(self, own: np.ndarray, m: np.ndarray, item_id: np.ndarray, similarity: np.ndarray) -> None:
        self.own, self.item_id, self.bar = own, item_id, similarity + 1e-12
        self.above = np.zeros(len(own), np.int64)

    def add(self, ids: np.ndarray, parents: np.ndarray, unit: np.ndarray, sims: np.ndarray) -> None:
        self.above += ((sims > self.bar[:, None]) & (ids[None, :] != self.item_id[:, None])).sum(axis=1)

    def full(self) -> bool:
        return False

    def out(self) -> Iterator[pa.RecordBatch]:
        yield from _table(self.schema, [self.own, self.item_id, self.above])


def _scan(queries: DataFrame, corpus: DataFrame, partial: type, extra: tuple[str, ...] = (), **options) -> DataFrame:
    """What ``partial(query ids, unit vectors)`` comes to for every block and task. It is given rows with their
    similarities, HELD of these at once; when it is full, what it has is handed on and another one begins.
    ``extra`` columns of the queries are handed on as arrays by name."""

    def against(block: DataFrame) -> DataFrame:
        found = block.toArrow()  # one block
        m = _unit(found.column("vector").combine_chunks())
        ids, more = found.column("query_id").to_numpy(), {c: found.column(c).to_numpy() for c in extra}
        shared = corpus.sparkSession.sparkContext.broadcast((ids, m, more | options))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, m, more = shared.value
            if not len(own):
                return
            state, step = partial(own, m, **more), max(1, HELD // len(own))
            for batch in batches:
                for piece in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                    unit = _unit(piece.column(2))
                    state.add(piece.column(0).to_numpy(), _parents(piece.column(1)), unit, m @ unit.T)
                    if state.full():
                        yield from state.out()
                        state = partial(own, m, **more)
            yield from state.out()

        return corpus.select(F.col("vec_id").cast("long"), F.col("parent").cast("long"), "vector").mapInArrow(run, partial.schema)

    return over_blocks(queries, "query_id", BLOCK, against)


def knn(queries: DataFrame, corpus: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, vec_id, parent, similarity, rank): the ``k`` most similar rows of each query; ties by id.

    ``queries``: (query_id, vector); ``corpus``: (vec_id, parent, vector).
    """
    best = _scan(queries, corpus, _Nearest, k=k, least=least, apart=False)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_by_parent(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar rows of each query within each parent, with their rank there."""
    best = _scan(queries, corpus, _Nearest, k=k, least=-np.inf, apart=True)
    w = Window.partitionBy("query_id", "parent").orderBy(F.desc("similarity"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parent_statistics(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, parent, most, mean, n, nearest): over all rows of each parent."""
    parts = _scan(queries, corpus, _Statistics)
    best = F.max(F.struct("most", F.bitwise_not("vec_id").alias("least"), "vec_id"))
    return parts.groupBy("query_id", "parent").agg(F.max("most").alias("most"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"), best.alias("best")).withColumn("nearest", F.col("best.vec_id")).drop("best")


def rank_of(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, item_id, similarity, rank) of stated pairs (query_id, item_id): how many rows are more similar, plus one."""
    own = pairs.join(queries, "query_id").join(corpus.select(F.col("vec_id").alias("item_id"), F.col("vector").alias("item")), "item_id")
    known = own.select("query_id", "item_id", "vector", cosine("vector", "item").alias("similarity"))
    counted = _scan(known, corpus, _Above, ("item_id", "similarity")).groupBy("query_id", "item_id").agg(F.sum("above").alias("above"))
    return known.join(counted, ["query_id", "item_id"]).select("query_id", "item_id", "similarity", (F.col("above") + 1).alias("rank"))


def cosine(a: str, b: str):
    """Cosine of two array columns, inside the JVM; for few pairs."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)) for c in (a, b)]
    return dot / (norm[0] * norm[1])


def ladder(scored: DataFrame, steps: tuple[float, ...], key: str = "query_id", score: str = "similarity") -> DataFrame:
    """Per key the rows at or above the first step that any of its rows reaches; none if no step is reached."""
    top = F.max(score).over(Window.partitionBy(key))
    step = F.lit(None).cast("double")
    for s in sorted(steps):
        step = F.when(top >= s, s).otherwise(step)
    return scored.withColumn("step", step).where(F.col(score) >= F.col("step"))


def keep_best(primary: DataFrame, secondary: DataFrame, keys: list[str], score: str = "similarity") -> DataFrame:
    """Union of two result lists with the higher score per key; on a tie the primary's."""
    both = primary.withColumn("_from", F.lit(0)).unionByName(secondary.withColumn("_from", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "_from")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")
