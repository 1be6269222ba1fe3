"""Backfills that can be resumed: key ranges worked on one after the other, and a ledger of the finished ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A range without rows has no file, so the ledger alone says that it is done.
_LEDGER = "low long, high long, n long"


def key_ranges(rows: DataFrame, key: str, number: int) -> list[tuple[int, int]]:
    """Up to ``number`` ranges (low, high), both included, of about equally many rows, that cover all keys. Null keys
    are in none."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    edges = sorted({int(e) for e in rows.stat.approxQuantile(key, [i / number for i in range(1, number)], 0.1 / number)}) if number > 1 else []
    starts = [int(low), *(e for e in edges if low < e <= high)]
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], int(high) + 1], strict=True)]


def finished(rows: DataFrame, path: str) -> list[tuple[int, int]]:
    """The ranges that the ledger at ``path`` has."""
    spark = rows.sparkSession
    spark.createDataFrame([], _LEDGER).write.mode("ignore").parquet(f"{path}/ledger/range=none")
    return sorted((r["low"], r["high"]) for r in spark.read.schema(_LEDGER).parquet(f"{path}/ledger").collect())  # a row for each range


def run(rows: DataFrame, key: str, path: str, number: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write ``work(rows of a range)`` for each range to ``path`` and give all of it.

    A range is in the ledger once its rows are written; a run that was killed goes on with the others, and writes the
    range it was at anew. Ranges are drawn once and kept beside the ledger, so rows that come later do not move them;
    keys beyond them are ranges of their own.
    """
    spark, done = rows.sparkSession, set(finished(rows, path))
    drawn = spark.createDataFrame([], _LEDGER).select("low", "high")
    drawn.write.mode("ignore").parquet(f"{path}/ranges/part=none")
    ranges = sorted((r["low"], r["high"]) for r in spark.read.schema("low long, high long").parquet(f"{path}/ranges").collect())  # a row for each range
    outside = rows.where((F.col(key) < ranges[0][0]) | (F.col(key) > ranges[-1][1])) if ranges else rows
    fresh = []
    for side in ([outside.where(F.col(key) < ranges[0][0]), outside.where(F.col(key) > ranges[-1][1])] if ranges else [rows]):
        fresh += key_ranges(side, key, number if not ranges else 1)
    if fresh:
        spark.createDataFrame(fresh, "low long, high long").coalesce(1).write.mode("append").parquet(f"{path}/ranges/part=drawn")
    for low, high in sorted({*ranges, *fresh} - done):
        out = work(rows.where(F.col(key).between(low, high)))
        out.write.mode("overwrite").parquet(f"{path}/rows/range={low}")
        n = spark.read.schema(out.schema).parquet(f"{path}/rows/range={low}").count()
        spark.createDataFrame([(low, high, n)], _LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/range={low}")
    schema = work(rows.where("false")).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows") if ranges or fresh else spark.createDataFrame([], schema)
