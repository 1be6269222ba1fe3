"""Evaluation: retrieval metrics, scenario scores, run comparison, gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """P@1, P@3, P@5 and MRR@10 over queries; a null rank is a miss."""
    r = F.col(rank)
    at = [F.avg(F.coalesce(r <= k, F.lit(False)).cast("int")).alias(f"p_at_{k}") for k in (1, 3, 5)]
    return ranks.agg(F.count("*").alias("n"), *at, F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)).alias("mrr_at_10"))


def matched(expected: Column, actual: Column) -> tuple[Column, Column]:
    """(matched, total) of expected keys; null lists are empty."""
    none = F.array().cast("array<string>")
    e = F.array_distinct(F.coalesce(expected, none))
    return F.size(F.array_intersect(e, F.coalesce(actual, none))), F.size(e)


def scenario_passes(all_matched: Column, forbidden_hits: Column) -> Column:
    return all_matched & (forbidden_hits == 0)


def compare_runs(runs: DataFrame, which: Column, metrics: dict[str, Column]) -> DataFrame:
    """Differences of two runs' mean metrics, in percentage points: of the rows for which ``which`` is true against the
    others. One pass over all rows; no join."""
    of = lambda m, side: F.avg(F.when(which if side else ~which, m))
    return runs.agg(*(F.round(100 * (of(m, True) - of(m, False)), 2).alias(f"{name}_change") for name, m in metrics.items()))


def by_longest_prefix(rows: DataFrame, rates: DataFrame, name: str, prefix: str, default: str | None = None) -> DataFrame:
    """``rows`` with the columns of the entry of ``rates`` that is the longest beginning of ``name``; where none is, of
    the entry named ``default``, or nulls without one. An empty prefix fits all names but null.

    Names are joined by their own beginnings, an equi-join: only distinct names are expanded, by one row a character.
    Entries are distinct.
    """
    if rates.columns.count(prefix) != 1 or set(rates.columns) & set(rows.columns):
        raise ValueError("rates have columns of their own")
    names = rows.select(name).distinct().withColumn("_own", F.explode(F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substring(name, 1, n))))
    keys = rates.select(F.col(prefix).alias("_fit")).where(F.col("_fit") != default) if default is not None else rates.select(F.col(prefix).alias("_fit"))
    best = names.join(keys, F.col("_own") == F.col("_fit")).groupBy(F.col(name).alias("_name")).agg(F.max_by("_fit", F.length("_fit")).alias("_fit"))
    told = rows.join(best, F.col(name) == F.col("_name"), "left").withColumn("_fit", F.coalesce("_fit", F.lit(default)))
    return told.join(rates, F.col("_fit") == F.col(prefix), "left").select(*rows.columns, *rates.columns)


def stratified(rows: DataFrame, stratum: str, id_col: str, n: int) -> DataFrame:
    """``n`` rows of each stratum, taken by a hash of the id."""
    from .fuse import top_per

    return top_per(rows.withColumn("_h", F.md5(F.col(id_col).cast("string"))), [stratum], n, F.col("_h"), F.col(id_col)).drop("_h")
