"""Window operators: gaps in sequences, budgets, leads, shares, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Per key the numbers missing between its first and last index, and the first."""
    found = rows.groupBy(key).agg(F.min(index).alias("starts_at"), F.max(index).alias("ends_at"), F.collect_set(index).alias("_i"))
    missing = F.array_except(F.sequence("starts_at", "ends_at"), "_i")
    return found.select(key, "starts_at", "ends_at", F.size(missing).alias("n_missing"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def budget(rows: DataFrame, keys: list[str], order: list[Column], wanted: Column, total: int) -> DataFrame:
    """Greedy allocation in order: each takes what it wants as far as the budget goes."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(wanted).over(w), F.lit(0))
    return rows.withColumn("taken", F.least(wanted, F.greatest(F.lit(0), total - before)))


def share(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with n, the key's rows that have a value, and same, those with this row's value.

    Counted before the shuffle and joined back, so that a key of very many rows is no single group.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("same"))
    whole = per.groupBy(*keys).agg(F.sum("same").alias("n"))
    zero = F.lit(0).cast("long")
    joined = rows.join(whole, keys, "left").join(per, [*keys, value], "left")
    return joined.select(*rows.columns, F.coalesce("n", zero).alias("n"), F.coalesce("same", zero).alias("same"))


def outliers(rows: DataFrame, keys: list[str], value: str, least: int = 4, below: float = 0.20) -> DataFrame:
    flagged = share(rows, keys, value)
    return flagged.withColumn("outlier", (F.col("n") >= least) & F.col(value).isNotNull() & (F.col("same") < below * F.col("n")))


def trend(rows: DataFrame, key: str, late: Column, hit: Column, least: int = 2, shift: float = 0.30) -> DataFrame:
    """Hit rates before and after; flagged if both periods have rows enough and the rates differ by ``shift``."""
    agg = rows.groupBy(key).agg(F.count_if(~late).alias("n_early"), F.count_if(late).alias("n_late"), F.count_if(~late & hit).alias("hit_early"), F.count_if(late & hit).alias("hit_late"))
    moved = F.abs(F.col("hit_late") * F.col("n_early") - F.col("hit_early") * F.col("n_late")) >= shift * F.col("n_early") * F.col("n_late")
    return agg.withColumn("shifted", (F.col("n_early") >= least) & (F.col("n_late") >= least) & moved)


def current_version(rows: DataFrame, key: str, *latest: str | Column) -> DataFrame:
    """``rows`` with is_current: true for the row of its key with the highest values of ``latest``, nulls lowest, which
    must tell rows apart. Compared before the shuffle and joined back, so that a key of very many rows is no single group."""
    top = rows.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*latest)).alias("_top"))
    joined = rows.join(top, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn("is_current", F.struct(*latest).eqNullSafe(F.col("_top"))).drop("_key", "_top")
