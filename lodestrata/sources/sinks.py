"""Sinks as whole-table merges: each gives the table's new content, to be written over a partition or as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(incoming: DataFrame, target: DataFrame, key: str, hash_col: str) -> DataFrame:
    """``incoming`` with ``change``: new, changed or same, by a hash of the content."""
    old = target.select(key, F.col(hash_col).alias("_old"))
    return incoming.join(old, key, "left").withColumn("change", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(hash_col), "same").otherwise("changed")).drop("_old")


def replace_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of changed parents go, the fresh ones come."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(fresh)


def one_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``, then by the rows' JSON, so that which one stays is defined; null keys are
    a key. Rows are compared before the shuffle, so a key that very many rows have is no group in one task."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.to_json(whole).alias("j"))
    return rows.groupBy(*keys).agg(F.min_by(whole, place).alias("_row")).select("_row.*")


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The target and, of those incoming rows whose key it lacks, the first of each key (see ``one_per_key``)."""
    return target.unionByName(one_per_key(incoming.select(*target.columns), keys, *order).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first incoming row of each key (see ``one_per_key``), and the target's others."""
    new = one_per_key(incoming.select(*target.columns), keys, *order)
    return target.join(new.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new)


def update_columns(target: DataFrame, values: DataFrame, key: str, columns: list[str], *order: Column) -> DataFrame:
    """The target with ``columns`` taken from the first row of ``values`` of its key (see ``one_per_key``); rows without
    one keep theirs. No row is added or lost."""
    values = one_per_key(values.select(key, *columns), [key], *order)
    new = values.select(key, F.lit(True).alias("_has"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = target.join(new, key, "left")
    return joined.select(*(F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def differing(child: DataFrame, parent: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Child rows whose copied columns differ from the parent's, nulls being equal to nulls."""
    up = parent.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns))
    differs: Column = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return child.join(up, key).where(differs).select(*child.columns)


def request_lines(rows: DataFrame, path: str, *columns: str) -> None:
    """A JSON line for each row."""
    rows.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)
