"""Tables that change in place: hash buckets of Parquet, copied on write, and a manifest for each version.

A key's rows stand in the bucket of its hash. A merge reads and writes the buckets that it touches, into a new folder;
the other buckets stay where they are. A version is a manifest (a small table: bucket, folder, rows) that names a
folder for each bucket, and it is there once its manifest is: a merge that fails before leaves the version before as
it was. Folders that no version names are left by failed merges and may be deleted.

One writer merges at a time: a second one that writes the same version fails, and its merge is to be repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut
from .sinks import one_per_key

_MANIFEST = "version int, bucket int, folder string, n long, buckets int, keys string"
#: Whatever a row holds, as one number; rows with equal numbers and keys count as unchanged.
_HASH = "_content"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, path: str, keys: list[str], buckets: int) -> tuple[str, dict[int, int]]:
    """Write rows by bucket into a folder of their own; the folder, and the rows of each bucket."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    back = rows.sparkSession.read.schema(f"{_ddl(rows)}, bucket int").parquet(f"{path}/{folder}")
    return folder, {r["bucket"]: r["n"] for r in back.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row for each bucket


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _commit(spark: SparkSession, path: str, version: int, entries: list[tuple[int, str, int]], buckets: int, keys: list[str]) -> int:
    lines = [(b, folder, n, buckets, ",".join(keys)) for b, folder, n in entries] or [(-1, "", 0, buckets, ",".join(keys))]
    spark.createDataFrame(lines, "bucket int, folder string, n long, buckets int, keys string").coalesce(1).write.mode("error").parquet(f"{path}/versions/version={version}")
    return version


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64, *order: Column) -> int:
    """Version 0: the first row of each key (see ``sinks.one_per_key``)."""
    folder, sizes = _written(one_per_key(rows, keys, *order), path, keys, buckets)
    return _commit(rows.sparkSession, path, 0, [(b, folder, n) for b, n in sizes.items()], buckets, keys)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The manifest of a version, of the last one by default."""
    every = spark.read.schema(_MANIFEST).parquet(f"{path}/versions")
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def _of(spark: SparkSession, path: str, schema: str, entries: list) -> DataFrame:
    if not entries:
        return spark.createDataFrame([], schema)
    folders: dict[str, list[int]] = {}
    for e in entries:
        folders.setdefault(e["folder"], []).append(e["bucket"])
    parts = [f"{path}/{folder}/bucket={b}" for folder, own in sorted(folders.items()) for b in sorted(own)]
    return spark.read.schema(schema).parquet(*parts)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the last one by default."""
    return _of(spark, path, schema, manifest(spark, path, version).where("bucket >= 0").collect())  # a row for each bucket


def merge(incoming: DataFrame, path: str, *order: Column, deleted: Column | None = None) -> int:
    """The version after merging ``incoming``: its first row of each key (see ``sinks.one_per_key``) takes the place of
    the table's, or is added; where ``deleted`` is true for it, the key goes. ``incoming`` has the table's columns (and
    those of ``deleted``).

    Rows that the table holds already as they are touch nothing; without any change the last version stays the last.
    """
    spark = incoming.sparkSession
    entries = manifest(spark, path).collect()  # a row for each bucket
    version, buckets, keys = entries[0]["version"], entries[0]["buckets"], entries[0]["keys"].split(",")
    entries = [e for e in entries if e["bucket"] >= 0]
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    extra = [c for c in incoming.columns if c not in _columns(spark, path, entries, incoming)]
    fresh = one_per_key(incoming, keys, *order).withColumn("_gone", gone).drop(*extra)
    schema = _ddl(fresh.drop("_gone"))
    fresh = cut(fresh.withColumn("_bucket", _bucket(keys, buckets)), "fresh")
    asked = {r["_bucket"] for r in fresh.select("_bucket").distinct().collect()}  # a row for each bucket
    columns = [c for c in fresh.columns if c not in ("_gone", "_bucket")]
    old = _of(spark, path, schema, [e for e in entries if e["bucket"] in asked])
    told = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    both = fresh.withColumn(_HASH, told).alias("f").join(old.select(*keys, told.alias("_old")).alias("o"), on, "left")
    changed = cut(both.where(F.when(F.col("_gone"), F.col("o._old").isNotNull()).otherwise(~F.col(_HASH).eqNullSafe(F.col("o._old")))).select("f.*").drop(_HASH), "changed")
    touched = {r["_bucket"] for r in changed.select("_bucket").distinct().collect()}  # a row for each bucket
    if not touched:
        return version
    before = _of(spark, path, schema, [e for e in entries if e["bucket"] in touched])
    stay = before.alias("o").join(changed.select(*keys).alias("f"), on, "left_anti")
    folder, sizes = _written(stay.unionByName(changed.where("not _gone").select(*columns)), path, keys, buckets)
    kept = [(e["bucket"], e["folder"], e["n"]) for e in entries if e["bucket"] not in touched]
    return _commit(spark, path, version + 1, kept + [(b, folder, n) for b, n in sizes.items()], buckets, keys)


def _columns(spark: SparkSession, path: str, entries: list, incoming: DataFrame) -> list[str]:
    """The table's columns; an empty table takes those of what comes."""
    return spark.read.parquet(f"{path}/{entries[0]['folder']}/bucket={entries[0]['bucket']}").columns if entries else incoming.columns
