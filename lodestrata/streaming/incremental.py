"""Incremental ingest from a landing folder: late data within a watermark, exactly-once upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..storage import shared_folder as shared_folder


def landing(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time_col: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time_col: str, key: str, value: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def latest(batch: DataFrame, keys: list[str], time_col: str, tie: str) -> DataFrame:
    """The last row of each key; rows are compared before the shuffle."""
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(time_col, tie)).alias("_row")).select("_row.*")


def change_log(spark: SparkSession, path: str, schema: StructType, keys: list[str], time_col: str, tie: str) -> Callable[[DataFrame, int], None]:
    """A merge for ``upsert_stream``: a micro-batch leaves its last row of each key under its own number, so a repeated
    epoch writes the same again and a restart needs nothing from the driver. No batch rewrites what others left. The
    log begins with a batch of no rows, so that it can be read before any comes."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/epoch=-1")

    def merge(batch: DataFrame, epoch: int) -> None:
        latest(batch, keys, time_col, tie).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return merge


def state(spark: SparkSession, path: str, schema: StructType, keys: list[str], time_col: str, tie: str) -> DataFrame:
    """What a change log comes to: the last row of each key over all batches; none if no batch came."""
    return latest(spark.read.schema(schema).parquet(path).select(*schema.names), keys, time_col, tie)


def compact(spark: SparkSession, path: str, into: str, schema: StructType, keys: list[str], time_col: str, tie: str) -> None:
    """Write a log's state as one batch of a new log, when there are many."""
    state(spark, path, schema, keys, time_col, tie).write.parquet(f"{into}/epoch=0")


def upsert_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``merge(batch, epoch)``, which must be idempotent for an epoch; stops when caught up."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
