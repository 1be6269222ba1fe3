"""Versions as they arrive: a stream that keeps the current version of each key and demotes the one before.

Only the current versions of keys are state, held by buckets of keys, so that a task compares a bucket's rows at once
and not key by key. Each micro-batch gives changes (key, version, is_current): those rows that it brought, and the
version that it demoted. The last change of a row over all batches is what a window over the whole table would say,
however the rows were split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "key long, id long, at timestamp, is_current boolean"
#: Fixed for a checkpoint: the state is that of a bucket.
BUCKETS = 1024


def changes(stream: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    """(key, id, at, is_current) changes of a stream of versions; the latest ``at``, then the greatest ``id_``, is current.

    Rows without a key, id or time are no versions. A version that comes again changes nothing.
    """

    def of_bucket(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame(dict(zip(("key", "best_at", "best_id"), state.get if state.exists else ((), (), ()))), dtype="int64")
        for batch in batches:
            rows = batch[["key", "id", "at"]].drop_duplicates().sort_values(["key", "at", "id"]).reset_index(drop=True)
            place = best["key"].searchsorted(rows["key"])
            held = np.append(best["key"].to_numpy(), 0)[place] == rows["key"].to_numpy()
            held &= place < len(best)
            was_at, was_id = (np.append(best[c].to_numpy(), 0)[place] for c in ("best_at", "best_id"))
            t, i = rows["at"].to_numpy(), rows["id"].to_numpy()
            top = ~rows["key"].duplicated(keep="last").to_numpy() & (~held | (t > was_at) | ((t == was_at) & (i > was_id)))
            known = held & (t == was_at) & (i == was_id)
            demoted = top & held  # be it by this batch or by a later part of it
            gone = pd.DataFrame({"key": rows["key"].to_numpy()[demoted], "id": was_id[demoted], "at": was_at[demoted], "is_current": False})
            out = pd.concat([gone, rows.assign(is_current=top)[~known]]) if len(gone) else rows.assign(is_current=top)[~known]
            if len(out):
                yield out
            fresh = rows[top].rename(columns={"at": "best_at", "id": "best_id"})
            best = pd.concat([best, fresh[best.columns]]).drop_duplicates("key", keep="last").sort_values("key").reset_index(drop=True)
        state.update(tuple(best[c].tolist() for c in ("key", "best_at", "best_id")))

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(id_).cast("long").alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")).dropna()
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    told = bucketed.groupBy("bucket").applyInPandasWithState(of_bucket, "key long, id long, at long, is_current boolean", "key array<long>, at array<long>, id array<long>", "append", GroupStateTimeout.NoTimeout)
    return told.select("key", "id", F.timestamp_micros("at").alias("at"), "is_current")


def keep(told: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of each micro-batch under its number; an epoch that comes again writes the same again. Within
    an epoch a demotion outweighs the promotion of the same row before it."""
    told.sparkSession.createDataFrame([], CHANGES).write.mode("ignore").parquet(f"{path}/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("key", "id", "at").agg(F.min("is_current").alias("is_current")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return told.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(key, id, at, is_current): every version that came, by its last change."""
    every = spark.read.schema(f"{CHANGES}, epoch int").parquet(path)
    return every.groupBy("key", "id", "at").agg(F.max_by("is_current", "epoch").alias("is_current"))
