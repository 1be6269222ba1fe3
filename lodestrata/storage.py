"""The cluster's shared folder, tables written there to cut lineage, and stated sets taken in blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of a stated set that may be on the driver together. Beyond, a block's result is written before the next one comes.
TOGETHER = 4


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, read from the session; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="lodestrata-")


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from files that survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def over_blocks(entries: DataFrame, key: str, size: int, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of ``made(block)`` over a stated set in blocks of about ``size`` entries by a hash of ``key``.

    ``made`` may collect or broadcast its block. A few blocks are made lazily; of many, each one's result is written to
    the shared folder before the next is taken, so the driver never holds more than one.
    """
    parts = max(1, -(-entries.count() // size))
    blocks = [entries if parts == 1 else entries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]
    return reduce(DataFrame.unionByName, [made(b) if parts <= TOGETHER else cut(made(b), "block") for b in blocks])
