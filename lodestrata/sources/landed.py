"""Landed pages of a paged service: each names its cursor and the next one; a chain of them is delivered in order.

A crawler outside leaves a JSON file for each page in a landing folder. A stream takes up new files (its checkpoint
knows which), and a page counts once however often it was fetched. Items are delivered as far as the chain of cursors
reaches from the first page: what lies behind a page that has not landed yet waits, so nothing is left out and nothing
comes twice. Where the chain ends is the cursor that the crawler goes on from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import cut


def _schema(item: str) -> str:
    return f"cursor string, next string, items array<struct<{item}>>"


def take(spark: SparkSession, landing: str, into: str, item: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Take up the pages that landed since the last call; ``item``: the fields of an item, which alone are read from the
    files. Files that are no page (no cursor) are left out."""
    spark.createDataFrame([], f"{_schema(item)}, file string").write.mode("ignore").parquet(f"{into}/epoch=-1")
    pages = spark.readStream.schema(_schema(item)).option("multiLine", "true").option("maxFilesPerTrigger", files).json(landing)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/epoch={epoch}")

    named = pages.where("cursor is not null").withColumn("file", F.col("_metadata.file_path"))
    return named.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pages(spark: SparkSession, into: str, item: str) -> DataFrame:
    """(cursor, next, items): each page once, the first that was taken up; of one batch that of the first file."""
    every = spark.read.schema(f"{_schema(item)}, file string, epoch int").parquet(into)
    return every.groupBy("cursor").agg(F.min_by(F.struct("next", "items"), F.struct("epoch", "file")).alias("p")).select("cursor", "p.*")


def chained(told: DataFrame, first: str) -> DataFrame:
    """(cursor, next, items, place): the pages that the chain from ``first`` reaches, in its order from zero.

    Every page points to the one before it; pointers are doubled until all have come to an end, so the rounds grow with
    the logarithm of the chain. Of pages that name the same next one the smallest cursor is followed; a chain that runs
    into itself ends there.
    """
    before = told.where((F.col("next").isNotNull()) & (F.col("next") != first)).groupBy(F.col("next").alias("cursor")).agg(F.min("cursor").alias("up"))
    links = cut(told.select("cursor").join(before, "cursor", "left").select("cursor", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("place")), "links")
    known, rounds = links.count(), 0
    while 1 << rounds <= known and links.where("up is not null").head(1):
        far = links.select(F.col("cursor").alias("up"), F.col("up").alias("further"), F.col("place").alias("more"))
        # a page that has come to an end has no pointer; where it ended is kept apart
        links = links if "root" in links.columns else links.withColumn("root", F.when(F.col("up").isNull(), F.col("cursor")))
        far = far.join(links.select(F.col("cursor").alias("up"), F.col("root").alias("far_root")), "up")
        links = cut(links.join(far, "up", "left").select("cursor", F.col("further").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.when(F.col("root").isNotNull(), F.col("root")).otherwise(F.col("far_root")).alias("root")), "links")
        rounds += 1
    links = links if "root" in links.columns else links.withColumn("root", F.when(F.col("up").isNull(), F.col("cursor")))
    return told.join(links.where(F.col("root") == first).select("cursor", "place"), "cursor")


def delivered(told: DataFrame, first: str) -> DataFrame:
    """(page, place, the items' fields): the items of the chain's pages, in order by page and place."""
    return chained(told, first).select(F.col("place").alias("page"), F.posexplode("items").alias("place", "item")).select("page", "place", "item.*")


def progress(told: DataFrame, first: str) -> tuple[int, str | None]:
    """(pages delivered, the cursor to go on from: null once the last page is there)."""
    last = chained(told, first).agg(F.count("*").alias("n"), F.max_by("next", "place").alias("next")).first()
    return last["n"], (last["next"] if last["n"] else first)
