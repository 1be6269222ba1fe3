"""Importance resampling towards a target: documents drawn by the likeness of their hashed features to a target's.

Runs of one to ``width`` words fall in buckets by a checksum. The gains of the buckets (the log ratio of their shares in
the target and in the documents, in thousandths) are one array of bounded size that every task holds; a document's
weight is the mean over its features. Noise by a hash of the id makes the highest scores a draw without replacement.

The cutoff is found without sorting all scores: a quantile sketch gives a bracket of scores round it, exact counts
outside the bracket validate or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, task_count

#: Bytes that are no part of a word become spaces, A-Z become lower case.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text whose words are taken up at once.
PIECE = 1 << 20
#: Relative accuracy of the sketch's ranks, and how much wider the bracket gets each time.
SLACK, WIDER = 0.001, 4


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time."""
    plain = (text or b"").translate(PLAIN)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def features(text: bytes | None, buckets: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the features that end in them) of each piece of a text."""
    before: list[bytes] = []
    for words in words_of(text):
        found = [np.fromiter(map(crc32, words), np.int64, len(words))]
        for k in range(2, width + 1):
            own = before[len(before) - min(len(before), k - 1) :] + words
            found.append(np.fromiter((crc32(b" ".join(own[i : i + k])) for i in range(len(own) - k + 1)), np.int64, max(0, len(own) - k + 1)))
        before = (before + words)[-(width - 1) :] if width > 1 else []
        yield len(words), np.concatenate(found) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000, width: int = 1) -> np.ndarray:
    """The features of all rows in each bucket; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py(), buckets, width):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.col(text_col).cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target and in the source, smoothed by one."""
    whole, wanted, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([floor(1000 * log((t + 1.0) * (whole + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", width: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain over a document's features, rounded down; zero without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, mean = [], [], []
            for text in batch.column(1):
                words = count = total = 0
                for new, found in features(text.as_py(), len(gain), width):
                    words, count, total = words + new, count + len(found), total + int(gain[found].sum())
                n_words.append(words)
                n_features.append(count)
                mean.append(total // count if count else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, mean))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id; a null id counts as empty."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    unit = (F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(unit)))


def places(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``at``, their place from zero in the order: a range sort, written, and the sizes of its parts."""
    number = F.monotonically_increasing_id()
    told = cut(rows.repartitionByRange(task_count(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("number", number), "sorted")
    part = F.shiftright("number", 33)
    sizes = sorted((r.part, r.n) for r in told.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each part
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    first = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return told.withColumn("part", part).join(F.broadcast(first), "part").withColumn("at", F.col("start") + F.col("number").bitwiseAND((1 << 33) - 1)).drop("part", "start", "number")


def bracket(scores: DataFrame, k: int, n: int, slack: float = SLACK) -> tuple[int, int, int]:
    """(low, high, above): the ``k`` highest of the ``n`` values of ``score`` end between low and high, both included;
    ``above`` values are over high. A sketch proposes, exact counts decide."""
    while True:
        ends = [max(0.0, 1 - k / n - slack), min(1.0, 1 - k / n + slack)]
        low, high = scores.agg(F.percentile_approx("score", ends, int(2 / SLACK))).first()[0]
        above, within = scores.agg(F.count(F.when(F.col("score") > high, 1)), F.count(F.when(F.col("score").between(low, high), 1))).first()
        if above < k <= above + within:
            return low, high, above
        slack *= WIDER  # at zero and one the ends are the least and the greatest score


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = 10_000, width: int = 1, least_words: int = 20, percent: int = 10, seed: str = "2024",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    Of the N documents with ``least_words`` words or more, the floor(``percent`` * N / 100) highest scores are drawn and
    ranked from 1; ties go to the smaller id, null ids last, and rows with the same id and score take any order among them.
    The others have a null rank. Null and empty texts have no features and weight zero. Other columns are not read; an
    empty table gives an empty result, an empty target equal gains but for the documents' own counts.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, width), bucket_counts(target, target_col, buckets, width))
    told = weights(docs, gain, id_col, text_col, width).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scores = cut(told.withColumn("row", F.monotonically_increasing_id()), "scores")
    long_enough = scores.where(F.col("n_words") >= least_words)
    n = long_enough.count()
    k = percent * n // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(long_enough.select("score"), k, n)
    order = [(-F.col("score")).alias("fall"), F.isnull("doc_id").alias("late"), F.coalesce("doc_id", F.lit(0)).alias("own"), F.col("row")]
    near = long_enough.where(F.col("score").between(low, high)).select(*order)
    last = places(near, *(F.col(c) for c in ("fall", "late", "own", "row"))).where(F.col("at") == k - above - 1).first()
    key = F.struct(*order)
    drawn = (F.col("n_words") >= least_words) & (key <= F.struct(F.lit(last["fall"]).alias("fall"), F.lit(last["late"]).alias("late"), F.lit(last["own"]).alias("own"), F.lit(last["row"]).alias("row")))
    ranked = places(scores.where(drawn).select(*columns, key.alias("key")), F.col("key.fall"), F.col("key.late"), F.col("key.own"), F.col("key.row"))
    return ranked.select(*columns, (F.col("at") + 1).alias("rank")).unionByName(scores.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
