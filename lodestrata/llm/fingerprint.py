"""Document fingerprints: SimHash of weighted terms, and exact search within a Hamming radius by block tables.

Terms are pairs of neighbouring words (a lone word is a term too); each votes on all 64 bits with the weight
1 + ln(times it occurs). For the search the fingerprint's bits are cut into more blocks than the radius has bits, and
one table for each choice of as many blocks as must agree, keyed by their bits, holds all fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, task_count
from .near_dedup import block_keys, blocks_for
from .simhash import shingle_hashes

LEAST = -(1 << 63)


def weighted_simhash(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints; a bit is set if the weights for it outweigh those against. No words: zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        terms, times = np.unique(np.array(shingle_hashes(text, 2), dtype=np.uint64), return_counts=True)
        if not len(terms):
            continue
        weights = (1 + np.log(times)).astype(np.float32)
        votes = np.zeros(64, dtype=np.float64)
        for at in range(0, len(terms), 1 << 16):
            bits = np.unpackbits(terms[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += weights[at : at + (1 << 16)] @ bits.astype(np.float32)
        out[i] = np.packbits(2 * votes > float(weights.sum(dtype=np.float64)), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of each whole text; equal texts have equal fingerprints; zero for null or wordless texts.
    Rows repeat as in ``docs``; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = weighted_simhash([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, visitor, doc_id, text): ``docs`` dealt into ranges of ids such that, within a bucket, sorting by visitor,
    then descending id, puts behind each row the document that follows it.

    Each bucket gets, as a visitor, a copy of the one document that follows its last; the last bucket gets the first
    document of all. Texts are shuffled once. The split points are quantiles of the ids, a number for each bucket.
    """
    spark = docs.sparkSession
    buckets = 4 * task_count(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    splits = np.unique(np.array(rows.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 1 / (8 * buckets)), dtype=np.float64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, ids.to_numpy().astype(np.float64), side="left").astype(np.int32))

    firsts = sorted((r.bucket, r.top) for r in rows.select("doc_id", bucket_of("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    visits = {top: firsts[(i + 1) % len(firsts)][0] for i, (_, top) in enumerate(firsts)}  # one for each bucket

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = np.array(sorted(visits), dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = np.searchsorted(splits, ids.astype(np.float64), side="left").astype(np.int32)
            twice = np.flatnonzero(np.isin(ids, tops))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(ids), bool)), *batch.columns], ["bucket", "visitor", "doc_id", "text"])
            if len(twice):
                to = pa.array(np.array([visits[i] for i in ids[twice].tolist()], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(twice), bool)), *(c.take(pa.array(twice)) for c in batch.columns)], ["bucket", "visitor", "doc_id", "text"])

    return rows.mapInArrow(deal, "bucket int, visitor boolean, doc_id long, text string")


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp) for each row: its text, the edited text (see
    ``edited``) and the document that follows in descending id, after the last the first.

    Null texts are empty. Null ids come after all others. Rows that share an id follow each other by text. A table
    of one row is followed by itself.
    """
    import hashlib

    schema = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long"

    def finish(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        changed = [edited(t, f) for _, t, f in rows]
        prints = weighted_simhash([t for _, t, _ in rows]).view(np.int64), weighted_simhash(changed).view(np.int64)
        following = weighted_simhash([rows[-1][2]]).view(np.int64)
        after = np.r_[prints[0][1:], following]
        for i, (row, later) in enumerate(zip(rows, rows[1:])):  # a bucket's last row is followed by its visitor
            if row[2] is not later[1]:
                after[i] = weighted_simhash([row[2]]).view(np.int64)[0]
        shas = [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]
        cols = [pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()), pa.array(shas), pa.array(prints[0]), pa.array(prints[1]), pa.array(after)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready = None, []
        for batch in batches:
            for bucket, visitor, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last and last[0] == bucket and not last[1]:
                    ready.append((last[2], last[3], text))
                last = (bucket, visitor, doc_id, text)
                if len(ready) >= 256:
                    yield finish(ready)
                    ready = []
        if ready:
            yield finish(ready)

    dealt = with_following(docs, id_col, text_col).repartition("bucket").sortWithinPartitions("bucket", "visitor", F.desc("doc_id"), "text")
    return dealt.mapInArrow(run, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(LEAST)))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of differing bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def within(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """From distinct fingerprints (fp) and (fp, more columns): all pairs (query_fp, fp, distance) within the radius.

    The more fingerprints, the more blocks and bits of a key (``blocks_for``), so that a key's unlike fingerprints do not
    grow with them; a key that very many like ones share is split by the join."""
    blocks = blocks_for(prints.count(), radius)
    asked = queries.select(F.col("fp").alias("query_fp"), F.explode(block_keys(F.col("fp"), *blocks)).alias("at"))
    held = prints.select("fp", F.explode(block_keys(F.col("fp"), *blocks)).alias("at"))
    found = asked.join(held, "at").select("query_fp", "fp", F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))).alias("distance"))
    return found.where(F.col("distance") <= radius).distinct()


def count_within(prints: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with n_within: for rows that meet ``asked`` the number of rows, the own one
    included, whose fingerprint is within the radius; null for the others."""
    counts = cut(prints.groupBy("fp").agg(F.count("*").alias("n"), F.max(asked).alias("asked")), "counts")
    pairs = within(counts.where("asked").select("fp"), counts, radius)
    totals = cut(pairs.join(counts.select("fp", "n"), "fp").groupBy("query_fp").agg(F.sum("n").alias("n_within")).withColumnRenamed("query_fp", "fp"), "totals")
    return prints.where(asked).join(totals, "fp").unionByName(prints.where(~F.coalesce(asked, F.lit(False))).withColumn("n_within", F.lit(None).cast("long")))
