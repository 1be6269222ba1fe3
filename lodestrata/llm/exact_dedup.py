"""Exact dedup by two-pass Bloom filtering.

Texts are equal when they are identical after white space (space, tab to return) is deleted; a null text counts as
empty. Pass one streams over the digests, sends each one's hash (eight bytes, once a task) to its part of a Bloom filter
and sets cells that count to two; the filter knows every digest that can occur twice. Pass two tests each row: rows that occur once for certain pass straight
through, only the possibly repeated ones are shuffled and compared by their full SHA-256.

The filter is a table of segments. A digest has all its bits in one segment, so pass two is a join with the segments,
which are broadcast once an executor, and a look at the bits. The filter's size follows the number of rows up to
``max_filter_bytes``. Beyond that bound more unique rows are shuffled for nothing; the result is exact at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, few, giving_back

#: A filter is made of segments of so many bits; a digest has all its bits in one segment.
SEGMENT_BITS = 1 << 17
#: A digest's cells are four runs of 17 bits of one hash, which begin so many bits apart (the last two of a run are the
#: first two of the next).
PROBES, STEP = 4, 15


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, ""), 256)


def _unique(segments: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (segment, hash) once, in order, with the sum of its times."""
    order = np.lexsort((hashes, segments))
    segments, hashes = segments[order], hashes[order]
    first = np.append(True, (segments[1:] != segments[:-1]) | (hashes[1:] != hashes[:-1]))
    return segments[first], hashes[first], np.add.reduceat(times[order], np.flatnonzero(first))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, once, twice): for each segment that this task touches, the hashes met once and those met again, as
    64-bit numbers. A hash met thousands of times is sent once, so a large group of copies is one number a task."""
    kept = [_unique(b.column(0).to_numpy(), b.column(1).to_numpy(), np.ones(b.num_rows, np.int32)) for b in batches if b.num_rows]
    if not kept:
        return
    segments, hashes, times = _unique(*map(np.concatenate, zip(*kept, strict=True)))
    kept.clear()
    bounds = np.append(np.flatnonzero(np.diff(segments, prepend=-1)), len(segments))
    for at in range(0, len(bounds) - 1, 1024):
        parts = [slice(i, j) for i, j in pairwise(bounds[at : at + 1025])]
        once, twice = ([hashes[p][kind[p]].tobytes() for p in parts] for kind in (times == 1, times > 1))
        yield pa.RecordBatch.from_pydict({"segment": segments[bounds[at : at + len(parts)]], "once": once, "twice": twice})


def _cells(hashes: bytes) -> np.ndarray:
    """The cells of hashes; ``may_repeat`` finds them alike."""
    h = np.frombuffer(hashes, np.uint64)
    return np.concatenate([(h >> np.uint64(STEP * i)) & np.uint64(SEGMENT_BITS - 1) for i in range(PROBES)]).astype(np.int64)


def _join_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set the cells of rows that arrive sorted by segment; one segment is held at a time."""
    at, once, twice = None, np.zeros(SEGMENT_BITS, dtype=bool), np.zeros(SEGMENT_BITS, dtype=bool)
    for batch in batches:
        for k, one, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != at:
                if at is not None:
                    yield _twice(at, twice)
                at = k
                once[:], twice[:] = False, False
            again, new = _cells(more), _cells(one)
            twice[again] = True
            twice[new[once[new]]] = True  # set by another task before
            once[again], once[new] = True, True
    if at is not None:
        yield _twice(at, twice)


def _twice(segment: int, cells: np.ndarray) -> pa.RecordBatch:
    words = np.packbits(cells, bitorder="little").view(np.int64)
    return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "twice": pa.array([words], pa.list_(pa.int64()))})


def _place(digest: Column, segments: int) -> tuple[Column, Column]:
    """A digest's segment, and the hash that its cells are bits of."""
    return F.pmod(F.xxhash64(digest, F.lit(0)), F.lit(segments)).cast("int"), F.xxhash64(digest, F.lit(1))


def filled(digests: DataFrame, segments: int) -> DataFrame:
    """(segment, once, twice): what the tasks send to the segments, eight bytes for each different digest of a task."""
    segment, hashed = _place(F.col(digests.columns[0]), segments)
    return digests.select(segment.alias("segment"), hashed.alias("hash")).mapInArrow(giving_back(_fill), "segment int, once binary, twice binary")


def may_repeat(digests: DataFrame, bits_per_row: int = 16, max_filter_bytes: int = 1 << 28) -> Callable[[DataFrame, str, str], DataFrame]:
    """From one column of digests: a function (rows, digest column, new column) that adds to rows whether their digest
    occurs twice or more (true for few others too). Pass one of the method."""
    n = digests.count()
    segments = max(1, min(max_filter_bytes * 8, n * bits_per_row) // SEGMENT_BITS)
    merged = filled(digests, segments).repartition("segment").sortWithinPartitions("segment").mapInArrow(giving_back(_join_filters), "segment int, twice array<long>")
    held = cut(merged, "filter")

    def mark(rows: DataFrame, digest: str, into: str) -> DataFrame:
        segment, hashed = _place(F.col(digest), segments)
        own, twice = f"{into}_segment", f"{into}_twice"
        shared = F.broadcast(held.select(F.col("segment").alias(own), F.col("twice").alias(twice)))
        joined = rows.join(shared, segment == F.col(own), "left")
        found = F.lit(True)
        for i in range(PROBES):
            at = F.shiftrightunsigned(hashed, STEP * i).bitwiseAND(SEGMENT_BITS - 1)
            found = found & (F.getbit(F.get(F.col(twice), F.floor(at / 64).cast("int")), at % 64) == 1)
        return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(found, F.lit(False)).alias(into))

    return mark


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text, then the smallest id, stays (null ids come
    last); of rows that repeat an id and its text exactly one is kept. Empty and null texts form one group. Other
    columns of ``docs``, whatever their names, are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("size"), digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    mark = may_repeat(rows.select("text_sha256"), **filter_options)
    flagged = cut(mark(rows, "text_sha256", "again"), "flagged")
    alone, again = flagged.where(~F.col("again")), flagged.where("again")
    groups = cut(_best(again).where("group_size > 1"), "groups")
    joined = again.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"), "text_sha256",
    )
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256").unionByName(joined)


def _best(rows: DataFrame) -> DataFrame:
    """Per digest, its rows' number and the one that stays; sums are made before the shuffle."""
    ranked = F.struct("size", F.bitwise_not("doc_id").alias("least_id"), F.bitwise_not("row").alias("least_row"), "doc_id", "row")
    return rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max(ranked).alias("best"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Of rows that repeat an id with texts of the same length and digest, the one whose JSON is smallest stays.
    What goes is decided on digests alone. Rows whose digest occurs once then never leave their task; possible repeats
    are matched by digest and id, so that a large group of copies is spread over all tasks.
    """
    sha, own, again = (f"_{x}_{'_'.join(docs.columns)}" for x in ("sha", "id", "again"))
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    ident = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), size.cast("string"))
    rows = docs.select("*", digest(F.col(text_col)).alias(sha), ident.alias(own))
    digests = cut(rows.select(F.col(sha).alias("text_sha256"), size.alias("size"), F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("row"), F.col(own).alias("own")), "digests")
    mark = may_repeat(digests.select("text_sha256"), **filter_options)
    seen = cut(mark(digests, "text_sha256", "again").where("again").drop("again"), "seen")
    groups = cut(_best(seen).where("group_size > 1"), "groups")
    stays = (F.col("size") == F.col("best.size")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    drop = cut(seen.join(groups, "text_sha256").where(~stays).select(F.col("text_sha256").alias(sha), F.col("own").alias(own)), "drop")
    flagged = mark(rows, sha, again)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kept = flagged.where(again).join(few(drop), [sha, own], "left_anti").groupBy(sha).agg(F.min_by(whole, F.to_json(whole)).alias(own)).select(f"{own}.*")
    return flagged.where(~F.col(again)).select(*docs.columns).unionByName(kept.select(*docs.columns))
