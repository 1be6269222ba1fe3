"""Substring dedup: words inside runs that a document of smaller id has too are removed.

Fixed-block anchors. Every run of ``window`` words holds a whole block of (window + 1) // 2 words that starts at a
multiple of that length in its document. These non-overlapping blocks are the index; every rolling window of that
length, of every document, probes it. Where a window of one document meets a block of another both are hits, and
hits are extended by up to half a window to either side: the runs of ``window`` words round them are compared exactly
(128-bit digests), the document of smallest id keeps a run, and overlapping runs of the others join to maximal repeats.

How it moves. Documents are written once in units of a few megabytes, as a table bucketed by unit, so no later step
shuffles a text. A unit sends each hash once, with two marks (is a block's; is in several documents), as sorted and
packed numbers to the hashes' buckets, some three bytes a word; buckets answer with a bit each. The second exchange
does the same for the digests of runs round hits, with the smallest id of the unit. So a run that a third of all
documents share is one number a unit, never a group of documents or pairs. Nothing reaches the driver but sizes.
"""

from __future__ import annotations

import uuid
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, task_count

#: Bytes of text in a unit, and numbers in a bucket, on average.
UNIT, BUCKET = 3 << 20, 1 << 20
#: Bits of a hash beyond those that number all words: a window without like meets a block by chance in one of 2^SURE.
SURE = 8
MOST_BUCKETS = 50_000
LAST = (1 << 63) - 1
#: An odd multiplier for hashes of runs.
STEP = 0x9E3779B97F4A7C15


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, each as differences, byte by byte of their significance, compressed."""
    parts = [np.diff(c.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    whole = b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    flat = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return [np.cumsum(np.ascontiguousarray(p.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for p in np.split(flat, columns)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, put together from runs of powers of two."""
    step = np.uint64(STEP)
    runs, size, out, done = _mixed(np.fromiter(map(crc32, words), np.uint64, len(words)) + step), 1, None, 0
    total = len(words) - width + 1
    while size <= width:
        if width & size:
            part = runs[done : done + total]
            out = part.copy() if out is None else out * step + part
            done += size
        size *= 2
        if size <= width:
            runs = runs[: len(runs) - size // 2] * np.uint64(STEP * (size + 1) % (1 << 64)) + runs[size // 2 :]
    return _mixed(out)


class Unit:
    """The documents of a unit in the order they were written, as one list of words."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("seq")
        self.ids = table.column("doc_id").to_pylist()
        self.words: list[bytes] = []
        counts = []
        for text in table.column("text"):
            own = text.as_py().split()
            self.words += own
            counts.append(len(own))
        self.ends = np.cumsum(np.array(counts, dtype=np.int64))
        self.starts = self.ends - np.array(counts, dtype=np.int64)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.ends - self.starts)

    def hashes(self, block: int, window: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes with their marks, sorted; the places of all windows sorted by hash; the first of each distinct one).
        Documents with fewer than ``window`` words have none."""
        if len(self.words) < window:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none, none
        owner = self.owners()
        h = window_hashes(self.words, block) >> np.uint64(64 - bits)
        at = np.arange(len(h))
        at = at[(at + block <= self.ends[owner[: len(h)]]) & ((self.ends - self.starts)[owner[: len(h)]] >= window)]
        at = at[np.argsort(h[at], kind="stable")]
        sorted_h, own = h[at], owner[at]
        first = np.flatnonzero(np.r_[True, sorted_h[1:] != sorted_h[:-1]]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(at)] - 1 if len(at) else first
        aligned = np.maximum.reduceat((at - self.starts[own]) % block == 0, first) if len(at) else np.zeros(0, bool)
        several = own[first] != own[last]
        return (sorted_h[first] << np.uint64(2)) | (aligned.astype(np.uint64) << np.uint64(1)) | several.astype(np.uint64), at, first


def _bounds(buckets: int, bits: int) -> np.ndarray:
    """The least number of each bucket when numbers of so many bits are dealt over buckets in order."""
    return np.array([-(-(b << bits) // buckets) for b in range(buckets)], dtype=np.uint64)


def _sent(unit: int, columns: list[np.ndarray], key: np.ndarray, bounds: np.ndarray) -> tuple[list, list, list]:
    edges = _edges(key, bounds)
    full = np.flatnonzero(np.diff(edges))
    return full.tolist(), [unit] * len(full), [pack(*(c[edges[b] : edges[b + 1]] for c in columns)) for b in full]


def _edges(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the sorted keys of each bucket begin, and where the last one's end."""
    return np.r_[np.searchsorted(key, bounds), len(key)]


def _answers(replies: pa.Table, edges: np.ndarray) -> np.ndarray:
    """The bits that buckets sent back, one for each of the sorted keys."""
    out = np.zeros(int(edges[-1]), bool)
    for bucket, data in zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), strict=True):
        if bucket >= 0:
            a, b = edges[bucket], edges[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
    return out


SENT = "bucket long, unit long, data binary"


def _table(bucket: list, unit: list, data: list) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "unit": pa.array(unit, pa.int64()), "data": pa.array(data, pa.binary())})


def _replied(table: pa.Table, bucket: int, parts: list[np.ndarray]) -> pa.Table:
    units = table.column("unit").to_pylist()
    some = [i for i, p in enumerate(parts) if p.any()]
    return _table([bucket] * len(some), [units[i] for i in some], [np.packbits(parts[i]).tobytes() for i in some])


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """For each number of each unit whether its hash is a block's of one document and a window's of another."""
    own = [unpack(d, 1)[0] for d in table.column("data").to_pylist()]
    value = np.concatenate(own)
    order = np.argsort(value >> np.uint64(2), kind="stable")
    h = value[order] >> np.uint64(2)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[first, len(h)])
    marks = np.bitwise_or.reduceat(value[order] & np.uint64(3), first)
    hit = (marks >= 2) & ((size > 1) | (marks & np.uint64(1) > 0))
    out = np.zeros(len(value), bool)
    out[order] = np.repeat(hit, size)
    return _replied(table, key[0].as_py(), np.split(out, np.cumsum([len(v) for v in own])[:-1]))


def _beaten(key: tuple, table: pa.Table) -> pa.Table:
    """For each digest of each unit whether a unit has a smaller id with it; a unit's own notes pass through."""
    if key[0].as_py() < 0:
        return table.select(["bucket", "unit", "data"])
    own = [unpack(d, 3) for d in table.column("data").to_pylist()]
    high, low, least = (np.concatenate(c) for c in zip(*own, strict=True))
    least = least.view(np.int64)
    order = np.lexsort((low, high))
    h, lo = high[order], low[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])])
    smallest = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.r_[first, len(h)]))
    out = np.zeros(len(least), bool)
    out[order] = smallest < least[order]
    return _replied(table, key[0].as_py(), np.split(out, np.cumsum([len(c[0]) for c in own])[:-1]))


def _in_units(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(unit, seq, doc_id, text) as a table on the shared folder, bucketed by unit; and the bytes of all texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    sizes = rows.select(F.spark_partition_id().alias("part"), F.length("text").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    most, total, parts = sizes.agg(F.max("n"), F.sum("n"), F.max("part")).first()
    fan = max(1, ceil((most or 0) / UNIT))
    told = rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("unit", F.spark_partition_id().cast("long") * fan + F.pmod(F.xxhash64("seq"), F.lit(fan)))
    name = f"lodestrata_units_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, max(1, ((parts or 0) + 1) * fan))
    told.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "unit").saveAsTable(name)
    return spark.table(name), total or 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (text: what stays, one space between words), spans
    (array of (start, end): the maximal runs of removed words, counted in words, end exclusive).

    Removed is each word that a run of ``window`` words covers whose words also stand, unchanged and in that order, in
    a row of smaller id. Runs are judged on the input. Words are what space, tab to return leave. Null texts are empty;
    an empty table gives an empty result. Rows with the same id do not take from each other. A null id counts as the
    greatest, so it takes from none. Other columns are not read.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark, block = docs.sparkSession, (window + 1) // 2
    units, size = _in_units(docs, id_col, text_col)
    bits = min(60, max(20, (size // 4).bit_length() + SURE))
    number = max(task_count(spark), ceil(size / 6 / BUCKET))
    bounds, digest_bounds = _bounds(number, bits), _bounds(number, 64)

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        marked, _, _ = Unit(table).hashes(block, window, bits)
        return _table(*_sent(key[0].as_py(), [marked], marked >> np.uint64(2), bounds))

    def extend(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not replies.num_rows:
            return _table([], [], [])
        unit, own = Unit(table), key[0].as_py()
        marked, at, first = unit.hashes(block, window, bits)
        hit = np.zeros(len(unit.words) + 1, np.int64)
        hit[at] = np.repeat(_answers(replies, _edges(marked >> np.uint64(2), bounds)), np.diff(np.r_[first, len(at)]))
        before = np.r_[0, np.cumsum(hit)]
        owner = unit.owners()
        start = np.arange(max(0, len(owner) - window + 1))
        start = start[(start + window <= unit.ends[owner[start]]) & (before[start + window - block + 1] > before[start])]
        if not len(start):
            return _table([], [], [])
        joined = b" ".join(unit.words)
        edge = np.r_[0, np.cumsum(np.fromiter(map(len, unit.words), np.int64, len(unit.words)) + 1)]
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(edge[start].tolist(), (edge[start + window] - 1).tolist(), strict=True)), ">u8").astype(np.uint64)
        high, low = digest[::2], digest[1::2]
        ids = np.array([LAST if i is None else i for i in unit.ids], dtype=np.int64)[owner[start]]
        order = np.lexsort((low, high))
        h, lo = high[order], low[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])])
        least = np.minimum.reduceat(ids[order], first)
        which = np.zeros(len(start), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(start)]))
        sent = _sent(own, [h[first], lo[first], least], h[first], digest_bounds)
        note = pack(start, which, (ids > least[which]).astype(np.int64))
        return _table([*sent[0], -1 - own], [*sent[1], own], [*sent[2], len(note).to_bytes(8, "little") + note + pack(_edges(h[first], digest_bounds))])

    def rebuild(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        unit = Unit(table)
        gone = np.zeros(len(unit.words) + 1, np.int64)
        for bucket, data in zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), strict=True):
            if bucket < 0:
                size = int.from_bytes(data[:8], "little")
                start, which, local = (c.view(np.int64) for c in unpack(data[8 : 8 + size], 3))
                edges = unpack(data[8 + size :], 1)[0].view(np.int64)
                start = start[(local > 0) | _answers(replies, edges)[which]]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
        covered = np.cumsum(gone[:-1]) > 0
        kept, spans = [], []
        for a, b in zip(unit.starts.tolist(), unit.ends.tolist(), strict=True):
            own = covered[a:b]
            if not own.any():
                kept.append(b" ".join(unit.words[a:b]))
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, own, False])).reshape(-1, 2)
            inner = [0, *edges.ravel().tolist(), b - a]
            kept.append(b" ".join(w for s, e in zip(inner[::2], inner[1::2], strict=True) for w in unit.words[a + s : a + e]))
            spans.append([{"start": s, "end": e} for s, e in edges.tolist()])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        count = unit.ends - unit.starts
        removed = [sum(s["end"] - s["start"] for s in own) for own in spans]
        return pa.table({"doc_id": pa.array(unit.ids, pa.int64()), "n_words": pa.array(count), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind)})

    def by_unit(df: DataFrame):
        return df.groupBy("unit")

    met = by_unit(units).applyInArrow(probe, SENT).groupBy("bucket").applyInArrow(_met, SENT)
    extended = by_unit(units).cogroup(by_unit(met)).applyInArrow(extend, SENT)
    beaten = extended.groupBy("bucket").applyInArrow(_beaten, SENT)
    told = by_unit(units).cogroup(by_unit(beaten)).applyInArrow(rebuild, "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start: long, end: long>>")
    return told.withColumn("kept", F.col("kept").cast("string"))


def repeats(docs: DataFrame, **options) -> DataFrame:
    """The maximal repeats alone: (doc_id, start, end) for each run of removed words."""
    return remove_repeats(docs, **options).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")
