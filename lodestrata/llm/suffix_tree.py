"""LM scoring by a probabilistic suffix tree, beside a smoothed word model.

Symbols are the UTF-8 bytes of a text whose A-Z are lower-cased and whose words (what space, tab to return leave) are
joined by one space; a line feed ends a text and stands before its start. Counting covers every training text. A
context of up to ``DEPTH`` symbols becomes a node of the tree if it occurs often enough (``rare`` times the square root
of all symbols, so that the tree grows with the corpus) and its next-symbol distribution diverges from that of the
context one symbol shorter: the likelihood-ratio statistic must pass ``divergence`` for each of its symbols; with a node
go all its suffixes. A state's distribution is discounted and
interpolated with that of the next shorter suffix, down to equal chances, so it sums to one. A text is scored from
the longest suffix state of each position.

The tree is a table. While it has ``MOST`` transitions at most it is broadcast whole. A larger one is broadcast in slices, one
after the other: the levels of up to one symbol of context, which are small, and of the longer contexts those whose
last two symbols fall in the slice. A slice holds all states of the symbols that follow its pairs, so a pass over the
texts with each slice scores every symbol just once, and no transition is left out. Of the word model, words of at
least the share ``common`` (1 / common of them at most) are looked up in tasks, all others are joined with their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DEPTH = 5
END = b"\n"
DISCOUNT = 0.75
#: Transitions that are broadcast at once, some 24 bytes each in every worker.
MOST = 1 << 23
#: Symbols counted or scored at once.
CHUNK = 1 << 22
#: Binary logarithm of the cells in which a task remembers grams.
CELLS = 22
#: Words that a task counts before it hands them on, grams it holds before it sums them, and rows it takes up at once.
HELD = 300_000
HELD_GRAMS = 3_000_000
ROWS = 2048


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts, ends included: it and the DEPTH symbols before it as one number, the latest
    lowest; and each text's first place."""
    flat = np.frombuffer(b"".join(END * DEPTH + t + END for t in texts), np.uint8).astype(np.uint64)
    code = np.zeros(len(flat) - DEPTH, dtype=np.uint64)
    for k in range(DEPTH + 1):
        code = (code << np.uint64(8)) | flat[k : len(flat) - DEPTH + k]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(lengths + DEPTH) - lengths - DEPTH
    inside = np.ones(len(code), dtype=bool)
    for k in range(DEPTH):
        at = starts + lengths + k
        inside[at[at < len(code)]] = False
    return code[inside], np.cumsum(lengths) - lengths


def _blocks(docs: list[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for d in docs:
        block.append(d)
        size += len(d)
        if size >= CHUNK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (gram null) and of grams (word null) of this task's texts."""
    words: Counter = Counter()

    def hand_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "gram", "n"])
        words.clear()
        return out

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            texts = []
            for t in batch.column(0).slice(at, ROWS).to_pylist():
                own = words_of(t)
                words.update(own)
                texts.append(b" ".join(own))
            words[END] += len(texts)
            for block in _blocks(texts):
                held.append(np.unique(grams(block)[0], return_counts=True))
            if sum(len(code) for code, _ in held) > HELD_GRAMS:
                held = [_summed(held)]
            if len(words) > HELD:
                yield hand_on()
    if held:
        code, n = _summed(held)
        for at in range(0, len(code), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(code[part]), pa.binary()), pa.array(code[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["word", "gram", "n"])
    yield hand_on()


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(n, first)


def _mask(symbols: int) -> int:
    return (1 << (8 * symbols)) - 1


def _slice(pair, slices: int):
    """The slice of two symbols as one number; for columns and arrays alike."""
    return (pair * 40503 % 65536) % slices


def grow(counted: DataFrame, rare: float = 0.003, divergence: float = 1.0) -> dict:
    """The tree from gram counts: ``table`` (k, gram, n, total) with a row for each transition, ``slices`` in which it is
    broadcast, and its ``levels`` (see ``_levels``) if it is one slice."""
    levels = F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit(_mask(k + 1)).cast("long")).alias("gram")) for k in range(DEPTH + 1)))
    moves = cut(counted.select(F.explode(levels).alias("x"), "n").groupBy("x.k", "x.gram").agg(F.sum("n").alias("n")).withColumn("context", F.shiftright("gram", 8)), "moves")
    total = moves.where("k = 0").agg(F.sum("n")).first()[0] or 0
    least = max(4.0, rare * total**0.5)
    states = cut(moves.groupBy("k", "context").agg(F.sum("n").alias("total")).where(F.col("total") >= least), "states")
    kept = cut(moves.join(states, ["k", "context"]).where(F.col("n") * 4 >= least), "kept")
    shorter = kept.select((F.col("k") + 1).alias("k"), F.col("gram").alias("suffix"), (F.col("n") / F.col("total")).alias("before"))
    suffix = F.col("gram")
    for k in range(1, DEPTH + 1):
        suffix = F.when(F.col("k") == k, F.col("gram").bitwiseAND(F.lit(_mask(k)).cast("long"))).otherwise(suffix)
    gain = 2 * F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("before")))
    tested = kept.where("k > 0").withColumn("suffix", suffix).join(shorter, ["k", "suffix"]).groupBy("k", "context").agg(gain.alias("gain"), F.count("*").alias("followers"))
    nodes = tested.where(F.col("gain") >= divergence * (F.col("followers") + 6 * F.sqrt("followers")))
    closure = F.array(*(F.when(F.col("k") >= j, F.struct(F.lit(j).alias("k"), F.col("context").bitwiseAND(F.lit(_mask(j)).cast("long")).alias("context"))) for j in range(1, DEPTH + 1)))
    nodes = nodes.select(F.explode(F.array_compact(closure)).alias("x")).select("x.*").distinct()
    tree = cut(kept.where("k = 0").unionByName(kept.join(nodes, ["k", "context"], "left_semi").select(*kept.columns)).select("k", "gram", "n", "total"), "tree")
    model = {"table": tree, "slices": max(1, -(-tree.count() // MOST)), "total": int(total)}
    return model | _levels(tree) if model["slices"] == 1 else model


def _levels(tree: DataFrame) -> dict:
    """``levels``: per level the sorted contexts with their back-off share, and the sorted transitions with their
    discounted probability. ``tree`` is a slice."""
    final, levels = tree.toArrow(), []
    level, *columns = (final.column(c).to_numpy() for c in ("k", "gram", "n", "total"))
    for k in range(DEPTH + 1):
        at = np.flatnonzero(level == k)
        at = at[np.argsort(columns[0][at])]
        gram, n, of = (c[at] for c in columns)
        chance = np.maximum(n - DISCOUNT, 0) / np.maximum(of, 1)
        context, first = np.unique(gram >> 8, return_index=True)
        rest = 1 - np.add.reduceat(chance, first) if len(gram) else np.zeros(0)
        levels.append((context.astype(np.uint64), rest, gram.astype(np.uint64), chance))
    return {"levels": levels}


def log_chances(code: np.ndarray, model: dict) -> np.ndarray:
    """log10 probability of each gram's last symbol, in the longest suffix state of those before it. ``code`` sorted."""
    p = np.full(len(code), 1 / 256)
    at = np.arange(len(code))
    for k, (context, rest, gram, chance) in enumerate(model["levels"]):
        if not len(context) or not len(at):
            break
        own = code[at] & np.uint64(_mask(k + 1))
        i = np.minimum(np.searchsorted(context, own >> np.uint64(8)), len(context) - 1)
        known = context[i] == own >> np.uint64(8)
        at, own, i = at[known], own[known], i[known]
        j = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
        p[at] = rest[i] * p[at] + np.where(gram[j] == own, chance[j], 0.0)
    return np.log10(p)


class Remembered:
    """``log_chances`` of any grams, those met before looked up in a table of ``CELLS`` cells."""

    def __init__(self, model: dict):
        self.model = model
        self.code, self.chance = np.full(1 << CELLS, np.iinfo(np.uint64).max), np.zeros(1 << CELLS)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        at = self.cell(code)
        out = self.chance[at]
        new = np.flatnonzero(self.code[at] != code)
        if len(new):
            distinct, back = np.unique(code[new], return_inverse=True)
            found = log_chances(distinct, self.model)
            out[new] = found[back]
            at, first = np.unique(self.cell(distinct), return_index=True)
            self.code[at], self.chance[at] = distinct[first], found[first]
        return out

    def cell(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELLS)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", rare: float = 0.003, common: float = 1e-6) -> dict:
    """The model of all rows of ``docs``; null texts are empty. An empty table gives equal chances."""
    counted = cut(docs.select(text_col).mapInArrow(_gather, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n")), "counted")
    words = counted.where("word is not null").select("word", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where((F.col("n") >= max(1.0, common * n)) | (F.col("word") == F.lit(END))).toArrow()  # 1 / common at most
    often = dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist(), strict=True))
    return {"tree": grow(counted.where("gram is not null").select("gram", "n"), rare), "often": often, "rare": words.where((F.col("n") < max(1.0, common * n)) & (F.col("word") != F.lit(END))), "n": n, "v": v}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score (the word model's), score (the tree's), both
    log10. Words and the end are tokens; null texts are empty. Other columns are not read."""
    slices = model["tree"].get("slices", 1)
    n, v = model["n"], model["v"]
    log_all = log10(n + v + 1)
    names = ["row", "doc_id", "word", "times", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch], own_slice: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
        tree, often = shared.value
        chances = Remembered(tree)
        logs = {w: log10(c + 1) - log_all for w, c in often.items()}
        end = logs.get(END)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            row, ids = batch.column(0).to_pylist(), batch.column(1)
            texts, known, base, own_rows, own_words, own_times, tokens = [], [], [], [], [], [], []
            for r, t in zip(row, batch.column(2).to_pylist(), strict=True):
                words = words_of(t)
                texts.append(b" ".join(words))
                if own_slice:
                    continue
                found = [logs.get(w) for w in words]
                rare = Counter(w for w, x in zip(words, found, strict=True) if x is None)
                hits = [x for x in found if x is not None]
                tokens.append(len(words) + 1)
                known.append(len(hits) + (end is not None))
                base.append(sum(hits) + (-log_all if end is None else end))
                own_rows += [r] * len(rare)
                own_words += rare.keys()
                own_times += rare.values()
            scores, at = np.zeros(len(texts)), 0
            for block in _blocks(texts):
                code, starts = grams(block)
                if slices == 1:
                    found = chances(code)
                else:
                    found, mine = np.zeros(len(code)), np.flatnonzero(_slice((code >> np.uint64(8)).astype(np.int64) & 65535, slices) == own_slice)
                    found[mine] = chances(code[mine])
                scores[at : at + len(block)] = np.add.reduceat(found, starts)
                at += len(block)
            if own_slice:  # words were counted with the first slice
                zeros = [pa.array(np.zeros(len(texts), np.int64)) for _ in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([END + str(r).encode() for r in row], pa.binary()), *zeros, pa.array(np.zeros(len(texts))), pa.array(scores)], names)
                continue
            k, m = len(texts), len(own_rows)
            # a document's own row is joined by a key that is no word, so that such rows spread over all tasks
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([END + str(r).encode() for r in row], pa.binary()), pa.array(np.zeros(k, np.int64)), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores)], names)
            for a in range(0, m, 100_000):
                part = slice(a, a + 100_000)
                size = len(own_rows[part])
                zero, none = pa.array(np.zeros(size, np.int64)), pa.array(np.zeros(size))
                yield pa.RecordBatch.from_arrays([pa.array(own_rows[part], pa.int64()), pa.nulls(size, pa.int64()), pa.array(own_words[part], pa.binary()), pa.array(own_times[part], pa.int64()), zero, zero, none, none], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "row long, doc_id long, word binary, times long, n_tokens long, n_known long, base double, score double"
    rows = rows if slices == 1 else cut(rows, "rows")
    parts: DataFrame | None = None
    for k in range(slices):
        tree = model["tree"] if slices == 1 else _levels(model["tree"]["table"].where((F.col("k") < 2) | (_slice(F.shiftright("gram", 8).bitwiseAND(65535), slices) == k)))
        shared = docs.sparkSession.sparkContext.broadcast(({"levels": tree["levels"]}, model["often"]))
        part = rows.mapInArrow(lambda it, k=k, shared=shared: run(it, k, shared), kind)
        if slices > 1:
            part = cut(part, "scored")
            shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    joined = parts.join(model["rare"], "word", "left").select(
        "row", "doc_id", "n_tokens", "score",
        (F.col("n_known") + F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - log_all)).alias("base"),
    )
    return joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row")
