"""Secret scans: rules for well-known shapes, and character Markov models for the rest.

Two first-order Markov models over the characters of keys and identifiers are trained from labelled samples, one from
random strings and one from ordinary identifiers. Every run of ``SHORTEST`` identifier characters or more that touches
no rule's span is scored by the log-likelihood ratio of all its transitions, whatever characters it has, and reported
if the sum is high enough: a longer string needs less evidence a character.

Labelled samples: a table of (value, random) rows; or, from a corpus, the values that the rules find as random strings
and the other runs of ``NAMED`` identifier characters or more as ordinary identifiers; but for runs as long as a key,
as these are what the scan is to judge.

Spans are code points, the end exclusive, ordered by start, then kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed; the first three are the rules'.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Identifier characters that a run has at least: to be scored, to be an ordinary identifier in training, and to be too
#: much like a key for that.
SHORTEST, NAMED, KEYLIKE = 12, 5, 16
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(SYMBOLS) + 1
#: Symbol number of each byte; 0 is what bounds an identifier.
NUMBER = np.zeros(256, dtype=np.int64)
NUMBER[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(1, SIZE)
#: Log-likelihood ratio (nats, of all transitions) from which a run counts as random.
LIMIT = 25.0
#: Part of a random string's next symbols that is taken as equally likely, whatever the samples' alphabets.
EVEN = 0.5
#: Weight of identifiers in other styles beside the ordinary ones that samples hold.
STYLED = 0.05
#: Texts taken up at once.
ROWS = 512


def _numbers(data: bytes) -> np.ndarray:
    return NUMBER[np.frombuffer(data, np.uint8)]


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of identifier characters; ``at`` begins and ends with none."""
    edge = np.flatnonzero((at[1:] > 0) != (at[:-1] > 0)) + 1
    return edge[::2], edge[1::2]


def _transitions(at: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Counts of the transitions between neighbours; of those that touch a symbol, or whose later or earlier symbol is
    ``inside``."""
    pair = at[:-1] * SIZE + at[1:]
    found = np.bincount(pair if inside is None else pair[inside[1:] | inside[:-1]], minlength=SIZE * SIZE)
    found[0] = 0
    return found


def rule_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, rank of the kind, end, start of the value) of what the rules find."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), k, m.end(), m.start()) for k, rule in ((1, ACCESS), (2, HEX)) for m in rule.finditer(text)]
    return sorted(found)


def _may_match(texts: pa.Array) -> np.ndarray:
    """Rows that a rule can match; a fast scan that has no false negatives."""
    out = pc.match_substring_regex(texts, "password|passwd|secret|token|api_?key", ignore_case=True)
    for pattern in ("AKIA", "[0-9a-f]{24}"):
        out = pc.or_(out, pc.match_substring_regex(texts, pattern))
    return out.to_numpy(zero_copy_only=False)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of the texts' UTF-8 bytes with a bound before, between and after; each text's first place."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) + 1 for d in data], dtype=np.int64)
    return _numbers(b" " + b" ".join(data) + b" "), np.cumsum(sizes) - sizes + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of this task's texts: of what the rules found, and of ordinary identifiers."""
    counts = np.zeros((2, SIZE * SIZE), dtype=np.int64)
    for batch in batches:
        every = pc.fill_null(batch.column(0), "")
        for part in (every.slice(k, ROWS) for k in range(0, len(every), ROWS)):
            texts = part.to_pylist()
            at, first = _joined(texts)
            taken = np.zeros(len(at), dtype=bool)
            for i in np.flatnonzero(_may_match(part)).tolist():
                text = texts[i]
                for value in {(v, end) for _, _, end, v in rule_spans(text)}:
                    own = text[slice(*value)].encode()
                    counts[1] += _transitions(_numbers(b" " + own + b" "))
                    place = first[i] + len(text[: value[0]].encode("utf-8", "surrogatepass"))
                    taken[place : place + len(own)] = True
            start, end = _runs(at)
            size = end - start
            by_rule = np.add.reduceat(taken.astype(int), np.stack([start, end], axis=1).ravel())[::2] if len(start) else size
            named = (size >= NAMED) & (size < KEYLIKE) & (by_rule == 0)
            inside = np.zeros(len(at) + 1, dtype=np.int8)
            inside[start[named]] += 1
            inside[end[named]] -= 1
            counts[0] += _transitions(at, np.cumsum(inside[:-1], dtype=np.int8) > 0)
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label == 1), pa.array(pair), pa.array(counts[label, pair])], ["random", "pair", "n"])


def _count_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, SIZE * SIZE), dtype=np.int64)
    for batch in batches:
        for value, random in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if value is not None and random is not None:
                counts[int(random)] += _transitions(_numbers(b" " + value.encode("utf-8", "surrogatepass") + b" "))
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label == 1), pa.array(pair), pa.array(counts[label, pair])], ["random", "pair", "n"])


def styled(counts: np.ndarray) -> np.ndarray:
    """Transitions of identifiers that are made of the same lower-case words: in capitals, in camel case, joined by a
    separator, with a number behind, and rows of separators."""
    upper, lower, digits = slice(1, 27), slice(27, 53), slice(53, 63)
    inner, first, last = counts[lower, lower], counts[0, lower], counts[lower, 0]
    second = inner * (first / np.maximum(inner.sum(axis=1), 1))[:, None]
    out, n = np.zeros_like(counts), last.sum()
    out[upper, upper] += inner
    out[lower, upper] += np.outer(last, first) / max(1.0, first.sum())
    out[upper, lower] += second
    for word in (upper, lower):
        out[0, word] += first
        out[word, 0] += last
        out[word, digits] += last[:, None] / 10
        for separator in range(63, SIZE):
            out[word, separator] += last
            out[separator, word] += first
    out[63:, 63:] += n * np.eye(SIZE - 63)
    out[63:, 0] += n
    out[0, 63:] += n
    out[63:, digits] += n / 10
    out[digits, 63:] += n / 10
    out[digits, digits] += n / 20
    out[digits, 0] += n / 10
    return out


def _ratios(counted: DataFrame) -> np.ndarray:
    """Log ratio of each transition's probability in random strings to that in ordinary ones. A part ``EVEN`` of the
    random strings' chances is equal for every symbol, so that alphabets absent from the samples are known too;
    ordinary ones know the styles of ``styled`` and back off to their symbols' frequencies."""
    counts = np.zeros((2, SIZE * SIZE))
    for row in counted.groupBy("random", "pair").agg(F.sum("n").alias("n")).toLocalIterator():  # 2 * SIZE**2 rows at most
        counts[int(row.random), row.pair] = row.n
    counts = counts.reshape(2, SIZE, SIZE)
    counts[0] += STYLED * styled(counts[0])
    every = counts[0].sum(axis=0) + 1
    prior = np.stack([SIZE * every / every.sum(), np.where(np.arange(SIZE) > 0, 1.0, 2.0)])[:, None, :]
    chance = (counts + prior) / (counts + prior).sum(axis=2, keepdims=True)
    random = EVEN / SIZE + (1 - EVEN) * chance[1]
    return np.log(random / chance[0])


def train(samples: DataFrame, value_col: str = "value", random_col: str = "random") -> np.ndarray:
    """The model from labelled samples: a table of strings, each marked as random or ordinary; nulls are left out."""
    return _ratios(samples.select(value_col, random_col).mapInArrow(_count_samples, "random boolean, pair long, n long"))


def train_weakly(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The model from all texts of a corpus, labelled by the rules."""
    return _ratios(docs.select(text_col).mapInArrow(_count, "random boolean, pair long, n long"))


def scan_secrets(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """(doc_id, spans): per row of ``docs`` the spans found, array<struct<start, rank, end, kind, ratio>>.

    The model adds spans of kind ``markov`` for runs of ``SHORTEST`` identifier characters or more that touch no
    rule's span; ``ratio`` is the sum of the log ratios. Null and empty texts have no spans; rows repeat as in
    ``docs``; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("ratio", pa.float64())]))
        ratios = shared.value.ravel()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            column = pc.fill_null(batch.column(1), "")
            texts = column.to_pylist()
            found: dict[int, list[tuple]] = {int(i): [(s, k, e, None) for s, k, e, _ in rule_spans(texts[int(i)])] for i in np.flatnonzero(_may_match(column))}
            at, first = _joined(texts)
            start, end = _runs(at)
            start, end = start[long := end - start >= SHORTEST], end[long]
            if len(start):
                sums = np.r_[0, np.cumsum(ratios[at[:-1] * SIZE + at[1:]])]  # of the transitions up to each place
                ratio = sums[end] - sums[start - 1]
                for k in np.flatnonzero(ratio >= limit).tolist():
                    i = int(np.searchsorted(first, start[k], side="right")) - 1
                    own = texts[i].encode("utf-8", "surrogatepass")
                    begin = len(own[: start[k] - first[i]].decode("utf-8", "surrogatepass"))
                    stop = begin + int(end[k] - start[k])
                    if not any(s < stop and begin < e for s, kind_, e, _ in found.get(i, ()) if kind_ < 3):
                        found.setdefault(i, []).append((begin, 3, stop, float(ratio[k])))
            out = [[{"start": s, "rank": k, "end": e, "kind": KINDS[k], "ratio": r} for s, k, e, r in sorted(found.get(i, ()), key=lambda x: x[:3])] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start:int,rank:int,end:int,kind:string,ratio:double>>")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
