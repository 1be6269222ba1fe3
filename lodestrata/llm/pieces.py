"""SentencePiece encoding and decoding by suffix-array matching, for a BPE model with byte fallback.

A batch's distinct units (what lies between two places where no piece holds the two characters that meet) are
concatenated and indexed by a suffix array. Every piece of the vocabulary is binary-searched for its range of
occurrences; the occurrences are edges between text positions, sorted by their start. Relaxing them from left to right
finds, for each position, the piece that ends the encoding of the text so far: an edge holds if its piece and the one
before it are what merging their joint text in the model's order gives. The encoding of a prefix is unique, so one edge
at most holds for each end.

The vocabulary is read on the driver (its size is the model's) and broadcast; tasks need no file. A worker process keeps
its encoder, with the pairs of pieces and some of the units it has met, for the tasks that follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands between units in the index; it must not occur in a piece of two characters or more.
GAP = "\n"
#: Units remembered before those not met again are forgotten, and characters of new units indexed at once.
REMEMBERED = 100_000
INDEXED = 1 << 18
#: Units that an encoder keeps between tasks.
KEPT = 50_000
#: Texts taken up at once.
ROWS = 512
#: Cells of a task's table of piece pairs.
PAIRS = 1 << 21


class Vocabulary:
    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes_at = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        inner = {c for p in self.id_of if len(p) > 1 for c in p}
        if GAP in inner or not inner <= self.id_of.keys():
            raise ValueError("this vocabulary's pieces hold the gap or lack single characters")
        self.dense = np.zeros(0x110000, dtype=np.int32)  # number of each character that pieces join to others
        self.dense[[ord(c) for c in sorted(inner)]] = np.arange(1, len(inner) + 1)
        self.meet = np.zeros((len(inner) + 1, len(inner) + 1), dtype=bool)  # whether a piece holds the two side by side
        for p in self.id_of:
            at = self.dense[[ord(c) for c in p]]
            self.meet[at[:-1], at[1:]] = True
        texts = {i: p.replace(SPACE, " ").encode() for p, i in self.id_of.items()} | {i: bytes([b]) for b, i in self.bytes_at.items()}
        self.text_of = [texts.get(i, b"") for i in ids]
        self.key = hashlib.sha256(repr((self.text_of, sorted(self.score.items()))).encode()).hexdigest()


class Encoder:
    """Encodes batches of texts; remembers units."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.names = sorted(v.id_of)
        self.name_ids = [v.id_of[p] for p in self.names]
        self.name_at = {i: p for p, i in v.id_of.items()}
        self.traces: dict[int, list[tuple[float, str, str]]] = {}
        self.lengths = np.array([len(p) for p in self.names], dtype=np.int32)
        self.size_at = np.ones(len(v.text_of), dtype=np.int32)
        for p, i in v.id_of.items():
            self.size_at[i] = len(p)
        self.table = np.zeros((len(self.names), v.longest), dtype=np.int32)
        for row, p in enumerate(self.names):
            self.table[row, : len(p)] = v.dense[[ord(c) for c in p]]
        several = (self.table > 0).all(axis=1, where=np.arange(v.longest)[None, :] < self.lengths[:, None])
        self.rows = np.flatnonzero(several)  # a character that joins no other is a unit of its own
        self.inside = np.arange(v.longest)[None, :] < self.lengths[:, None]
        begins = self.table[self.rows, :3].astype(np.int64)
        begins = np.pad(begins, ((0, 0), (0, 3 - begins.shape[1])))
        some = np.where(np.arange(3)[None, :] < self.lengths[self.rows, None], begins, (1 << 20) - 1)
        self.least_key, self.most_key = (b[:, 0] << 40 | b[:, 1] << 20 | b[:, 2] for b in (begins, some))
        self.pair_key, self.pair_holds = np.full(PAIRS, -1, dtype=np.int64), np.zeros(PAIRS, dtype=bool)

    def trace(self, piece: int) -> list[tuple[float, str, str]]:
        """The model's merges on a piece's own text, best score first, leftmost of equals: after each its score, and
        the first and last part. The list begins with the single characters."""
        if piece in self.traces:
            return self.traces[piece]
        score, parts = self.v.score, list(self.name_at[piece])
        out = [(0.0, parts[0], parts[-1])]
        while len(parts) > 1:
            found = [(score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in score]
            if not found:
                break
            best, i = max(found)
            parts[-i : -i + 2] = [parts[-i] + parts[-i + 1]]
            out.append((best, parts[0], parts[-1]))
        self.traces[piece] = out if len(parts) == 1 else []
        return self.traces[piece]

    def holds(self, before: int, piece: int) -> bool:
        """Whether ``piece`` can follow ``before`` (-1: begin a unit) in an encoding: merging both side by side, no
        merge across the border comes first."""
        b = self.trace(piece)
        if before < 0 or not b:
            return bool(b)
        a, score = self.trace(before), self.v.score
        i = j = 1
        while True:
            own, other = a[i][0] if i < len(a) else None, b[j][0] if j < len(b) else None
            across = score.get(a[i - 1][2] + b[j - 1][1])
            if across is not None and (own is None or across > own) and (other is None or across >= other):
                return False
            if own is None and other is None:
                return True
            if other is None or own is not None and own >= other:
                i += 1
            else:
                j += 1

    def pairs_hold(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``holds`` for many, through the table of pairs met so far."""
        key = (before.astype(np.int64) + 1) << 20 | piece
        cell = (key * 0x9E3779B1 >> 7) & (PAIRS - 1)
        out = self.pair_holds[cell]
        new = np.flatnonzero(self.pair_key[cell] != key)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            ok = np.array([self.holds(int(b), int(p)) for b, p in zip(before[new[first]], piece[new[first]], strict=True)])
            self.pair_key[cell[new[first]]], self.pair_holds[cell[new[first]]] = keys, ok
            out[new] = ok[back]
        return out

    def suffixes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts sorted by the text that follows, as far as the longest piece: by three characters, then doubling; and
        the first three characters of each as one number."""
        padded = np.concatenate([at, np.zeros(2, dtype=at.dtype)]).astype(np.int64)
        rank, step, begins = (padded[:-2] << 40) | (padded[1:-1] << 20) | padded[2:], 3, None
        while True:
            order = np.argsort(rank)
            ranked = rank[order]
            begins = ranked if begins is None else begins
            rank[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
            if step >= self.v.longest:
                return order, begins
            later = np.zeros_like(rank)
            later[:-step] = rank[step:]
            rank, step = (rank << 32) | later, 2 * step

    def edges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, id of the piece) of all occurrences of pieces."""
        order, begins = self.suffixes(at)
        padded = np.concatenate([at, np.zeros(self.v.longest, dtype=at.dtype)])
        spread = np.arange(self.v.longest)[None, :]
        from_, to = np.searchsorted(begins, self.least_key, "left"), np.searchsorted(begins, self.most_key, "right")
        long_ = self.lengths[self.rows] > 3

        def bound(right: bool) -> np.ndarray:
            """Binary search of the pieces of over three characters among the starts that share their first three."""
            low, high = np.where(long_ | ~right, from_, to), np.where(long_ | right, to, from_)
            while (open_ := np.flatnonzero(low < high)).size:
                middle, rows = (low[open_] + high[open_]) // 2, self.rows[open_]
                differ = np.where(self.inside[rows], padded[order[middle][:, None] + spread] - self.table[rows], 0)
                first = differ[np.arange(len(open_)), np.argmax(differ != 0, axis=1)]
                below = first <= 0 if right else first < 0
                low[open_[below]] = middle[below] + 1
                high[open_[~below]] = middle[~below]
            return low

        low, high = bound(np.bool_(False)), bound(np.bool_(True))
        n = high - low
        start = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        return start.astype(np.int32), np.repeat(np.array(self.name_ids, dtype=np.int32)[self.rows], n)

    def learn(self, units: list[str]) -> None:
        """Encode new units of two characters or more, all of which pieces can join."""
        text = GAP + GAP.join(units) + GAP
        at = self.v.dense[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        first = np.cumsum(sizes + 1) - sizes
        offset = np.arange(len(at)) - np.repeat(np.r_[0, first], np.r_[1, sizes + 1])
        start, piece = self.edges(at)
        # relax all units side by side: edges in the order of their start's place in its unit
        order = np.argsort(offset[start], kind="stable")
        start, piece = start[order], piece[order]
        place = offset[start]
        last = np.full(len(at) + 1, -2, dtype=np.int32)  # the piece that ends the encoding so far; -1 where a unit begins
        last[first] = -1
        for a, b in zip(bounds := np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(place)], bounds[1:]):
            before = last[start[a:b]]
            ok = np.flatnonzero(self.pairs_hold(before, piece[a:b]))
            last[start[a:b][ok] + self.size_at[piece[a:b][ok]]] = piece[a:b][ok]
        # read the encodings off, from the units' ends
        end, which, found = first + sizes, np.arange(len(units)), []
        while len(which):
            p = last[end]
            found.append((which, p))
            end = end - self.size_at[p]
            more = end > first[which]
            which, end = which[more], end[more]
        owner, ids = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        flat = ids[np.argsort(owner, kind="stable")].astype(np.int32).tobytes()
        stops = (4 * np.cumsum(np.bincount(owner, minlength=len(units)))).tolist()
        self.memory.update(zip(units, (flat[a:b] for a, b in zip([0, *stops], stops)), strict=True))

    def split(self, text: str) -> list[str]:
        """The units of a text."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        at = self.v.dense[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = (np.flatnonzero(~self.v.meet[at[:-1], at[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memory) > REMEMBERED:
            self.older, self.memory = self.memory, {}
        split = [self.split(t) for t in texts]
        fresh: list[str] = []
        size = 0
        for u in set().union(*split) - self.memory.keys() if split else ():
            if u in self.older:
                self.memory[u] = self.older[u]
            elif len(u) > 1:
                fresh.append(u)
                size += len(u) + 1
                if size >= INDEXED:
                    self.learn(fresh)
                    fresh, size = [], 0
            elif u in self.v.id_of:
                self.memory[u] = np.array([self.v.id_of[u]], dtype=np.int32).tobytes()
            else:  # a character without a piece
                self.memory[u] = np.array([self.v.bytes_at[b] for b in u.encode("utf-8", "surrogatepass")], dtype=np.int32).tobytes()
        if fresh:
            self.learn(fresh)
        return [np.frombuffer(b"".join(map(self.memory.__getitem__, units)), np.int32) for units in split]


    def rest(self) -> None:
        """Forget all units but some of those that were met again."""
        again = self.memory.keys() & self.older.keys() if self.older else self.memory.keys()
        self.memory, self.older = {}, {u: self.memory[u] for u in islice(again, KEPT)}


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """This process's encoder for a vocabulary; one is held at a time."""
    if vocabulary.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.key] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.key]


def decode_ids(ids: np.ndarray, text_of: list[bytes]) -> str:
    """The text of piece ids; without the space that encoding puts in front."""
    data = b"".join(map(text_of.__getitem__, ids.tolist()))
    return data.decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model_file: str = MODEL, text_col: str = "text", into: str = "ids", decoded_into: str | None = None, kept: bool = True) -> DataFrame:
    """``docs`` with the piece ids of each whole text in the column ``into``; none for a null or empty text. All
    columns stay, one named ``into`` is replaced. ``decoded_into`` names a column for the text read back from the ids
    in the same pass. ``kept``: whether workers keep their encoder between tasks, which is faster and takes memory."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))
    new = [into] + ([decoded_into] if decoded_into else [])
    rest = [c for c in docs.columns if c not in new]
    at_text = rest.index(text_col) if text_col in rest else len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value) if kept else Encoder(shared.value)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            found = encoder.encode([t or "" for t in batch.column(at_text).to_pylist()])
            made = [_lists(found)]
            if decoded_into:
                made.append(pa.array([decode_ids(f, encoder.v.text_of) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *made], [*rest, *new])
        encoder.rest()

    rows = docs.select(*(F.col(f"`{c}`") for c in (rest if text_col in rest else [*rest, text_col])))
    kinds = [T.StructField(into, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_into, T.StringType())] if decoded_into else [])
    return rows.mapInArrow(giving_back(run), T.StructType([*(docs.schema[c] for c in rest), *kinds]))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    bounds = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))


def encode_checked(docs: DataFrame, model_file: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256, round_trip) for each row: the whole text's piece ids, the digest of the
    text decoded from them (UTF-8, lowercase hex), and whether that is the text again, its lower blocks (U+2581, which
    the model cannot tell from spaces) read as spaces. Decoded texts stay in the task. A null text is empty; rows repeat
    as in ``docs``; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = encoder.encode(texts)
            decoded = [decode_ids(f, encoder.v.text_of) for f in found]
            digests = [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]
            same = [d == t.replace(SPACE, " ") for d, t in zip(decoded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), _lists(found), pa.array(digests), pa.array(same)], ["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"])
        encoder.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model_file: str = MODEL, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``into``; empty for null ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_file).text_of)
    rest = [c for c in encoded.columns if c != into]
    at = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids = batch.column(at)
            texts = [decode_ids(np.asarray(ids[i].values) if ids[i].is_valid else np.zeros(0, np.int32), shared.value) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, into])

    rows = encoded.select(*(F.col(f"`{c}`") for c in rest))
    return rows.mapInArrow(giving_back(run), T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))
