"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's chance is a logistic function of the words and word beginnings (by themselves and with their words' length) in it; a document's is the noisy-or of its
sentences. Weights are learned from document labels alone and then point at the offending sentences.

Learning uses a bounded sample of labelled rows: ``max_rows`` of each class, taken by a hash of the id and weighted
back to their true numbers. Scores use every sentence of every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKENS = re.compile(r"\w+|[.!?\n]+")
#: Beginnings of so many characters count as features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words whose features a task remembers at once.
REMEMBERED = 300_000


def word_features(word: str) -> list[str]:
    """The word, its beginnings, and these with the number of characters that follow: endings vary, within a length."""
    starts = [(word[:n], len(word) - n) for n in BEGINNINGS if len(word) > n]
    return [word, *(f"{w}~" for w, _ in starts), *(f"{w}~{rest}" for w, rest in starts)]


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature the sampled documents of each class that have it."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = set(TOKENS.findall((text or "").lower()))
            counts[int(toxic)].update({f for w in words for f in word_features(w)})
    found = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(found), 50_000):
        part = found[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": part, "clean": [counts[0][f] for f in part], "toxic": [counts[1][f] for f in part]})


def sentences(text: str, known: dict[str, list[int]], number: dict[str, int]) -> list[tuple[int, list[int]]]:
    """(index, features) of the sentences with known features; the last element is (sentences in all, [])."""
    out: list[tuple[int, list[int]]] = []
    index, own, words = 0, [], False
    for token in TOKENS.findall(text.lower()):
        found = known.get(token)
        if found is None:
            if len(known) > REMEMBERED:
                known.clear()
            found = known[token] = [-1] if token[0] in ".!?\n" else [number[f] for f in word_features(token) if f in number]
        if found and found[0] < 0:
            if own:
                out.append((index, own))
            index, own, words = index + words, [], False
        else:
            words = True
            if found:
                own = own + found
    if own:
        out.append((index, own))
    out.append((index + words, []))
    return out


def _sparse(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[int]] = {}
    for batch in batches:
        rows = [sentences(t or "", known, number) for t in batch.column(1).to_pylist()]
        features = [[sorted(set(own)) for _, own in r[:-1]] for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[-1][0] for r in rows], pa.int32()), pa.array(features, pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "n", "features"])


def likelihood(p: np.ndarray, total: np.ndarray, toxic: np.ndarray, share: np.ndarray, owner: np.ndarray, lengths: np.ndarray, ids: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The negative log-likelihood of the documents' labels, each with its share, under weights and bias ``p``; and its
    gradient. The other arguments are those of ``fit``."""
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    empty = total - np.bincount(owner, minlength=len(total))
    z = np.bincount(sentence, p[:-1][ids], minlength=len(lengths)) + p[-1]
    s, plain = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-p[-1]))
    clean = np.bincount(owner, np.logaddexp(0, z), minlength=len(total)) + empty * np.logaddexp(0, p[-1])  # -log of no sentence being toxic
    value = (share * np.where(toxic, -np.log(np.maximum(-np.expm1(-clean), 1e-300)), clean)).sum() + decay / 2 * (p[:-1] ** 2).sum()
    slope = share * np.where(toxic, -1 / np.maximum(np.expm1(np.minimum(clean, 50)), 1e-6), 1.0)
    to_z = slope[owner] * s
    return value, np.r_[np.bincount(ids, to_z[sentence], minlength=len(p) - 1) + decay * p[:-1], to_z.sum() + (slope * empty * plain).sum()]


def fit(total: np.ndarray, toxic: np.ndarray, weight: np.ndarray, owner: np.ndarray, lengths: np.ndarray, ids: np.ndarray, start: np.ndarray, rounds: int = 400, decay: float = 2e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence model, by Adam on the noisy-or likelihood of the documents.

    ``total``: each document's sentences; ``owner`` and ``lengths``: the document and the number of features of each
    sentence that has any; ``ids``: these features, one sentence after the other. ``start``: the features' log odds, so that every word that only toxic documents have counts, not just those that
    suffice to explain the sample.
    """
    p = np.r_[start, -7.0]
    m, v = np.zeros_like(p), np.zeros_like(p)
    share = weight / weight.sum()
    for t in range(1, rounds + 1):
        g = likelihood(p, total, toxic, share, owner, lengths, ids, decay)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        p[-1] = min(p[-1], -3.0)
    return p[:-1], float(p[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_rows: int = 6000, max_features: int = 3000) -> dict:
    """The model from documents and a table of labels by id; null labels are left out, of several labels of an id the
    highest counts, a null text counts as empty. ``max_rows`` bounds the sample of each class (in expectation).

    Features are those whose share differs most between the classes of the sample, each in four documents at least.
    """
    marks = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(toxic_col) > 0).alias("toxic"))
    n = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"number": {}, "weights": np.zeros(0), "bias": -20.0 if not n.get(True) else 3.0}
    share = {k: min(1.0, max_rows / x) for k, x in n.items()}
    unit = F.xxhash64("doc_id").bitwiseAND(0xFFFFFF) / float(1 << 24)
    drawn = marks.where(unit < F.when(F.col("toxic"), share[True]).otherwise(share[False]))  # of bounded size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = cut(rows.join(F.broadcast(drawn), "doc_id"), "sample")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = max(1, size.get(True, 0)), max(1, size.get(False, 0))
    rate, base = (F.col("toxic") + 0.5) / (a + 1.0), (F.col("clean") + 0.5) / (b + 1.0)
    shared = (F.col("toxic") + F.col("clean") + 1.0) / (a + b + 2.0)
    strength = (rate - base) / F.sqrt(shared * (1 - shared) * (1 / a + 1 / b))
    counted = sample.mapInArrow(_class_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counted.where("clean + toxic >= 4").withColumn("strength", strength).where("strength >= 4").orderBy(F.desc("strength"), "feature").limit(max_features).collect()
    same = {(r.feature, r.toxic, r.clean) for r in best}
    start = lambda r: r.feature.split("~")[0]
    best = [r for r in best if not any((f"{start(r)[:k]}~", r.toxic, r.clean) in same for k in BEGINNINGS if k < len(start(r)) + ("~" in r.feature[:-1]))]
    number = {r.feature: i for i, r in enumerate(best)}
    start = np.array([0.8 * np.log((r.toxic + 0.5) / (a + 1) / ((r.clean + 0.5) / (b + 1))) for r in best])
    found = sample.mapInArrow(lambda it: _sparse(it, number), "doc_id long, toxic boolean, n int, features array<array<int>>").toArrow().sort_by("doc_id").combine_chunks()  # max_rows of each class
    toxic, total = (found.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "n"))
    features = found.column("features").combine_chunks()
    sentence = features.flatten()
    owner, lengths = np.repeat(np.arange(len(features)), features.value_lengths().to_numpy()), sentence.value_lengths().to_numpy()
    weight = np.where(toxic, 1 / share[True], 1 / share[False])
    weights, bias = fit(total, toxic, weight, owner, lengths, sentence.flatten().to_numpy().astype(np.int64), start)
    return {"number": number, "weights": weights, "bias": bias}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", from_score: float = 0.5) -> DataFrame:
    """(doc_id, score, n_sentences, offending array<int>) for each row.

    ``offending``: indexes of the sentences whose own chance is ``from_score`` or more. A null, empty or wordless text
    has no sentences and score 0. Rows repeat as in ``docs``; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights, bias = (shared.value[k] for k in ("number", "weights", "bias"))
        plain, known = float(np.logaddexp(0, bias)), {}
        at = float(np.log(from_score / (1 - from_score)))
        for batch in batches:
            total, out, spots = [], [], []
            for text in batch.column(1).to_pylist():
                found = sentences(text or "", known, number)
                z = [(i, bias + float(weights[sorted(set(own))].sum())) for i, own in found[:-1]]
                loss = sum(float(np.logaddexp(0, x)) for _, x in z) + plain * (found[-1][0] - len(z))
                total.append(found[-1][0])
                out.append(min(1.0, max(0.0, -float(np.expm1(-loss)))))
                spots.append([i for i, x in z if x >= at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(total, pa.int32()), pa.array(spots, pa.list_(pa.int32()))], ["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, n_sentences int, offending array<int>")
