"""Hierarchical language ID: the language family first, then one-versus-one linear SVMs between its languages.

Features are hashed letter trigrams of the whole text, as square roots of counts scaled to length one. Support vector
machines are fitted by dual coordinate descent, each in a task of its own, on a bounded sample of labelled rows
(``per_language`` rows a language, taken by a hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, giving_back

#: Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn ur pa mr gu ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
SIZE = 4096
UNDETERMINED = "und"
#: Bytes other than ASCII letters and those of longer characters count as one separator.
LETTER = np.array([b if chr(b).isalpha() or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


def features(texts: list[str]) -> np.ndarray:
    """A row for each text; a text of fewer than one letter has a zero row."""
    data = [LETTER[np.frombuffer(b" " + t.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)] for t in texts]
    lengths = np.array([len(d) for d in data])
    flat = np.concatenate(data).astype(np.uint32)
    code = (flat[:-2] << np.uint32(16)) | (flat[1:-1] << np.uint32(8)) | flat[2:]
    cell = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = (owner[:-2] == owner[2:]) & (code != 0x202020)
    out = np.sqrt(np.bincount(owner[:-2][inside] * SIZE + cell[inside], minlength=len(texts) * SIZE).reshape(-1, SIZE).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, positive: np.ndarray, c: float = 4.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM, classes weighted to equal sums."""
    y = np.where(positive, 1.0, -1.0)
    most = np.where(positive, c * len(y) / (2 * max(1, positive.sum())), c * len(y) / (2 * max(1, (~positive).sum())))
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), (x * x).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(w @ x[i]) - 1) / norm[i], 0.0), most[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def _models(langs: list[str]) -> list[tuple[str, str, str]]:
    """(name, positive side, negative side): each family against the rest, then pairs of languages in a family."""
    families = sorted({family(x) for x in langs})
    found = [(f"family:{f}", f, "") for f in families] if len(families) > 2 else [(f"family:{families[0]}", families[0], "")] if len(families) == 2 else []
    return found + [(f"pair:{a}:{b}", a, b) for a, b in combinations(sorted(langs), 2) if family(a) == family(b)]


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (model, positive, text) arrive sorted by model; a model's rows are a bounded sample."""
    name, texts, positive = None, [], []

    def fitted() -> pa.RecordBatch:
        x = np.vstack([features(texts[i : i + 256]) for i in range(0, len(texts), 256)])
        return pa.RecordBatch.from_pydict({"model": [name], "weights": [fit_svm(x, np.array(positive)).tobytes()]})

    for batch in batches:
        for model, side, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if model != name and texts:
                yield fitted()
                texts, positive = [], []
            name = model
            texts.append(text)
            positive.append(side)
    if texts:
        yield fitted()


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500) -> dict:
    """Languages and weights from labelled rows; rows with a null text or language are left out.

    ``per_language`` bounds the sample (in expectation: rows are taken by a hash of the id).
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(counts)
    wanted = _models(langs)
    if not wanted:
        return {"langs": langs, "weights": {}}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    sample = rows.where((F.xxhash64("doc_id").bitwiseAND(0xFFFFFF) / float(1 << 24)) < share)
    sides = [(name, lang, family(lang) == a if name.startswith("family:") else lang == a) for name, a, b in wanted for lang in langs if name.startswith("family:") or lang in (a, b)]
    of = labelled.sparkSession.createDataFrame(sides, "model string, lang string, positive boolean")
    dealt = cut(sample, "sample").join(F.broadcast(of), "lang").repartition("model").sortWithinPartitions("model", "doc_id", "text")
    fitted = dealt.select("model", "positive", "text").mapInArrow(giving_back(_fit), "model string, weights binary")
    return {"langs": langs, "weights": {r.model: np.frombuffer(bytes(r.weights), np.float32) for r in fitted.collect()}}  # a row for each model


def predict_batch(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    langs, weights = model["langs"], model["weights"]
    known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts]) if texts else np.zeros(0, bool)
    if not langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    names = list(weights)
    x = features([t or "" for t in texts])
    margins = dict(zip(names, (x @ np.stack([weights[n][:-1] for n in names]).T + np.array([weights[n][-1] for n in names])).T, strict=True)) if names else {}
    families = sorted({family(v) for v in langs})
    of_family = {f: np.zeros(len(texts)) for f in families}
    for name, m in margins.items():
        if name.startswith("family:"):
            f = name.split(":", 1)[1]
            of_family[f] = m
            if len(families) == 2:
                of_family[next(g for g in families if g != f)] = -m
    best = np.argmax(np.stack([of_family[f] for f in families]), axis=0)
    sure = 1 / (1 + np.exp(-4 * np.max(np.stack([of_family[f] for f in families]), axis=0))) if len(families) > 1 else np.ones(len(texts))
    lang, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
    for k, f in enumerate(families):
        own = [v for v in langs if family(v) == f]
        votes, sums = np.zeros((len(own), len(texts))), np.zeros((len(own), len(texts)))
        for i, j in combinations(range(len(own)), 2):
            m = margins[f"pair:{own[i]}:{own[j]}"]
            votes[i] += m >= 0
            votes[j] += m < 0
            sums[i] += m
            sums[j] -= m
        won = np.argmax(votes + np.tanh(sums) / 4, axis=0)
        mean = sums[won, np.arange(len(texts))] / max(1, len(own) - 1)
        here = (best == k) & known
        lang[here] = np.array(own, dtype=object)[won[here]]
        score[here] = (sure * (1 / (1 + np.exp(-4 * mean)) if len(own) > 1 else 1.0))[here]
    return list(lang), np.clip(score, 0.0, 1.0)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row: ``und`` with score 0 if the text is null or has no letter, or if
    nothing was learned. Rows repeat as in ``docs``; other columns are not read."""
    run = _predictor(docs, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                lang, score = run(batch.column(1).slice(at, 128).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 128), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(scored), "doc_id long, lang_pred string, score double")


def _predictor(docs: DataFrame, model: dict):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: predict_batch(texts, shared.value)


def accepted(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text's language can be told, with a score of ``least`` or more; all their columns."""
    run, at = _predictor(docs, model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            lang, score = run(batch.column(at).to_pylist())
            yield batch.filter(pa.array([v != UNDETERMINED and s >= least for v, s in zip(lang, score, strict=True)]))

    return docs.mapInArrow(giving_back(keep), docs.schema)
