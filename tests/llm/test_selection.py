"""Whitening, importance resampling and substring dedup against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodestrata.llm import queries, resampling, substrings, whitening

from .common import empty_documents, odd_documents, prose

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VECTORS = "vec_id long, embedding array<double>, n int, x string"


def plain_whitening(rows, k=16):
    """{(row number): (x, deviation, whitened)}, explained: from the singular vectors of the centred distinct lattice vectors, all at once."""
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(fit[0])
    total = [sum(f[j] for f in fit) for j in range(d)]
    a = np.array([[float(Fraction(n * f[j] - total[j], n)) for j in range(d)] for f in fit])
    _, singular, lines = np.linalg.svd(a, full_matrices=False)
    values, vectors = singular**2 / n, lines.T
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    white = [np.array([float(Fraction(n * x[j] - total[j], n)) for j in range(d)]) @ vectors[:, :k] / np.sqrt(values[:k]) for x in xs]
    return n, [sum((n * x[j] - total[j]) ** 2 for j in range(d)) for x in xs], white, values[:k] / values.sum()


def check_whitening(out, rows, tolerance=1e-7):
    n, deviation, white, explained = plain_whitening(list(rows.values()))
    found = {(r.vec_id, r.component): r for r in out}
    assert len(found) == len(out) == len(rows) * len(explained)
    for c, e in enumerate(explained):
        own = np.array([found[i, c + 1].whitened for i in rows])
        plain = np.array([w[c] for w in white])
        sign = np.sign(own @ plain)
        assert np.allclose(own, sign * plain, atol=tolerance)
        assert all(math.isclose(found[i, c + 1].explained, e, rel_tol=1e-8) for i in rows)
    assert all((r.n, r.deviation) == (n, deviation[list(rows).index(r.vec_id)]) for r in out)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error <= 1e-9


def test_whitening_against_the_covariance(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = {i: v.tolist() for i, v in enumerate(np.vstack([base, base[:40]]))}  # repeats count once in the fit
    odd = [(900, None), (901, [1.0] * 5 + [None]), (902, [1.0] * 5 + [float("nan")]), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "y") for i, v in [*rows.items(), *odd]], VECTORS).repartition(5)
    check_whitening(whitening.whitened_components(table).collect(), rows)


def test_whitening_of_dependent_and_constant_columns(spark):
    """Columns that repeat or never change have no component; those of very unlike size keep theirs."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(200, 3))
    v = np.column_stack([a[:, 0] * 2e4, a[:, 1], a[:, 2], a[:, 0] * 2e4, np.full(200, 7.0)])
    rows = {i: x.tolist() for i, x in enumerate(v)}
    out = whitening.whitened_components(spark.createDataFrame([(i, x, 1, "y") for i, x in rows.items()], VECTORS)).collect()
    assert {r.component for r in out} == {1, 2, 3}
    check_whitening(out, rows)


def test_whitening_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    same = spark.createDataFrame([(None, [1.0, 2.0], 1, "y")] * 3, VECTORS)
    for table in (empty, same):
        out = whitening.whitened_components(table)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    far = spark.createDataFrame([(None, [1e300], 1, "y"), (1, [-1e300], 1, "y")], VECTORS)
    found = whitening.whitened_components(far).collect()
    assert sorted(round(r.whitened, 9) for r in found) == [-1, 1] and {r.deviation for r in found} == {None}  # beyond a long


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op11(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check_whitening(queries.op11_embedding_whitening(spark, SF).collect(), rows, 1e-6)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_resampling(docs, target, least=20, percent=10, seed="2024", width=1, buckets=10_000):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x):
                counts[b] += 1
    whole, wanted = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for d, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)) >= least))
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {}
    for i, x in enumerate(order[: percent * len(order) // 100]):
        rank.setdefault(x[:4], []).append(i + 1)
    return sorted(((*x[:4], rank[x[:4]].pop(0) if rank.get(x[:4]) else None) for x in out), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op12(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = sorted(map(tuple, queries.op12_importance_resampling(spark, SF).collect()), key=str)
    assert out == plain_resampling(docs, target) and sum(r[4] is not None for r in out) > 10


@pytest.mark.parametrize("width", [1, 2, 3])
def test_resampling_of_odd_documents(spark, width, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 50)  # texts are taken up in many pieces
    docs = odd_documents(spark)
    target = spark.createDataFrame([(prose(random.Random(1), 40), 1), (None, 2), ("É Wort 9", 3)], "text string, gain long")
    own = [(r.doc_id, r.text) for r in docs.collect()]
    for percent in (0, 10, 50, 100):
        found = resampling.resample(docs, target, width=width, percent=percent, least_words=5, buckets=97)
        out = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
        assert out == plain_resampling(own, [r.text for r in target.collect()], 5, percent, width=width, buckets=97)
    assert resampling.resample(empty_documents(spark), target).count() == 0
    assert resampling.resample(docs, target.where("false")).count() == docs.count()


def test_resampling_splits_ties(spark):
    """A score that most rows share, and ids that many share: as many are drawn as are asked for, smaller ids first."""
    docs = spark.createDataFrame([(None, "a b c d e f")] * 300 + [(i, "a b c d e f") for i in range(50)], "doc_id long, text string")
    out = resampling.resample(docs, docs.limit(1), least_words=1, percent=40).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 141))
    rows = spark.range(4000).selectExpr("id % 7 AS score")
    for k in (1, 570, 572, 573, 2000, 4000):
        low, high, above = resampling.bracket(rows, k, 4000, slack=1e-9)
        values = sorted((i % 7 for i in range(4000)), reverse=True)
        assert low <= values[k - 1] <= high and above == sum(v > high for v in values)


def plain_removal(docs, window=13):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            m = least.get(tuple(w[i : i + window]))
            if m is not None and (d is None or m < d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), [i for i, g in enumerate(gone) if g]))
    return sorted(out, key=str)


def told(out):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, [i for s in r.spans for i in range(s["start"], s["end"])]) for r in out), key=str)


@pytest.mark.parametrize("window", [2, 5, 12, 13])
def test_substrings_against_a_plain_version(spark, window, monkeypatch):
    """Passages of every length round the window, at every offset, in texts of few words, over many small units."""
    monkeypatch.setattr(substrings, "UNIT", 3000)
    rng = random.Random(window)
    vocabulary = [prose(rng, 1) for _ in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in [window - 1, window, window + 1, 2 * window, 3 * window + 2, 60] for _ in range(3)]
    rows = []
    for i in range(160):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choice(passages)
        rows.append((rng.choice([i, i, i - 1, -i]) if i % 20 else None, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a " * 100), (504, "a " * 40), (3, rows[7][1]), (505, "É日本 " * 30), (506, "É日本\n" * 31)]
    docs = spark.createDataFrame([(i, t, 1, 2, "b") for i, t in rows], "doc_id long, text string, unit int, seq int, bucket string").repartition(3)
    out = substrings.remove_repeats(docs, window=window).collect()
    assert told(out) == plain_removal(rows, window) and sum(r.n_removed for r in out) > 500


def test_substrings_of_odd_tables(spark):
    docs = odd_documents(spark)
    assert told(substrings.remove_repeats(docs).collect()) == plain_removal([(r.doc_id, r.text) for r in docs.collect()])
    assert substrings.remove_repeats(empty_documents(spark)).count() == 0 and substrings.repeats(docs).count() >= 4
    hot = spark.createDataFrame([(i % 40, prose(random.Random(0), 50)) for i in range(400)], "doc_id long, text string")
    assert {(r.doc_id == 0, r.n_removed) for r in substrings.remove_repeats(hot).collect()} == {(True, 0), (False, 50)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op13(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept, _ in plain_removal(docs)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op13_substring_dedup(spark, SF).collect()} == expected
