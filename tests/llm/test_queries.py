"""The queries over the smallest tables against plain versions."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from lodestrata.llm import pieces, queries
from lodestrata.llm.fingerprint import edited, weighted_simhash

from .test_dedup import brute_fingerprint, groups, words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def found(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_op1(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rows = found(spark, "op1_secret_scan")
    assert len(rows) == len(docs)
    for d, r in rows.items():
        t = docs[d].text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]


def test_op2(spark, docs):
    tokens = {d: [*words(r.text), "\n"] for d, r in docs.items()}
    c = Counter(t for d, own in tokens.items() if crc(d, 7) != 2 for t in own)
    n, v = sum(c.values()), len(c)
    rows = found(spark, "op2_lm_scoring")
    for d, own in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(d, 7) == 2, len(own), sum(c[t] > 0 for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9) and r.score < 0


def test_op4(spark, docs):
    fp = {d: brute_fingerprint(r.text) for d, r in docs.items()}
    expected = groups([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], fp)
    assert {d: (r.fingerprint, r.component_id) for d, r in found(spark, "op4_simhash_near_dedup").items()} == {d: (f"{fp[d]:016x}", expected[d]) for d in fp}


def test_op6_and_op7_on_held_out_rows(spark, docs):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = found(spark, "op6_toxicity")
    assert all(r.held_out == (crc(d, 4) == 2) and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    mean = lambda y: np.mean([r.score for d, r in rows.items() if toxic.get(d) == y])
    assert mean(1) > mean(0) + 0.3
    rows = found(spark, "op7_language_id")
    assert all(r.held_out == (crc(d, 3) == 1) for d, r in rows.items())
    assert np.mean([r.lang_pred == docs[d].lang for d, r in rows.items() if r.held_out]) > 0.95


def test_op9(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = found(spark, "op9_sentencepiece")
    assert all(list(rows[d].ids) == model.encode(r.text or "") and rows[d].round_trip for d, r in docs.items())


def test_op10(spark, docs):
    order = sorted(docs, reverse=True)
    texts = [docs[d].text or "" for d in order]
    later = [*texts[1:], texts[0]]
    fp, changed = weighted_simhash(texts), weighted_simhash([edited(t, f) for t, f in zip(texts, later, strict=True)])
    rows = found(spark, "op10_document_fingerprints")
    for i, d in enumerate(order):
        r = rows[d]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(texts[i]), f"{fp[i]:016x}", f"{changed[i]:016x}")
        assert r.near_next == 1 - int(np.bitwise_count(fp[i] ^ fp[(i + 1) % len(fp)])) / 64 and r.edited_sha256 == hashlib.sha256(edited(texts[i], later[i]).encode()).hexdigest()
        assert r.n_within == (int((np.bitwise_count(fp ^ fp[i]) <= 3).sum()) if d % 50 == 0 else None)
