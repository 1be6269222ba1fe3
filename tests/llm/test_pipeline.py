import os
import re

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from lodestrata.llm import language, mixing, pieces, queries

from .test_dedup import brute_groups

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_against_plain_versions(spark):
    """Each stage on what the one before it kept: the rows that a plain version of its rule keeps."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    stages = dict(corpus_pipeline.STAGES)
    first = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in first.collect()}

    def after(name, docs):
        out = stages[name](spark, docs, SF)
        found = out.collect()
        assert out.columns == docs.columns and all(tuple(r) == tuple(rows[r.doc_id]) for r in found)
        return spark.createDataFrame(found, docs.schema), [r.doc_id for r in found]

    docs, kept = after("language_id", first)
    lang, score = language.predict_batch([rows[d].text for d in rows], language.train(first))
    assert sorted(kept) == sorted(d for d, v, s in zip(rows, lang, score, strict=True) if v != "und" and s >= corpus_pipeline.LEAST_SURE)

    texts: dict = {}
    for d in kept:
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", rows[d].text), []).append((-len(rows[d].text), d))
    docs, kept = after("exact_dedup", docs)
    assert sorted(kept) == sorted(min(own)[1] for own in texts.values()) and len(kept) < sum(map(len, texts.values()))

    groups = brute_groups({d: rows[d].text for d in kept})
    docs, kept = after("near_dedup", docs), kept
    docs, kept = docs[0], sorted(d for d in kept if d not in groups)
    assert sorted(r.doc_id for r in docs.collect()) == kept and groups

    mixed, copies = after("mixing", docs)
    assert sorted(set(copies)) == kept and len(copies) > len(kept)
    told = mixing.mix(docs, mixing.train(docs)).collect()
    assert sorted(copies) == sorted(r.doc_id for r in told for _ in range(r.copies))
    present = sum(np.array(r.posterior) * r.n_tokens for r in told)
    reached = sum(np.array(r.posterior) * r.n_tokens * r.rate for r in told)
    assert np.allclose(reached / reached.sum(), np.sqrt(present) / np.sqrt(present).sum(), atol=0.01)

    out = stages["sentencepiece"](spark, mixed, SF)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert out.columns == [*first.columns, "ids"] and all(list(r.ids) == model.encode(rows[r.doc_id].text) for r in out.collect()) and out.count() == len(copies)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_the_smallest_tables(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = {"op8": "conversations", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    assert df.count() == (rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count() * (16 if table == "embeddings" else 1))
