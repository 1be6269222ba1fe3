"""The queries of this folder's operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, language, mixing, pieces, resampling, secrets, substrings, suffix_tree, toxicity, whitening
from .common import cut, fold, table
from .exact_dedup import exact_dedup
from .near_dedup import near_dedup


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _only(k: int):
    return lambda rank: F.when(rank == k, rank)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.train_weakly(docs))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [F.size(F.array_compact(F.transform(ranks, _only(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = suffix_tree.train(docs.where(fold("doc_id", 7) != 2))
    found = suffix_tree.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares for all domains but the rarest in the labels, which is mixed out; the total stays as it is."""
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs)
    rarest = min(range(len(model["rows"])), key=lambda i: model["rows"][i], default=None)
    return mixing.mix(docs, model, [float(i != rarest) for i in range(len(model["rows"]))], least=0.0)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_sentences", F.size("offending").alias("n_offending"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs.where(fold("doc_id", 3) != 1)))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(fingerprint.fingerprints_of_edits(table(spark, sf_dir, "documents")), "prints")
    found = fingerprint.count_within(prints, F.col("doc_id") % 50 == 0)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", _hex("fp").alias("fingerprint"), _hex("edited_fp").alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fingerprint.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within",
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    told = cut(chat.turns(table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)), "turns")
    return chat.read_back(told, cut(chat.prefix_tree(told), "tree"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_checked(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f for f in (
        op1_secret_scan, op2_lm_scoring, op3_source_mixing, op6_toxicity, op7_language_id, op4_simhash_near_dedup, op5_exact_dedup, op8_chat_formatting,
        op9_sentencepiece, op10_document_fingerprints, op11_embedding_whitening, op12_importance_resampling, op13_substring_dedup,
    )
}

ORACLE_SQL = {
    "op8_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (
            SELECT *, length('<|turn|>' || regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|text|>'
                || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|end|>') AS n
            FROM t),
        g AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM f)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(sum(position) AS BIGINT) AS position_sum
        FROM g GROUP BY conv_id
    """,
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept,
               text_sha256
        FROM t
        WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
    """,
}
