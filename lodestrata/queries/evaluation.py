"""Hybrid retrieval and its evaluation: benchmark items are the queries, the documents that hold them the gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate, keyword
from ..plans.retrieval import RetrievalPlan, hybrid
from .registry import Registry, table
from .texts import STOP, tokens_sql, words_sql

query = Registry()
PLAN = RetrievalPlan(k=5, candidates=30, least_share=0.3)

HYBRID = f"""
    b0 AS (SELECT item_id AS query_id, text AS query_text, list_filter({words_sql("text")}, lambda w: length(w) >= 4 AND w NOT IN ({STOP})) AS w FROM benchmark),
    b AS (SELECT query_id, query_text, list_filter(w, lambda x, i: list_position(w, x) = i) AS qt FROM b0),
    q AS (SELECT query_id, unnest(qt) AS token, len(qt) AS query_n FROM b),
    dt AS (SELECT doc_id, text, {tokens_sql("text")} AS t FROM documents),
    d AS (SELECT doc_id, unnest(t) AS token, len(t) AS doc_n FROM dt),
    p AS (SELECT query_id, doc_id, count(*) AS shared, max(query_n) AS query_n, max(doc_n) AS doc_n FROM q JOIN d USING (token) GROUP BY ALL),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared / query_n DESC, doc_n, doc_id) AS place FROM p WHERE shared >= 0.3::DOUBLE * query_n) WHERE place <= 30),
    x AS (SELECT query_id, doc_id, shared, query_text, text, qt, t, qt[1:35] AS q35, {words_sql("query_text")} AS qw, {words_sql("text")} AS dw FROM pool JOIN b USING (query_id) JOIN dt USING (doc_id)),
    i AS (SELECT query_id, doc_id, list_distinct(list_filter(qw, lambda w: length(w) >= 4)) AS e, list_distinct(list_filter(dw, lambda w: length(w) >= 4)) AS c FROM x),
    same AS (SELECT query_id, doc_id, len(e) >= 4 AND len(c) >= 4 AND len(list_filter(e, lambda v: list_contains(c, v))) / len(e) >= 0.92 AS covered FROM i),
    y AS (SELECT *, CAST(len(list_filter(q35, lambda v: list_contains(t, v))) AS DOUBLE) AS s FROM x),
    z AS (SELECT query_id, doc_id, shared, round(CASE WHEN s > 0 THEN least(1.0::DOUBLE, 0.55::DOUBLE * s / len(q35) + 0.35::DOUBLE * s / len(t) + 0.10::DOUBLE * s / (len(q35) + len(t) - s)) ELSE 0.0 END, 6) AS similarity,
        CASE WHEN contains(text, query_text) THEN 'direct' WHEN len(qw) > 0 AND len(dw) > 0 AND (qw = dw OR covered) THEN 'equivalent' ELSE 'partial' END AS match FROM y JOIN same USING (query_id, doc_id)),
    top AS (SELECT query_id, doc_id, shared, CAST(similarity AS DOUBLE) AS similarity, match, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (match = 'direct') DESC, similarity DESC, doc_id) AS INTEGER) AS rank FROM z)
"""


def retrieved(spark: SparkSession, sf_dir: str, plan: RetrievalPlan = PLAN) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return hybrid(items, table(spark, sf_dir, "documents").select("doc_id", "text"), plan)


@query(f"WITH {HYBRID} SELECT * FROM top WHERE rank <= 5")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: candidates, fusion and scores for every benchmark item over all documents."""
    return retrieved(spark, sf_dir)


@query("""
    SELECT item_id, count(doc_id) AS n_documents, coalesce(min(doc_id), -1) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id
""")
def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an item word for word."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    found = keyword.passages_in(b, table(spark, sf_dir, "documents").select("doc_id", "text"), "item", "text").groupBy("item_id").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))
    return b.join(found, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("first_doc", F.lit(-1)).alias("first_doc"))


@query(f"""
    WITH {HYBRID},
    gold AS (SELECT DISTINCT item_id AS query_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    r AS (SELECT gold.query_id, min(rank) AS rank FROM gold LEFT JOIN top ON top.query_id = gold.query_id AND rank <= 10 AND match = 'direct' GROUP BY 1)
    SELECT count(*) AS n, avg(coalesce(rank <= 1, false)::INTEGER) AS p_at_1, avg(coalesce(rank <= 3, false)::INTEGER) AS p_at_3, avg(coalesce(rank <= 5, false)::INTEGER) AS p_at_5,
        round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 9)::DOUBLE AS mrr_at_10 FROM r
""")
def precision_at_k_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P@1, P@3, P@5 and MRR@10 of hybrid retrieval, for items that some document holds."""
    gold = gold_documents(spark, sf_dir).where("n_documents > 0").select(F.col("item_id").alias("query_id"))
    hits = retrieved(spark, sf_dir, RetrievalPlan(k=10)).where("match = 'direct'").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return evaluate.retrieval_metrics(gold.join(hits, "query_id", "left")).withColumn("mrr_at_10", F.round("mrr_at_10", 9))


@query("""
    WITH q AS (SELECT vec_id AS query_id, label AS own, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, own, label, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(e, embedding::DOUBLE[]) DESC, vec_id) AS n FROM q JOIN embeddings ON vec_id <> query_id),
    r AS (SELECT query_id, min(n) FILTER (WHERE own = label) AS rank FROM s GROUP BY query_id)
    SELECT count(*) AS n, avg(coalesce(rank <= 1, false)::INTEGER) AS p_at_1, avg(coalesce(rank <= 3, false)::INTEGER) AS p_at_3, avg(coalesce(rank <= 5, false)::INTEGER) AS p_at_5,
        round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 9)::DOUBLE AS mrr_at_10 FROM r
""")
def label_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well nearest neighbours find the query's own label."""
    from ..operators import vector
    from .vectors import both

    queries, corpus = both(spark, sf_dir)
    own = corpus.select(F.col("vec_id").alias("query_id"), F.col("parent").alias("own")).where("query_id % 50 = 0")
    found = vector.knn(queries, corpus, 11).where("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")))
    ranks = own.join(ranked.select("query_id", "parent", "rank"), "query_id", "left").groupBy("query_id").agg(F.min(F.when(F.col("own") == F.col("parent"), F.col("rank"))).alias("rank"))
    return evaluate.retrieval_metrics(ranks).withColumn("mrr_at_10", F.round("mrr_at_10", 9))


@query("""
    WITH e AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS expected FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), a AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS actual FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey),
    m AS (SELECT id, len(list_filter(expected, lambda x: list_contains(coalesce(actual, []), x))) AS matched, len(expected) AS total, list_contains(coalesce(actual, []), '5-LOW') AS forbidden FROM e LEFT JOIN a USING (id))
    SELECT count(*) AS n, sum(matched)::BIGINT AS matched, sum(total)::BIGINT AS total, round(sum(matched) / sum(total), 6) AS rate, count(*) FILTER (WHERE matched = total AND NOT forbidden) AS passed, count(*) FILTER (WHERE forbidden) AS forbidden FROM m
""")
def scenario_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected keys against actual ones for each scenario, forbidden keys, and the summary."""
    o = table(spark, sf_dir, "orders")
    e = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("expected"))
    a = o.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("actual"))
    both = e.join(a, "o_custkey", "left")
    hit, total = evaluate.matched(F.col("expected"), F.col("actual"))
    forbidden = F.coalesce(F.array_contains("actual", "5-LOW"), F.lit(False))
    m = both.select(hit.alias("matched"), total.alias("total"), forbidden.alias("forbidden"))
    passed = evaluate.scenario_passes(F.col("matched") == F.col("total"), F.col("forbidden").cast("int"))
    return m.agg(F.count("*").alias("n"), F.sum("matched").alias("matched"), F.sum("total").alias("total"), F.round(F.try_divide(F.sum("matched"), F.sum("total")), 6).alias("rate"), F.count_if(passed).alias("passed"), F.count_if("forbidden").alias("forbidden"))


@query("""
    WITH v AS (SELECT doc_id, quality * 5 + 3 AS score, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 1 THEN 'warn' ELSE 'fail' END AS verdict, toxic = 0 AS clean FROM labels),
    s AS (SELECT *, 50 * (score / 10.0) + CASE verdict WHEN 'pass' THEN 30 WHEN 'warn' THEN 15 ELSE 0 END + CASE WHEN clean THEN 10 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 0 END AS total FROM v)
    SELECT CASE WHEN verdict = 'fail' THEN 'fail' WHEN total >= 85 THEN 'pass' WHEN total >= 65 THEN 'warn' ELSE 'fail' END AS status, count(*) AS n, sum(CAST(total * 10 AS BIGINT))::BIGINT AS tenths FROM s GROUP BY 1
""")
def answer_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer scores from retrieval, verdict, flags and reference; statuses and their counts."""
    from ..functions import scores

    q, t = F.col("quality"), F.col("toxic")
    verdict = F.when((q == 1) & (t == 0), "pass").when(q == 1, "warn").otherwise("fail")
    rows = table(spark, sf_dir, "labels").select(verdict.alias("verdict"), scores.answer_score((q * 5 + 3) / 10.0, verdict, t == 0, F.col("doc_id") % 2 == 0).alias("total"))
    return rows.groupBy(scores.answer_status(F.col("total"), F.col("verdict")).alias("status")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("total") * 10).cast("long")).alias("tenths"))


QUERIES, ORACLE_SQL = query.queries, query.sql
