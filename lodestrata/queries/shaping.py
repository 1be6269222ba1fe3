"""Record shaping, blended orders, classification and gold sets over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shaping, text
from ..operators import evaluate, fuse, keyword, vector
from .registry import Registry, table
from .texts import words_sql
from .vectors import SIMILARITIES, both

query = Registry()


@query(f"""
    WITH {SIMILARITIES},
    r AS (SELECT *, 0.7::DOUBLE * sim + 0.3::DOUBLE / (parent + 1) AS blend FROM s WHERE sim >= 0.05),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, vec_id) AS n FROM r)
    SELECT query_id, vec_id, CAST(parent AS BIGINT) AS parent, round(blend, 6) AS blend, CAST(n AS INTEGER) AS rank FROM k WHERE n <= 5
""")
def blended_semantic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity blended with the parent's level. Within a parent the order is by similarity, so its best five suffice."""
    found = vector.knn_by_parent(*both(spark, sf_dir), k=5).where("similarity >= 0.05").drop("rank")
    blend = 0.7 * F.col("similarity") + F.lit(0.3) / (F.col("parent") + 1)
    top = fuse.top_per(found.withColumn("blend", blend), ["query_id"], 5, F.desc("blend"), F.col("vec_id"))
    return top.select("query_id", "vec_id", "parent", F.round("blend", 6).alias("blend"), "rank")


EXPANSIONS = [("the", ["this", "that"]), ("of", ["from", "out"]), ("que", ["qui", "quoi"])]
_NONE = "CAST([] AS VARCHAR[])"
_EXTRA = " || ".join(f"CASE WHEN contains(lower(text), '{p}') THEN {t} ELSE {_NONE} END" for p, t in EXPANSIONS)


@query(f"""
    WITH w AS (SELECT item_id, {words_sql("text")} || {_EXTRA} AS w FROM benchmark)
    SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:24], ' ') AS expanded FROM w
""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(shaping.expanded(F.col("text"), EXPANSIONS), " ").alias("expanded"))


@query("""
    SELECT event_id, CAST(CASE WHEN event_id % 4 < 3 THEN json_extract(props, '$.k') ELSE '-1' END AS INTEGER) AS k FROM events
""")
def loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects bare, fenced and with words around them; those without the key are dropped to null."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" Done."))).otherwise(F.regexp_replace("props", '"k"', '"x"'))
    return e.select("event_id", F.coalesce(shaping.loose_json(said, "k int", "k")["k"], F.lit(-1)).alias("k"))


@query("""
    WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS stated, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus <> 'F') AS found, max(o_orderstatus) AS s FROM orders GROUP BY o_custkey)
    SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(stated, []), coalesce(found, [])[1:2]))), ',') AS articles, CASE s WHEN 'P' THEN 'partial' ELSE 'unclear' END AS outcome FROM g
""")
def card_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("o_orderstatus") == "F"
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.when(f, F.col("o_orderpriority")))).alias("stated"), F.array_sort(F.collect_set(F.when(~f, F.col("o_orderpriority")))).alias("found"), F.max("o_orderstatus").alias("s"))
    card = shaping.normal_card(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("stated"), F.col("found"), F.when(F.col("s") == "P", "Partial").otherwise("other"), articles=2)
    return g.select("o_custkey", card.alias("c")).select("o_custkey", F.array_join(F.array_sort("c.articles"), ",").alias("articles"), "c.outcome")


@query(f"""
    WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS title FROM conversations)
    SELECT conv_id, turn, len(list_filter(list_filter({words_sql("title")}, lambda w: length(w) >= 4), lambda w: contains(lower(text), w))) > 0 OR contains(lower(text), 'token') AS addressed FROM t WHERE role = 'assistant'
""")
def issue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer takes up the message before it."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").withColumn("title", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    return t.select("conv_id", "turn", shaping.issue_addressed(F.col("text"), F.col("title"), F.array(F.lit("token"))).alias("addressed"))


@query("""
    SELECT CASE WHEN contains(lower(text), 'copyright') THEN 'owned' WHEN contains(lower(text), 'licens') THEN 'licensed' WHEN contains(lower(text), '@') THEN 'personal' ELSE 'open' END AS domain,
           CASE WHEN contains(lower(text), 'copyright') THEN 1 WHEN contains(lower(text), 'licens') THEN 2 WHEN contains(lower(text), '@') THEN 5 ELSE 7 END AS level, count(*) AS n FROM documents GROUP BY 1, 2
""")
def classification_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and level by the first rule that fits."""
    rules = [("owned", ["copyright"]), ("licensed", ["licens"]), ("personal", ["@"])]
    domain = text.first_signal(F.col("text"), rules, "open")
    level = F.when(F.col("domain") == "owned", 1).when(F.col("domain") == "licensed", 2).when(F.col("domain") == "personal", 5).otherwise(7)
    return table(spark, sf_dir, "documents").select(domain.alias("domain")).groupBy("domain").agg(F.count("*").alias("n")).select("domain", level.alias("level"), "n")


@query("""
    WITH r AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY (p_size > 25) DESC, p_partkey DESC, p_retailprice DESC NULLS LAST) AS n FROM part)
    SELECT p_partkey, p_name, n = 1 AS is_active FROM r
""")
def canonical_status_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active is exactly the winner of each name."""
    from ..operators.windows import current_version

    ranked = current_version(table(spark, sf_dir, "part"), "p_name", F.col("p_size") > 25, F.col("p_partkey"), F.col("p_retailprice"))
    return ranked.select("p_partkey", "p_name", F.col("is_current").alias("is_active"))


@query("""
    WITH c AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 0), i AS (SELECT doc_id, md5(text) AS h FROM documents)
    SELECT count(*) FILTER (WHERE c.h IS NOT NULL) AS hits, count(*) FILTER (WHERE c.h IS NULL) AS misses, count(DISTINCT CASE WHEN c.h IS NULL THEN i.h END) AS calls FROM i LEFT JOIN c USING (h)
""")
def embed_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts have a stored vector, and how many distinct ones need a call."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    cached = d.where("doc_id % 2 = 0").select("h").distinct().withColumn("hit", F.lit(True))
    return d.join(cached, "h", "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"), F.countDistinct(F.when(F.col("hit").isNull(), F.col("h"))).alias("calls"))


@query(f"""
    WITH {SIMILARITIES},
    smp AS (SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS n FROM embeddings WHERE vec_id % 50 = 0) WHERE n <= 2),
    r AS (SELECT query_id, vec_id, parent, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM s WHERE vec_id <> query_id)
    SELECT smp.vec_id AS query_id, CAST(smp.label AS BIGINT) AS label, CAST(min(n) AS INTEGER) AS best_rank FROM smp JOIN r ON query_id = smp.vec_id AND parent = smp.label WHERE n <= 30 GROUP BY 1, 2
""")
def gold_set_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled queries of each label that find their label among the first thirty."""
    queries, corpus = both(spark, sf_dir)
    sampled = evaluate.stratified(corpus.where("vec_id % 50 = 0").select(F.col("parent").alias("label"), "vec_id"), "label", "vec_id", 2).select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("label"))
    found = vector.knn(queries.join(sampled, "query_id", "left_semi"), corpus, 31).where("vec_id <> query_id")
    place = F.row_number().over(_by_similarity())
    ranked = found.withColumn("n", place).where("n <= 30")
    return sampled.join(ranked.withColumnRenamed("parent", "label"), ["query_id", "label"]).groupBy("query_id", "label").agg(F.min("n").alias("best_rank"))


def _by_similarity():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")


@query("""
    SELECT o_custkey, count(*) AS n, md5(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS projected FROM orders GROUP BY o_custkey
""")
def citation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of wide structs cut down to two fields."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"))).alias("items"))
    small = shaping.project(F.col("items"), "o_orderkey", "o_orderstatus")
    return g.select("o_custkey", "n", F.md5(F.array_join(F.transform(small, lambda s: F.concat_ws(":", s["o_orderkey"].cast("string"), s["o_orderstatus"])), ",")).alias("projected"))


LIMITS = {"at most": "<=", "more than": ">", "less than": "<", "at least": ">="}


@query("""
    WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '<=' WHEN 1 THEN '>' WHEN 2 THEN '<' ELSE '>=' END AS op, o_orderkey % 3 AS r, CASE WHEN o_orderkey % 5 = 0 THEN 60 ELSE 50 END AS n FROM orders)
    SELECT op, count(*) AS n_statements, count(*) FILTER (WHERE op <> '<=' OR n <> 50) AS n_contradictions FROM s GROUP BY op
""")
def contradiction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a limit against the rule that it is at most fifty."""
    k = F.col("o_orderkey")
    word = F.when(k % 4 == 0, "at most").when(k % 4 == 1, "more than").when(k % 4 == 2, "less than").otherwise("at least")
    said = F.concat(F.lit("The term is "), word, F.lit(" "), F.when(k % 5 == 0, "60").otherwise("50"), F.lit(" days."))
    op, number = shaping.stated_limit(said, LIMITS)
    return table(spark, sf_dir, "orders").select(op.alias("op"), number.alias("v")).groupBy("op").agg(F.count("*").alias("n_statements"), F.count_if((F.col("op") != "<=") | (F.col("v") != 50)).alias("n_contradictions"))


@query("""
    WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), g AS (SELECT * FROM (VALUES ('license', 'licence', 3), ('license', 'licensed', 2), ('token', 'key', 1)) AS g(canonical, synonym, n))
    SELECT canonical, max(n) AS count, count(DISTINCT doc_id) AS n_docs FROM t JOIN g ON contains(t, synonym) GROUP BY canonical
""")
def glossary_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a small glossary that occur, by their canonical form."""
    g = spark.createDataFrame([("license", "licence", 3), ("license", "licensed", 2), ("token", "key", 1)], "canonical string, synonym string, n int")
    hits = keyword.terms_in(g, table(spark, sf_dir, "documents").select("doc_id", "text"), "synonym", "text")
    return hits.groupBy("canonical").agg(F.max("n").alias("count"), F.countDistinct("doc_id").alias("n_docs"))


QUERIES, ORACLE_SQL = query.queries, query.sql
