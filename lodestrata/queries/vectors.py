"""Vector search. Query vectors are those whose id is divisible by 50, against all vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import parent_score
from ..operators import cells, fuse, keyword, vector
from ..storage import shared_folder
from .registry import Registry, table

query = Registry()
DIMENSION = 64
STEPS = (0.40, 0.32, 0.25)
#: Cells of the index, and those that a query looks at.
CELLS, CELLS_PROBED = 16, 12

SIMILARITIES = """
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, label AS parent, list_cosine_similarity(e, embedding::DOUBLE[]) AS sim FROM q, embeddings)
"""


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus = vector.of_dimension(table(spark, sf_dir, "embeddings"), "embedding", DIMENSION).select("vec_id", F.col("label").alias("parent"), F.col("embedding").alias("vector"))
    return corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), corpus


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


@query(f"""
    WITH {SIMILARITIES}
    SELECT query_id, vec_id, CAST(parent AS BIGINT) AS parent, round(sim, 6) AS similarity, CAST(n AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM s) WHERE n <= 20
""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.knn(*both(spark, sf_dir), k=20))


@query()
def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of coarse cells, of which a query looks at CELLS_PROBED of CELLS."""
    queries, corpus = both(spark, sf_dir)
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells.build(corpus, path, CELLS)
    return rounded(cells.search(queries, path, 20, CELLS_PROBED))


@query(f"""
    WITH {SIMILARITIES},
    o AS (SELECT * FROM s WHERE vec_id <> query_id),
    t AS (SELECT *, max(sim) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM o),
    u AS (SELECT *, CASE WHEN top >= 0.40 THEN 0.40 WHEN top >= 0.32 THEN 0.32 WHEN top >= 0.25 THEN 0.25 END AS step FROM t WHERE n <= 40)
    SELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(step AS DOUBLE) AS step FROM u WHERE sim >= step
""")
def knn_threshold_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.knn(*both(spark, sf_dir), k=41).where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    best = found.withColumn("n", F.row_number().over(w)).where("n <= 40")
    return rounded(vector.ladder(best, STEPS)).select("query_id", "vec_id", "similarity", "step")


@query(f"""
    WITH {SIMILARITIES}
    SELECT query_id, CAST(parent AS BIGINT) AS parent, vec_id, round(sim, 6) AS similarity, CAST(n AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY sim DESC, vec_id) AS n FROM s) WHERE n <= 3
""")
def knn_per_label_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.knn_by_parent(*both(spark, sf_dir), k=3))


@query(f"""
    WITH {SIMILARITIES},
    g AS (SELECT query_id, parent, max(sim) AS most, avg(sim) AS mean, count(*) AS n, arg_max(vec_id, (sim, -vec_id)) AS nearest FROM s GROUP BY ALL),
    r AS (SELECT *, 0.7 * most + 0.3 * mean AS score, row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * most + 0.3 * mean DESC, parent) AS k FROM g)
    SELECT query_id, CAST(parent AS BIGINT) AS parent, round(most, 6) AS most, round(mean, 6) AS mean, n, nearest, round(score, 6) AS score, CAST(k AS INTEGER) AS rank
    FROM r WHERE k <= 3
""")
def knn_group_max_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = vector.parent_statistics(*both(spark, sf_dir)).withColumn("score", parent_score(F.col("most"), F.col("mean")))
    top = fuse.top_per(grouped, ["query_id"], 3, F.desc("score"), F.col("parent"))
    return top.select("query_id", "parent", F.round("most", 6).alias("most"), F.round("mean", 6).alias("mean"), "n", "nearest", F.round("score", 6).alias("score"), "rank")


@query(f"""
    WITH {SIMILARITIES},
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY sim DESC, vec_id) AS n FROM s),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM b WHERE n = 1)
    SELECT query_id, CAST(parent AS BIGINT) AS parent, vec_id, round(sim, 6) AS similarity, CAST(k AS INTEGER) AS rank FROM t WHERE k <= 5
""")
def knn_distinct_on_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vector.knn_by_parent(*both(spark, sf_dir), k=1).drop("rank")
    return rounded(fuse.top_per(best, ["query_id"], 5, F.desc("similarity"), F.col("vec_id")))


@query(f"""
    WITH {SIMILARITIES},
    i AS (SELECT query_id, vec_id AS item_id, sim AS bar FROM s WHERE vec_id = query_id + 1)
    SELECT i.query_id, item_id, round(any_value(bar), 6) AS similarity, count(*) FILTER (WHERE sim > bar + 1e-12 AND s.vec_id <> item_id) + 1 AS rank
    FROM i JOIN s ON s.query_id = i.query_id GROUP BY i.query_id, item_id
""")
def knn_rank_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = both(spark, sf_dir)
    pairs = queries.select("query_id", (F.col("query_id") + 1).alias("item_id"))
    return rounded(vector.rank_of(pairs, queries, corpus))


@query(f"""
    WITH {SIMILARITIES},
    second AS (SELECT a.vec_id - 1 AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 1),
    p AS (SELECT query_id, vec_id, sim, 0 AS o FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM s) WHERE n <= 20),
    w AS (SELECT query_id, vec_id, sim, 1 AS o FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM second) WHERE n <= 20),
    m AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY sim DESC, o) AS n FROM (SELECT * FROM p UNION ALL SELECT * FROM w))
    SELECT query_id, vec_id, round(sim, 6) AS similarity FROM m WHERE n = 1
""")
def knn_merge_two_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = both(spark, sf_dir)
    second = corpus.where("vec_id % 50 = 1").select((F.col("vec_id") - 1).alias("query_id"), "vector")
    merged = vector.keep_best(vector.knn(queries, corpus, 20), vector.knn(second, corpus, 20), ["query_id", "vec_id"])
    return rounded(merged).select("query_id", "vec_id", "similarity")


@query(f"""
    WITH {SIMILARITIES}
    SELECT query_id, vec_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM s)
    WHERE n <= 6 AND sim >= 0.30 AND vec_id <> query_id
""")
def knn_fingerprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest few of each query, if near enough."""
    return rounded(vector.knn(*both(spark, sf_dir), k=6, least=0.30)).where("vec_id <> query_id").select("query_id", "vec_id", "similarity")


_QUERIES = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0)"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = vector.of_dimension(table(spark, sf_dir, "embeddings"), "embedding", DIMENSION).select("vec_id", "label", F.col("embedding").alias("vector"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), e


@query(f"""
    WITH {_QUERIES},
    c AS (SELECT vec_id, o_orderkey, o_orderdate, o_orderstatus, embedding::DOUBLE[] AS v FROM embeddings JOIN orders ON o_orderkey = vec_id WHERE year(o_orderdate) BETWEEN 1995 AND 1997 AND o_orderstatus = 'F'),
    s AS (SELECT query_id, c.*, list_cosine_similarity(e, v) AS sim FROM q, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM s WHERE sim >= 0.15)
    SELECT query_id, vec_id, strftime(o_orderdate, '%Y-%m-%d') AS dated, round(sim, 6) AS similarity, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 20
""")
def knn_filtered_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows among those whose parent has a year and a type: joined and filtered before the search."""
    asked, e = _asked(spark, sf_dir)
    parents = table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1995, 1997) & (F.col("o_orderstatus") == "F")).select(F.col("o_orderkey").alias("vec_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dated"))
    fitting = e.join(parents, "vec_id")
    found = vector.knn(asked, fitting.select("vec_id", F.col("vec_id").alias("parent"), "vector"), 20, least=0.15)
    return rounded(found.join(parents, "vec_id")).select("query_id", "vec_id", "dated", "similarity", "rank")


@query(f"""
    WITH {_QUERIES},
    f AS (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey)) AS mode FROM lineitem GROUP BY l_orderkey),
    s AS (SELECT query_id, vec_id, o_orderpriority, mode, list_cosine_similarity(e, embedding::DOUBLE[]) AS sim FROM q, embeddings JOIN orders ON o_orderkey = vec_id LEFT JOIN f ON l_orderkey = vec_id WHERE embedding IS NOT NULL AND o_orderstatus = 'O'),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM s WHERE sim >= 0.10)
    SELECT query_id, vec_id, o_orderpriority, mode, round(sim, 6) AS similarity FROM r WHERE n <= 10
""")
def knn_with_first_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest parents of a type, each with its first child."""
    asked, e = _asked(spark, sf_dir)
    parents = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("vec_id"), "o_orderpriority")
    found = vector.knn(asked, e.where("vector is not null").join(parents, "vec_id").select("vec_id", F.col("vec_id").alias("parent"), "vector"), 10, least=0.10)
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("vec_id")).agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey")).alias("mode"))
    return rounded(found.join(parents, "vec_id").join(first, "vec_id", "left")).select("query_id", "vec_id", "o_orderpriority", "mode", "similarity")


_RANKED = f"""
    {_QUERIES},
    c AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, coalesce(p_size, 5) AS level, CASE WHEN contains(lower(coalesce(p_name, '')), 'red') THEN 0.35 WHEN contains(lower(coalesce(p_name, '')), 'ring') THEN 1.08 ELSE 1.0 END::DOUBLE AS quality
          FROM embeddings LEFT JOIN part ON p_partkey = vec_id WHERE embedding IS NOT NULL AND (p_size IS NULL OR p_size <= 45) AND (p_retailprice IS NULL OR p_retailprice >= 905) AND (p_brand IS NULL OR p_brand NOT LIKE 'Brand#5%')),
    s AS (SELECT query_id, c.*, list_cosine_similarity(e, v) AS sim FROM q, c WHERE vec_id <> query_id),
    t AS (SELECT *, sim * quality AS ranking, max(sim) OVER (PARTITION BY query_id) AS top FROM s),
    u AS (SELECT *, CASE WHEN top >= 0.40 THEN 0.40 WHEN top >= 0.32 THEN 0.32 WHEN top >= 0.25 THEN 0.25 END AS step FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ranking DESC, vec_id) AS n FROM u WHERE sim >= step)
"""


def _ladder_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, vec_id, label, level, similarity, ranking): the first step of the ladder with rows that are valid and
    of the wanted domain, by similarity times the title's quality, 40 of a query. Rows without a parent stay. As quality
    has three values, the best 40 of each value hold the best 40 of all."""
    asked, e = _asked(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_name", "p_size", "p_retailprice", "p_brand")
    valid = (F.col("p_size").isNull() | (F.col("p_size") <= 45)) & (F.col("p_retailprice").isNull() | (F.col("p_retailprice") >= 905)) & (F.col("p_brand").isNull() | ~F.col("p_brand").startswith("Brand#5"))
    quality = keyword.title_quality(F.coalesce("p_name", F.lit("")), "ring", "red")
    rows = e.where("vector is not null").join(p, "vec_id", "left").where(valid).select("vec_id", "label", "vector", F.coalesce("p_size", F.lit(5)).alias("level"), quality.alias("quality"))
    near = vector.knn_by_parent(asked, rows.select("vec_id", (F.col("quality") * 100).cast("long").alias("parent"), "vector"), 41).where("vec_id <> query_id").drop("rank")
    fitting = vector.ladder(near, STEPS).join(rows.drop("vector"), "vec_id").withColumn("ranking", F.col("similarity") * F.col("quality"))
    return fuse.top_per(fitting, ["query_id"], 40, F.desc("ranking"), F.col("vec_id"))


@query(f"WITH {_RANKED} SELECT query_id, vec_id, level, round(sim, 6) AS similarity, round(ranking, 6) AS ranking FROM r WHERE n <= 40")
def knn_ladder_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ladder_ranked(spark, sf_dir).select("query_id", "vec_id", "level", F.round("similarity", 6).alias("similarity"), F.round("ranking", 6).alias("ranking"))


@query(f"""
    WITH {_RANKED},
    d AS (SELECT query_id, label, sim, ranking, vec_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY query_id, label ORDER BY ranking DESC, vec_id) AS k FROM r LEFT JOIN documents ON doc_id = vec_id WHERE n <= 40),
    g AS (SELECT query_id, label, max(sim) AS most, max(ranking) AS best, count(*) AS n, substring(string_agg(text, chr(10) ORDER BY k) FILTER (WHERE k <= 3), 1, 1500) AS excerpt FROM d GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, label) AS k FROM g)
    SELECT query_id, label, round(most, 6) AS most, round(best, 6) AS best, n, md5(excerpt) AS excerpt_md5 FROM o WHERE k <= 3
""")
def knn_grouped_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked chunks by parent: best similarity and rank score, and the first three chunks' text."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = _ladder_ranked(spark, sf_dir).join(texts, "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    grouped = fuse.group_chunks(rows, ["query_id", "label"], "ranking", "vec_id", "text", most_of="similarity")
    top = fuse.top_per(grouped, ["query_id"], 3, F.desc("most"), F.col("label"))
    return top.select("query_id", "label", F.round("also", 6).alias("most"), F.round("most", 6).alias("best"), "n", F.md5("excerpt").alias("excerpt_md5"))


QUERIES, ORACLE_SQL = query.queries, query.sql
