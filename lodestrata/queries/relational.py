"""Filters, joins, sequences and JSON over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fuse, keyword, windows
from ..sources import readers
from .registry import Registry, table

query = Registry()


@query("""
    WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate) END AS y_from, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(o_orderdate) + 2 END AS y_to FROM orders)
    SELECT o_orderkey FROM v WHERE (y_from IS NULL OR y_from <= 1998) AND (y_to IS NULL OR y_to >= 1998)
""")
def temporal_validity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of years with open ends that hold a year."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.year("o_orderdate")).alias("y_from"), F.when(F.col("o_orderkey") % 4 != 0, F.year("o_orderdate") + 2).alias("y_to"))
    return rows.where((F.col("y_from").isNull() | (F.col("y_from") <= 1998)) & (F.col("y_to").isNull() | (F.col("y_to") >= 1998))).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1999 AND o_orderstatus IN ('F', 'O')")
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year as a range of dates, which reaches the scan."""
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where((day >= F.lit("1999-01-01").cast("timestamp")) & (day < F.lit("2000-01-01").cast("timestamp")) & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_totalprice")


@query("""
    WITH h AS (SELECT p_partkey, p_brand, lower(trim(p_type)) IN ('eco', 'economy brass', 'promo tin') OR p_size >= 48 AS hit FROM part)
    SELECT p_partkey, p_brand FROM (SELECT *, bool_or(coalesce(hit, false)) OVER (PARTITION BY p_brand) AS any_hit FROM h) WHERE coalesce(hit, false) OR NOT any_hit
""")
def domain_filter_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand a filter by domain, which is lifted where nothing passes it."""
    p = table(spark, sf_dir, "part")
    hit = F.coalesce(F.lower(F.btrim("p_type")).isin("eco", "economy brass", "promo tin") | (F.col("p_size") >= 48), F.lit(False))
    return fuse.with_fallback(p.where(hit).select("p_partkey", "p_brand"), p.select("p_partkey", "p_brand"), ["p_brand"])


@query("""
    SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_total, count(*) FILTER (WHERE length(json_extract_string(props, '$.k')) > 1) AS n_long FROM events GROUP BY event_type
""")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = readers.field(e, "props", "k")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("k_total"), F.count_if(F.length(k) > 1).alias("n_long"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(large, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows still to be processed; safe for null keys."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
    SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders JOIN
        (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS LAST, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) ON l_orderkey = o_orderkey WHERE n = 1
""")
def lateral_first_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parent's first child, as one aggregation of the children."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("c"))
    return table(spark, sf_dir, "orders").join(first, "o_orderkey").select("o_orderkey", "o_orderstatus", "c.l_linenumber", "c.l_partkey")


@query("""
    SELECT n_name, r_name, count(*) AS n_orders, count(s_suppkey) AS n_with_supplier FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 200 GROUP BY n_name, r_name
""")
def star_left_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact with required and optional dimensions."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 200).alias("s_suppkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(1).alias("has_supplier"))
    joined = readers.star(o, [(c, "c_custkey"), (n, "n_nationkey")], [(table(spark, sf_dir, "region"), "r_regionkey"), (s, "s_suppkey")])
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("n_orders"), F.count("has_supplier").alias("n_with_supplier"))


@query("""
    WITH r AS (SELECT doc_id % 100 AS message_id, doc_id, quality, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id DESC) AS n FROM labels)
    SELECT conv_id, turn, doc_id AS review_id, quality FROM conversations LEFT JOIN r ON message_id = conv_id AND n = 1
""")
def latest_review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their latest review, if any."""
    r = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 100).alias("conv_id")).agg(F.max(F.struct("doc_id", "quality")).alias("r"))
    return table(spark, sf_dir, "conversations").join(r, "conv_id", "left").select("conv_id", "turn", F.col("r.doc_id").alias("review_id"), F.col("r.quality").alias("quality"))


@query("""
    WITH g AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b, list(DISTINCT l_linenumber) AS i FROM lineitem GROUP BY l_orderkey),
    m AS (SELECT *, list_filter(range(a, b + 1), lambda x: NOT list_contains(i, x)) AS missing FROM g)
    SELECT l_orderkey, a AS starts_at, b AS ends_at, CAST(len(missing) AS INTEGER) AS n_missing, array_to_string(list_sort(missing), ',') AS missing FROM m
""")
def chunk_gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
    WITH s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY source),
    c AS (SELECT *, least(n, 60 - 2 * k) AS want FROM s),
    p AS (SELECT *, coalesce(sum(want) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT source, n, CAST(least(want, greatest(0, 150 - before)) AS BIGINT) AS taken FROM p
""")
def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of documents handed out over sources in order, each with a cap. A row for each source is ordered."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "source"))
    ordered = s.withColumn("k", k).withColumn("want", F.least(F.col("n"), 60 - 2 * F.col("k")))
    return windows.budget(ordered.withColumn("all", F.lit(0)), ["all"], [F.col("k")], F.col("want"), 150).select("source", "n", F.col("taken").cast("long").alias("taken"))


@query("""
    SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4
""")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation."""
    return fuse.top_per(table(spark, sf_dir, "conversations"), ["conv_id"], 4, F.desc("turn")).orderBy("conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("""
    SELECT conv_id, count(*) AS n, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS text_md5 FROM conversations GROUP BY conv_id
""")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(lines, lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n")).alias("text_md5"))


@query("""
    SELECT md5(coalesce(text, '')) AS text_md5, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    return d.groupBy("text_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query("""
    SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, md5(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")
def dedupe_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each source the first document of each content: a minimum per group, summed before the shuffle."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return d.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")


@query("""
    SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 25
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five documents of each language by the hash of their id."""
    from ..operators.evaluate import stratified

    return stratified(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 25).select("lang", "doc_id")


@query("""
    WITH v AS (SELECT doc_id AS id, 'labelled' AS stage, 0 AS s FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'long', 1 FROM documents WHERE n_chars > 4000
               UNION ALL SELECT doc_id, 'licensed', 2 FROM documents WHERE contains(text, 'icense') UNION ALL SELECT doc_id, 'english', 3 FROM documents WHERE lang = 'en'),
    m AS (SELECT *, min(CASE WHEN stage <> 'licensed' THEN s END) OVER (PARTITION BY id) AS first FROM v)
    SELECT id, stage FROM m WHERE stage = 'licensed' OR s = first
""")
def priority_union_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several stages: each from its first stage only, but for one stage that is always kept."""
    d, key = table(spark, sf_dir, "documents"), F.col("doc_id").alias("id")
    stages = [("labelled", table(spark, sf_dir, "labels").where("quality = 1").select(key)), ("long", d.where("n_chars > 4000").select(key)), ("licensed", d.where(F.col("text").contains("icense")).select(key)), ("english", d.where("lang = 'en'").select(key))]
    return fuse.priority_union(stages, "id", always=("licensed",)).select("id", "stage")


@query("""
    WITH k AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) / 50 AS score, 0 AS o FROM part WHERE p_size >= 25), s AS (SELECT p_brand, p_partkey, p_retailprice / 2000, 1 FROM part),
    m AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, o) AS n FROM (SELECT * FROM k UNION ALL SELECT * FROM s))
    SELECT p_partkey, p_brand, round(score, 6) AS score, CASE WHEN o = 0 THEN 'keyword' ELSE 'semantic' END AS origin FROM m WHERE n = 1
""")
def keep_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored lists merged by the higher score; on a tie the first list's row."""
    p = table(spark, sf_dir, "part")
    first = p.where("p_size >= 25").select("p_brand", "p_partkey", (F.col("p_size").cast("double") / 50).alias("score"), F.lit("keyword").alias("origin"))
    second = p.select("p_brand", "p_partkey", (F.col("p_retailprice") / 2000).alias("score"), F.lit("semantic").alias("origin"))
    from ..operators.vector import keep_best

    return keep_best(first, second, ["p_partkey"], "score").select("p_partkey", "p_brand", F.round("score", 6).alias("score"), "origin")


@query("""
    WITH f AS (SELECT p_partkey AS id, p_name FROM part WHERE contains(p_name, 'ring')) SELECT id, p_name FROM f UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size > 40 AND NOT EXISTS (SELECT 1 FROM f WHERE id = p_partkey)
""")
def unseen_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    return fuse.unseen(p.where(F.col("p_name").contains("ring")).drop("p_size"), p.where("p_size > 40").drop("p_size"), "id")


@query("""
    SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS n FROM customer) WHERE n <= 3
""")
def top_per_group_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.top_per(table(spark, sf_dir, "customer"), ["c_nationkey"], 3, F.desc_nulls_last("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "c_acctbal")


@query("""
    SELECT o_custkey, o_orderkey, o_orderdate = max(o_orderdate) OVER w AND o_orderkey = max(o_orderkey) FILTER (WHERE true) OVER w2 AS is_current
    FROM orders WINDOW w AS (PARTITION BY o_custkey), w2 AS (PARTITION BY o_custkey, o_orderdate)
""")
def version_is_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each key, by date, then id."""
    return windows.current_version(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "is_current")


@query("""
    WITH m AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages)
    SELECT host, count(*) AS n, min(page_id) AS first_page, count(DISTINCT number) AS n_numbers FROM m GROUP BY host
""")
def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))
    return m.groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"), F.countDistinct("number").alias("n_numbers"))


@query("""
    WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS t FROM orders)
    SELECT o_orderkey, t, CASE WHEN length(t) = 4 THEN CAST(t || '-01-01' AS DATE) WHEN length(t) = 7 THEN CAST(t || '-01' AS DATE) WHEN contains(t, '/') THEN CAST(strptime(t, '%d/%m/%Y') AS DATE) ELSE CAST(t AS DATE) END AS day FROM d
""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return o.select("o_orderkey", t.alias("t")).withColumn("day", text.any_date(F.col("t")))


QUERIES, ORACLE_SQL = query.queries, query.sql
