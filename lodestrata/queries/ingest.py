"""Merges and incremental ingest. The new state of a table is computed whole; nothing is written over the inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import backfill, landed, readers, sinks, tables
from ..storage import shared_folder
from ..streaming import incremental, versions
from .registry import Registry, table

query = Registry()


@query("""
    WITH t AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), i AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents)
    SELECT CASE WHEN t.h IS NULL THEN 'new' WHEN t.h = i.h THEN 'same' ELSE 'changed' END AS change, count(*) AS n, min(doc_id) AS first_id FROM i LEFT JOIN t USING (doc_id) GROUP BY 1
""")
def hash_gated_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest would do with each document, by its content's hash."""
    d = table(spark, sf_dir, "documents")
    target = d.where("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("h"))
    incoming = d.select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return sinks.changed(incoming, target, "doc_id", "h").groupBy("change").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, -1.0 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0
""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return sinks.insert_ignore(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)), ["c_custkey"])


@query("""
    SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return sinks.upsert(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)), ["c_custkey"])


@query("""
    SELECT n_nationkey, n_name, CASE WHEN r_regionkey IS NOT NULL THEN r_name END AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
""")
def update_from_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"), F.lit(None).cast("string").alias("region"))
    return sinks.update_columns(n, table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region")), "r_regionkey", ["region"]).drop("r_regionkey")


@query("""
    SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus IS DISTINCT FROM o_orderstatus
""")
def propagation_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children whose copy of a parent's column is out of date."""
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"))
    return sinks.differing(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), parents, "l_orderkey", ["l_linestatus"])


@query("""
    SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY 1, 2
""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value") * 100).cast("long").alias("cents"))


@query("""
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id
""")
def events_incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream of micro-batches; each leaves its last event of every user as a table of its own in
    the shared folder, and the state is the last of these."""
    base = f"{incremental.shared_folder(spark)}/events-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events*.parquet")
    changes = stream.select("user_id", "ts", "event_id", "event_type")
    merge = incremental.change_log(spark, f"{base}/changes", changes.schema, ["user_id"], "ts", "event_id")
    incremental.upsert_stream(changes, merge, f"{base}/checkpoint").awaitTermination()
    return incremental.state(spark, f"{base}/changes", changes.schema, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files: a streaming source reads a folder or a pattern."""
    first = spark.read.parquet(path).inputFiles()[0]
    return not first.rstrip("/").endswith(path.rsplit("/", 1)[-1])


@query("""
    WITH kept AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0), fresh AS (SELECT o_orderkey AS l_orderkey, CAST(0 AS INTEGER) AS l_linenumber, CAST(-1 AS DOUBLE) AS l_quantity FROM orders WHERE o_orderkey % 10 = 0)
    SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity FROM kept UNION ALL SELECT * FROM fresh) GROUP BY l_orderkey
""")
def child_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents that came anew bring their children, and their former ones go."""
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    children = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    fresh = parents.select("l_orderkey", F.lit(0).alias("l_linenumber"), F.lit(-1.0).alias("l_quantity"))
    return sinks.replace_children(children, fresh, parents, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(path if _is_folder(spark, path) else f"{sf_dir}/{name}*.parquet")


@query("""
    WITH t AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS half FROM events),
    last AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id)
    SELECT user_id, event_id, event_type, round(value, 6) AS value FROM last WHERE event_type <> 'error' OR user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING epoch_us(max(ts)) <= (SELECT half FROM t))
""")
def merge_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as a table that changes in place: the first half of the time makes it, the second is
    merged in; a user whose last event of the second half is an error goes."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    half = e.agg(F.expr("(min(unix_micros(timestamp(ts))) + max(unix_micros(timestamp(ts)))) div 2")).first()[0]
    path = f"{shared_folder(spark)}/users-{uuid.uuid4().hex}"
    first = e.where(at <= half)
    last_first = (-at, -F.col("event_id"))
    tables.create(first, path, ["user_id"], 16, *last_first)
    tables.merge(e.where(at > half), path, *last_first, deleted=F.col("event_type") == "error")
    return tables.read(spark, path, first.schema.simpleString()[7:-1].replace(":", " ")).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("""
    SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings
""")
def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value computed for every row in ranges of its key, with a ledger of the finished ones."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return backfill.run(e, "vec_id", f"{shared_folder(spark)}/norms-{uuid.uuid4().hex}", 4, lambda rows: rows.select("vec_id", "label", F.round(norm, 6).alias("norm")))


@query("""
    SELECT o_custkey, o_orderkey, o_orderdate = max(o_orderdate) OVER w AND o_orderkey = max(o_orderkey) OVER w2 AS is_current
    FROM orders WINDOW w AS (PARTITION BY o_custkey), w2 AS (PARTITION BY o_custkey, o_orderdate)
""")
def versions_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of each key, kept by a stream that demotes the one before."""
    base = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    told = versions.changes(_stream(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    versions.keep(told, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return versions.current(spark, f"{base}/log").select(F.col("key").alias("o_custkey"), F.col("id").alias("o_orderkey"), "is_current")


@query("""
    SELECT doc_id AS id, lang, length(coalesce(text, '')) AS n_chars FROM documents WHERE lang IS NOT NULL AND n_chars % 7 <> 0
""")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines of a batch written and read back: the number of their id, the parsed body; failed lines go."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents")
    body = F.when(F.col("lang").isNotNull(), F.to_json(F.struct("lang", F.length(F.coalesce("text", F.lit(""))).alias("n"))))
    sinks.request_lines(d.select(F.concat(F.lit("case-"), F.col("doc_id")).alias("custom_id"), F.when(F.col("n_chars") % 7 == 0, "failed").alias("error"), body.alias("body")), path, "custom_id", "error", "body")
    return readers.json_lines(spark, path, "lang string, n long").select("id", "lang", F.col("n").alias("n_chars"))


@query("""
    WITH p AS (SELECT DISTINCT event_id // 100 AS page FROM events WHERE event_id >= 0), r AS (SELECT page, row_number() OVER (ORDER BY page) - 1 AS place FROM p)
    SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY event_id) - 1 AS INTEGER) AS place, event_id, user_id, event_type FROM events JOIN r ON page = event_id // 100 WHERE r.page = r.place AND event_id >= 0
""")
def landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the pages of a paged service, a hundred each, landed as files and delivered along their cursors, as far
    as no page is missing."""
    base, item = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}", "event_id long, user_id long, event_type string"
    own = F.struct("event_id", "user_id", "event_type")
    pages = table(spark, sf_dir, "events").where("event_id >= 0").groupBy(F.expr("event_id div 100").alias("page")).agg(F.array_sort(F.collect_list(own)).alias("items"))
    page = F.struct(F.concat(F.lit("c"), "page").alias("cursor"), F.concat(F.lit("c"), F.col("page") + 1).alias("next"), "items")
    files = pages.groupBy(F.expr("page div 100").alias("file")).agg(F.to_json(F.collect_list(page)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(f"{base}/in")
    landed.take(spark, f"{base}/in", f"{base}/pages", item, f"{base}/checkpoint").awaitTermination()
    return landed.delivered(landed.pages(spark, f"{base}/pages", item), "c0")


@query("""
    SELECT doc_id, lang, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS place, md5(unnest(s)) AS line_md5 FROM (SELECT doc_id, lang, string_split(text, '. ') AS s FROM documents WHERE text IS NOT NULL)
""")
def nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported as JSON files of parents with an array of lines, read back as a row per line with its place."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    lines = F.transform(F.split("text", "[.] ", -1), lambda line: F.struct(F.md5(line).alias("line_md5")))
    parents = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.struct("doc_id", "lang", lines.alias("lines")).alias("parent"))
    files = parents.groupBy(F.expr("doc_id div 500")).agg(F.to_json(F.collect_list("parent")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.nested_json(spark, path, "doc_id long, lang string, lines array<struct<line_md5 string>>", "lines")


QUERIES, ORACLE_SQL = query.queries, query.sql
