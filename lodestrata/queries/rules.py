"""Cascades, fallbacks, pasted-text search, rule tables and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from ..operators import evaluate, fuse, keyword
from ..sources import readers
from .registry import Registry, table
from .texts import BLANK, WHITE, meaningful_sql, runs_sql, tokens_sql, windows_sql

query = Registry()


_RUNS = runs_sql("content")
_LINE = meaningful_sql("s").replace("lambda w", "lambda v").replace("(w", "(v").replace("w NOT", "v NOT")


@query(rf"""
    WITH c AS (SELECT doc_id AS parent, CAST(k AS INTEGER) AS chunk_index, trim(substring(text, start + 1, 1500), {WHITE}) AS content
               FROM (SELECT doc_id, text, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS start FROM (SELECT doc_id, text, range(0, length(text), 1300) AS s FROM documents))),
    ch AS (SELECT *, {_RUNS} AS toks FROM c WHERE length(content) >= 1),
    pasted AS (SELECT item_id, text || chr(10) || array_to_string(regexp_split_to_array(text, '[.]'), chr(10)) AS text FROM benchmark),
    t AS (SELECT item_id, {meaningful_sql("text")} AS w FROM pasted),
    k AS (SELECT item_id, w, unnest({windows_sql()}) AS s FROM t WHERE len(w) >= 6),
    win AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 7], ' ') AS win, list_distinct(w[s + 1 : s + 7]) AS terms FROM k WHERE len(w[s + 1 : s + 7]) >= 5),
    occ AS (SELECT parent, chunk_index, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM ch),
    asked AS (SELECT DISTINCT win, unnest(terms) AS w, len(terms) AS n FROM win),
    hit AS (SELECT win, parent, chunk_index, i, w, n FROM asked JOIN occ USING (w)),
    held AS (SELECT win, parent, chunk_index FROM hit GROUP BY ALL HAVING count(DISTINCT w) = max(n)),
    own AS (SELECT hit.* FROM hit JOIN held USING (win, parent, chunk_index)),
    span AS (SELECT e.win, e.parent, e.chunk_index, e.i AS b, o.w, max(o.i) AS last, max(e.n) AS n FROM own e JOIN own o ON o.win = e.win AND o.parent = e.parent AND o.chunk_index = e.chunk_index AND o.i <= e.i GROUP BY ALL),
    cover AS (SELECT win, parent, chunk_index, a, min(b) AS b FROM (SELECT win, parent, chunk_index, b, min(last) AS a FROM span GROUP BY ALL HAVING count(*) = max(n)) GROUP BY ALL),
    dense AS (SELECT win, parent, chunk_index, sum(0.1::DOUBLE / (1 + b - a + 1 - m)) AS density FROM (SELECT c.win, c.parent, c.chunk_index, a, b, count(*) AS m FROM cover c JOIN own o ON o.win = c.win AND o.parent = c.parent AND o.chunk_index = c.chunk_index AND o.i BETWEEN a AND b GROUP BY ALL) GROUP BY ALL),
    n0 AS (SELECT item_id, text, trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\r\f]+', ' ', 'g'), ' ') AS plain FROM pasted),
    n1 AS (SELECT item_id, regexp_extract_all(plain, '(?:№ *)?[0-9]{{1,4}}/[0-9]{{4,}}(?:[-/][0-9]+)?') AS nums,
                  list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda s: trim(regexp_replace(replace(s, chr(160), ' '), '[ \t\f]+', ' ', 'g'), ' ')), lambda s: length(s) BETWEEN 35 AND 170) AS lines FROM n0),
    needle AS (SELECT DISTINCT item_id, unnest(list_concat(flatten(list_transform(nums, lambda s: [s, trim(regexp_replace(s, '^№ *', ''), ' ')])), list_filter(lines, lambda s: len({_LINE}) >= 4))[1:8]) AS needle FROM n1),
    parts AS (SELECT item_id, parent, chunk_index, density AS value FROM dense JOIN win USING (win) UNION ALL SELECT item_id, parent, chunk_index, 4.0::DOUBLE FROM needle JOIN ch ON contains(lower(content), lower(needle))),
    r AS (SELECT item_id, parent, chunk_index, round(sum(value), 9) AS text_rank FROM parts GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, parent ORDER BY text_rank DESC, chunk_index) AS k FROM r) WHERE k = 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY text_rank DESC, parent) AS rank FROM best)
    SELECT item_id, parent AS doc_id, chunk_index, round(text_rank, 6) AS text_rank, round(least(1.0::DOUBLE, 0.58::DOUBLE + ln(1 + text_rank) / 2.5::DOUBLE), 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM top WHERE top.rank <= 10
""")
def pasted_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that an item was pasted from: by cover density of its windows and by its needles, over chunks. The
    pasted text is the item and, in lines of their own, its sentences."""
    chunks = text.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "parent")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit("\n"), F.array_join(F.split("text", "[.]"), "\n")).alias("text"))
    found = keyword.pasted_search(items, chunks)
    return found.select("item_id", F.col("parent").alias("doc_id"), "chunk_index", F.round("text_rank", 6).alias("text_rank"), F.round("similarity", 6).alias("similarity"), "rank")


@query("""
    SELECT p_partkey, p_name, CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 25 THEN 2 WHEN p_size <= 40 THEN 3 ELSE 4 END AS importance FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'promo')
    ORDER BY importance, p_retailprice DESC, p_partkey LIMIT 8
""")
def keyword_by_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance = F.when(F.col("p_size") <= 10, 1).when(F.col("p_size") <= 25, 2).when(F.col("p_size") <= 40, 3).otherwise(4)
    hit = table(spark, sf_dir, "part").where(keyword.any_field("red", F.col("p_name")) | keyword.any_field("promo", F.col("p_type")))
    return hit.withColumn("importance", importance).orderBy("importance", F.desc("p_retailprice"), "p_partkey").limit(8).select("p_partkey", "p_name", "importance")


@query("""
    WITH s AS (SELECT source, d.doc_id, 0 AS stage FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND quality = 0 UNION ALL SELECT source, doc_id, 1 FROM documents WHERE contains(text, 'token') UNION ALL SELECT source, doc_id, 2 FROM documents WHERE n_chars > 500),
    m AS (SELECT source, doc_id, min(stage) AS stage FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stage, doc_id) AS n FROM m)
    SELECT source, doc_id, CAST(stage AS INTEGER) AS stage, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 3
""")
def cascade_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact finds first, then looser ones for those sources only that have fewer than three yet."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text", "n_chars")
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    rules = [lambda rows: rows.join(poor, "doc_id", "left_semi"), lambda rows: rows.where(F.col("text").contains("token")), lambda rows: rows.where("n_chars > 500")]
    stages = [lambda open_, rule=rule: rule(d.join(keyword.small(open_), "source", "left_semi")).select("source", "doc_id") for rule in rules]
    return fuse.cascade(d.select("source").where("source is not null").distinct(), stages, ["source"], "doc_id", 3).select("source", "doc_id", "stage", "rank")


@query("""
    WITH h AS (SELECT source, doc_id FROM documents WHERE regexp_matches(text, '(^|[\\r\\n])\\s*Licensed under')), f AS (SELECT source, doc_id FROM documents WHERE contains(lower(text), 'the')),
    b AS (SELECT * FROM h UNION ALL SELECT * FROM f WHERE source NOT IN (SELECT source FROM h)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM b)
    SELECT source, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS first_ids FROM r WHERE n <= 4 GROUP BY source
""")
def heading_fetch_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a heading at a line's start; where there is none, by containment; the first four in order."""
    d = table(spark, sf_dir, "documents")
    found = fuse.with_fallback(d.where(F.col("text").rlike(r"(^|[\r\n])\s*Licensed under")).select("source", "doc_id"), d.where(keyword.contains(F.col("text"), "the")).select("source", "doc_id"), ["source"])
    top = fuse.top_per(found, ["source"], 4, F.col("doc_id")).withColumn("id_text", F.col("doc_id").cast("string"))
    joined = readers.document(top, "source", "doc_id", "id_text", ",").withColumnRenamed("content", "first_ids")
    return joined.select("source", F.size(F.split("first_ids", ",")).cast("long").alias("n"), "first_ids")


@query("""
    WITH e AS (SELECT p_type, p_partkey, p_size, p_retailprice FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AND (p_size IS NULL OR p_size >= 5))
    SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS n FROM e) WHERE n = 1
""")
def canonical_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of highest priority of each name, among those that have a child."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    p = table(spark, sf_dir, "part").where("p_size is null or p_size >= 5").join(used, "p_partkey", "left_semi")
    best = F.max(F.struct("p_size", "p_retailprice", F.bitwise_not("p_partkey").alias("least"), "p_partkey"))
    return p.groupBy("p_type").agg(best.alias("b")).select("p_type", "b.p_partkey")


@query("""
    SELECT count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts, max(l_orderkey) AS last_order, count(*) AS n FROM lineitem
""")
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_partkey").alias("n_parts"), F.max("l_orderkey").alias("last_order"), F.count("*").alias("n"))


_DOMAINS = {"licence": ["licens", "copyright", "rights"], "secret": ["token", "password", "key"], "contact": ["@", "www", "http"]}
_COUNT = {k: " + ".join(f"CAST(contains(lower(text), '{n}') AS INTEGER)" for n in v) for k, v in _DOMAINS.items()}


@query(f"""
    WITH s AS (SELECT doc_id, {_COUNT["licence"]} AS a, {_COUNT["secret"]} AS b, {_COUNT["contact"]} AS c FROM documents)
    SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a >= b AND a >= c THEN 'licence' WHEN b >= c THEN 'secret' ELSE 'contact' END AS domain, CAST(greatest(a, b, c) AS INTEGER) AS hits FROM s
""")
def domain_by_most_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain with most signals, the first of equals."""
    counts = [sum((keyword.contains(F.col("text"), n).cast("int") for n in v), F.lit(0)) for v in _DOMAINS.values()]
    best = F.array_max(F.array(*(F.struct(c.alias("hits"), F.lit(-i).alias("order"), F.lit(k).alias("name")) for i, (k, c) in enumerate(zip(_DOMAINS, counts, strict=True)))))
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).select("doc_id", F.when(F.col("b.hits") > 0, F.col("b.name")).otherwise("none").alias("domain"), F.col("b.hits").alias("hits"))


@query(f"""
    WITH t AS (SELECT item_id, list_sort({tokens_sql("text")}) AS a FROM benchmark), p AS (SELECT x.item_id, x.a, y.a AS b FROM t x JOIN t y ON y.item_id = x.item_id + 1)
    SELECT item_id, CAST(len(list_filter(a, lambda v: list_contains(b, v))) AS INTEGER) AS both, CAST(len(list_filter(a, lambda v: NOT list_contains(b, v))) AS INTEGER) AS only_first, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either FROM p
""")
def array_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("a"))
    pairs = t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return pairs.select("item_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("only_first"), F.size(F.array_union("a", "b")).alias("either"))


@query("""
    WITH x AS (SELECT o_orderkey, (o_orderkey % 10) / 10.0::DOUBLE AS issue, (o_orderkey % 7) / 7.0::DOUBLE AS holding, (o_orderkey % 5) / 5.0::DOUBLE AS facts, CAST(o_orderkey % 9 + 1 AS INTEGER) AS rank, o_orderkey % 13 = 0 AS direct FROM orders),
    v AS (SELECT *, 40 * issue + 20 * holding + 15 * facts + 7 * issue + CASE WHEN rank = 1 THEN 8.0 WHEN rank = 2 THEN 6.0 WHEN rank = 3 THEN 4.5 WHEN rank <= 5 THEN 3.0 WHEN rank <= 8 THEN 1.5 ELSE 0 END::DOUBLE + 3 * holding AS value FROM x)
    SELECT o_orderkey, CAST(floor(least(100.0::DOUBLE, greatest(value, CASE WHEN direct THEN 97.0 ELSE 0 END::DOUBLE)) * 1000 + 0.5::DOUBLE) AS BIGINT) AS relevance_thousandths FROM v
""")
def semantic_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, zero = F.col("o_orderkey"), F.lit(0.0)
    issue, holding, facts = (k % 10) / F.lit(10.0), (k % 7) / F.lit(7.0), (k % 5) / F.lit(5.0)
    value = scores.semantic_relevance(issue, holding, facts, zero, zero, issue, (k % 9 + 1).cast("int"), holding, F.when(k % 13 == 0, 97.0).otherwise(0.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(value * 1000 + 0.5).alias("relevance_thousandths"))


@query("""
    SELECT CASE WHEN o_orderstatus = 'P' THEN 'supporting' WHEN o_orderkey % 7 = 0 THEN 'binding_full_chamber' WHEN o_orderpriority LIKE '1%' THEN 'persuasive_supreme' WHEN o_orderpriority LIKE '2%' THEN 'appellate' ELSE 'lower' END AS kind, count(*) AS n FROM orders GROUP BY 1
""")
def authority_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rules.authority_kind(F.substring("o_orderpriority", 1, 1).cast("int"), F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus") != "P")
    return table(spark, sf_dir, "orders").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') || ',' || (year(o_orderdate) + 3) ELSE '' END AS years, CAST(CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) ELSE 2026 END AS INTEGER) AS relevant_year FROM orders
""")
def query_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years that a text states, and the year that counts: stated, else the date's, else now."""
    o, year, k = table(spark, sf_dir, "orders"), F.year("o_orderdate"), F.col("o_orderkey")
    note = F.when(k % 2 == 0, F.concat_ws(" ", F.lit("between"), year, F.lit("and"), year + 3, F.lit("see no. 12345"))).otherwise("undated")
    d = o.select("o_orderkey", rules.years(note).alias("y"), F.when(k % 3 == 0, year).alias("dated"))
    return d.select("o_orderkey", F.array_join("y", ",").alias("years"), rules.relevant_year(F.lit(None).cast("int"), F.try_element_at("y", F.lit(1)), F.col("dated"), 2026).alias("relevant_year"))


ALIASES = [("license", "license"), ("license", "licensed under"), ("rights", "rights reserved"), ("rights", "all rights reserved"), ("token", "token ="), ("token", "token")]
_ALIASES = "(VALUES " + ", ".join(f"('{n}', '{a}')" for n, a in ALIASES) + ") AS a(name, alias)"


@query(f"""
    SELECT doc_id, name, alias FROM (SELECT doc_id, name, alias, row_number() OVER (PARTITION BY doc_id, name ORDER BY length(alias) DESC, alias) AS n FROM documents JOIN {_ALIASES} ON contains(lower(text), alias)) WHERE n = 1
""")
def alias_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.alias_references(table(spark, sf_dir, "documents"), spark.createDataFrame(ALIASES, "name string, alias string"), "doc_id", "text")


@query("""
    WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '6-1; 8,p1-1 ,6' WHEN 1 THEN '10;;10-2' ELSE '' END AS tags FROM customer)
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '6,8,P1-1' WHEN 1 THEN '10' ELSE '' END AS parsed FROM t
""")
def tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    tags = F.when(k == 0, "6-1; 8,p1-1 ,6").when(k == 1, "10;;10-2").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(rules.tag_list(tags), ",").alias("parsed"))


@query("""
    SELECT CASE WHEN l_quantity < 5 THEN 'not_needed' WHEN l_returnflag = 'A' THEN 'not_routed' WHEN l_linestatus = 'O' THEN 'not_attempted' WHEN l_tax > 0.07 THEN 'failed' WHEN l_linenumber > 3 THEN 'found' ELSE 'not_found' END AS status, count(*) AS n FROM lineitem GROUP BY 1
""")
def source_status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = rules.source_status(F.col("l_returnflag") != "A", F.col("l_quantity") >= 5, F.col("l_linestatus") != "O", F.col("l_tax") > 0.07, F.when(F.col("l_linenumber") > 3, 1).otherwise(0))
    return table(spark, sf_dir, "lineitem").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, 'money' AS kind, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS value, CAST(4 AS INTEGER) AS "offset" FROM orders
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'month' END, CAST(o_orderkey % 30 AS DOUBLE), CAST(4 + length(CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR)) + 12 AS INTEGER) FROM orders
""")
def fact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and deadlines in the orders' terms, with their places."""
    k = F.col("o_orderkey")
    terms = F.concat_ws(" ", F.lit("pay"), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("EUR within"), (k % 30).cast("string"), F.when(k % 2 == 0, "days.").otherwise("months of 7 parties."))
    return rules.extract_facts(table(spark, sf_dir, "orders").select("o_orderkey", terms.alias("terms")), "o_orderkey", "terms")


@query(f"""
    WITH p AS (SELECT doc_id, strpos(text, chr(10)) AS cut, text FROM documents),
    h AS (SELECT doc_id, trim(CASE WHEN cut > 0 THEN left(text, cut - 1) ELSE '' END, {BLANK}) AS head, trim(CASE WHEN cut > 0 THEN substring(text, cut + 1) ELSE coalesce(text, '') END, {BLANK}) AS body FROM p),
    l AS (SELECT *, greatest(200, 1500 - length(head) - 1) AS lim FROM h WHERE body <> ''),
    s AS (SELECT *, unnest(range(0, length(body), greatest(100, lim - 200))) AS start FROM l),
    c AS (SELECT doc_id, start // greatest(100, lim - 200) AS chunk_index, trim(head || chr(10) || trim(substring(body, start + 1, lim), {BLANK}), {BLANK}) AS content FROM s)
    SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5 FROM c WHERE length(content) > 20
""")
def headed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that repeat their header: the text's first line, if there are more."""
    t, cut = F.col("text"), F.locate("\n", "text")
    found = text.headed_chunks(table(spark, sf_dir, "documents"), "doc_id", F.when(cut > 0, F.substring(t, F.lit(1), cut - 1)), F.when(cut > 0, F.substring(t, cut + 1, F.length(t))).otherwise(t))
    return found.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query("""
    WITH a AS (SELECT avg((quality = 1)::INTEGER) AS good, avg((toxic = 0)::INTEGER) AS clean FROM labels WHERE doc_id % 2 = 0), b AS (SELECT avg((quality = 1)::INTEGER) AS good, avg((toxic = 0)::INTEGER) AS clean FROM labels WHERE doc_id % 2 = 1)
    SELECT round(100 * (b.good - a.good), 2) AS good_change, round(100 * (b.clean - a.clean), 2) AS clean_change FROM a, b
""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = {"good": (F.col("quality") == 1).cast("int"), "clean": (F.col("toxic") == 0).cast("int")}
    return evaluate.compare_runs(table(spark, sf_dir, "labels"), F.col("doc_id") % 2 == 1, metrics)


@query("""
    WITH f AS (SELECT DISTINCT b.item_id, lower(regexp_extract(b.text, '^([A-Za-z]+)', 1)) AS name, b.item_id AS id FROM benchmark b), c AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name, CAST(-1 AS BIGINT) AS id FROM part),
    m AS (SELECT name, id, 0 AS p FROM c UNION ALL SELECT name, id, 1 FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p, id) AS n FROM m)
    SELECT name, id FROM r WHERE n = 1
""")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of names to ids; curated entries win over found ones."""
    curated = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.lit(-1).cast("long").alias("id")).distinct()
    found = table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("name"), F.col("item_id").alias("id"))
    return readers.aliases(curated, found)


QUERIES, ORACLE_SQL = query.queries, query.sql
