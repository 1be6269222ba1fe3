"""Scores, shares, trends and confidence over orders, which stand in for decisions: status is the result, priority the
court level, the customer the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import evaluate, fuse, keyword, verify, windows
from ..plans.retrieval import RetrievalPlan
from .registry import Registry, table
from .texts import tokens_sql

query = Registry()
_AUTHORITY = """(CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 800 WHEN '2' THEN 400 ELSE 200 END + CASE WHEN year(o_orderdate) + 12 BETWEEN 2010 AND 2026 THEN least(350, (year(o_orderdate) + 12 - 2010) * 25) ELSE 0 END
    + CASE WHEN o_orderkey % 7 = 0 THEN 300 ELSE 0 END)"""


def result():
    return F.when(F.col("o_orderstatus") == "F", "granted").when(F.col("o_orderstatus") == "O", "denied")


def level():
    return F.substring("o_orderpriority", 1, 1).cast("int")


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'granted' WHEN 'O' THEN 'denied' END AS result FROM orders),
    n AS (SELECT *, count(result) OVER (PARTITION BY o_custkey) AS n, count(result) OVER (PARTITION BY o_custkey, result) AS same FROM r)
    SELECT o_orderkey, result, n, same, n >= 4 AND result IS NOT NULL AND same < 0.20 * n AS outlier FROM n
""")
def outlier_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that few of their group share."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", result().alias("result"))
    return windows.outliers(o, ["o_custkey"], "result").select("o_orderkey", "result", "n", "same", "outlier")


@query("""
    WITH g AS (SELECT o_custkey, count(*) FILTER (WHERE year(o_orderdate) < 1998) AS n_early, count(*) FILTER (WHERE year(o_orderdate) >= 1998) AS n_late,
        count(*) FILTER (WHERE year(o_orderdate) < 1998 AND o_orderstatus = 'F') AS hit_early, count(*) FILTER (WHERE year(o_orderdate) >= 1998 AND o_orderstatus = 'F') AS hit_late FROM orders GROUP BY o_custkey)
    SELECT *, n_early >= 2 AND n_late >= 2 AND abs(hit_late * n_early - hit_early * n_late) >= 0.30 * n_early * n_late AS shifted FROM g
""")
def period_trend_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trend(table(spark, sf_dir, "orders"), "o_custkey", F.year("o_orderdate") >= 1998, F.col("o_orderstatus") == "F")


@query(f"""
    WITH a AS (SELECT o_orderkey, o_custkey, {_AUTHORITY} AS authority, (o_orderkey * 37 % 1000) / 1000.0 AS relevance, o_orderkey % 11 = 0 AS outlier FROM orders),
    c AS (SELECT *, CASE WHEN outlier THEN (0.6 * relevance + 0.4 * authority / 1450) * 0.7 ELSE 0.6 * relevance + 0.4 * authority / 1450 END AS value FROM a)
    SELECT o_orderkey, CAST(authority AS INTEGER) AS authority, CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS combined_millionths FROM c
""")
def authority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority of a decision and its blend with relevance; as an integer, so that rounding cannot differ."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", scores.authority(level(), F.year("o_orderdate") + 12, F.col("o_orderkey") % 7 == 0, 2026).alias("authority"), ((F.col("o_orderkey") * 37 % 1000) / 1000.0).alias("relevance"), (F.col("o_orderkey") % 11 == 0).alias("outlier"))
    base = 0.6 * F.col("relevance") + 0.4 * F.col("authority") / 1450
    return rows.select("o_orderkey", "authority", F.floor(F.when(F.col("outlier"), base * 0.7).otherwise(base) * 1000000 + 0.5).alias("combined_millionths"))


@query(f"""
    WITH a AS (SELECT o_orderkey, o_custkey, {_AUTHORITY} AS authority FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY authority DESC, o_orderkey) AS n, authority - lead(authority, 1, 0) OVER (PARTITION BY o_custkey ORDER BY authority DESC, o_orderkey) AS lead FROM a),
    s AS (SELECT *, authority / 14.5 AS score, lead / 14.5 AS gap FROM r WHERE n <= 4)
    SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS rank, CAST(lead AS INTEGER) AS lead, CASE n WHEN 1 THEN 8.0 WHEN 2 THEN 6.0 WHEN 3 THEN 4.5 ELSE 3.0 END::DOUBLE AS bonus,
        CASE WHEN (score >= 70 AND gap >= 8) OR (score >= 50 AND gap >= 10) OR (score >= 45 AND gap >= 15) THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN n <= 2 AND score >= 45 THEN 'primary' ELSE 'supporting' END AS role FROM s
""")
def combined_rank_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top decisions of each group with their lead over the next, rank bonus, confidence and role."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", scores.authority(level(), F.year("o_orderdate") + 12, F.col("o_orderkey") % 7 == 0, 2026).alias("authority"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("authority"), "o_orderkey")
    top = o.withColumn("rank", F.row_number().over(w)).withColumn("lead", F.col("authority") - F.lead("authority", 1, 0).over(w)).where("rank <= 4")
    score = F.col("authority") / 14.5
    return top.select("o_custkey", "o_orderkey", "rank", "lead", scores.rank_bonus(F.col("rank")).alias("bonus"), scores.match_confidence(score, F.col("lead") / 14.5, F.lit(0)).alias("confidence"), F.when((F.col("rank") <= 2) & (score >= 45), "primary").otherwise("supporting").alias("role"))


@query("""
    WITH d AS (SELECT l_orderkey, l_suppkey, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem),
    g AS (SELECT l_orderkey, CAST(max(d) AS DOUBLE) / 10 AS most, CAST(sum(d) AS DOUBLE) / (count(*) * 10) AS mean, count(DISTINCT l_suppkey) AS parents, count(*) AS chunks,
                 CASE WHEN count(*) < 2 THEN 0.0 ELSE CAST(count(*) * sum(d * d) - sum(d) * sum(d) AS DOUBLE) / (count(*) * count(*) * 100) END AS variance FROM d GROUP BY l_orderkey),
    s AS (SELECT *, 0.5::DOUBLE * most + 0.25::DOUBLE * mean + 0.1::DOUBLE * least(1.0::DOUBLE, CAST(parents AS DOUBLE) / 3) + 0.1::DOUBLE * least(1.0::DOUBLE, CAST(chunks AS DOUBLE) / 10) + 0.05::DOUBLE * greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, 10 * variance)) AS score FROM g)
    SELECT l_orderkey, CAST(floor(score * 100000 + 0.5::DOUBLE) AS BIGINT) AS score_e5, CASE WHEN round(score, 9) >= 0.70 AND round(most, 9) >= 0.65 THEN 'high' WHEN round(score, 9) >= 0.50 OR round(most, 9) >= 0.50 THEN 'medium' WHEN round(score, 9) > 0 THEN 'low' ELSE 'none' END AS label FROM s
""")
def score_variance_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a retrieval from its chunks' scores; summed as integers, so that no order of adding shows."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    n, total = F.count("*"), F.sum("d")
    variance = F.when(n < 2, 0.0).otherwise((n * F.sum(F.col("d") * F.col("d")) - total * total).cast("double") / (n * n * 100))
    g = d.groupBy("l_orderkey").agg(F.max("d").cast("double") / 10, total.cast("double") / (n * 10), F.countDistinct("l_suppkey"), n, variance).toDF("l_orderkey", "most", "mean", "parents", "chunks", "variance")
    score = scores.retrieval_confidence(F.col("most"), F.col("mean"), F.col("parents"), F.col("chunks"), F.col("variance"))
    return g.select("l_orderkey", F.floor(score * 100000 + 0.5).alias("score_e5"), scores.confidence_label(F.round(score, 9), F.round("most", 9)).alias("label"))


@query("""
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'The claim was granted' WHEN 1 THEN 'Not granted in part' WHEN 2 THEN 'Appeal dismissed' WHEN 3 THEN 'Proceedings stopped' ELSE NULL END AS t FROM orders)
    SELECT CASE WHEN t IS NULL THEN '' WHEN contains(lower(t), 'not granted') OR contains(lower(t), 'dismissed') THEN 'denied' WHEN contains(lower(t), 'granted') THEN 'granted' WHEN contains(lower(t), 'stopped') THEN 'stopped' ELSE '' END AS outcome, count(*) AS n FROM t GROUP BY 1
""")
def outcome_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, "The claim was granted").when(k == 1, "Not granted in part").when(k == 2, "Appeal dismissed").when(k == 3, "Proceedings stopped")
    return table(spark, sf_dir, "orders").groupBy(scores.outcome(t).alias("outcome")).agg(F.count("*").alias("n"))


#: Rates by the beginning of a model's name, per million tokens; those of the default for models that none fits.
PRICES = [("Brand#1", 2.0, 1.0, 8.0), ("Brand#12", 3.0, 1.5, 12.0), ("Brand#2", 0.5, 0.25, 2.0), ("Brand#3", 1.2, 0.3, 6.0)]
DEFAULT_PRICE = ("default", 1.0, 0.5, 4.0)
_PRICES = "(VALUES " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, a, b, c in PRICES) + ") AS p(prefix, p_in, p_cached, p_out)"
_PRICED = f"""
    b AS (SELECT DISTINCT p_brand FROM part),
    m AS (SELECT p_brand, prefix, p_in, p_cached, p_out FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(prefix) DESC) AS n FROM b JOIN {_PRICES} ON starts_with(p_brand, prefix)) WHERE n = 1),
    d AS (SELECT p_brand, coalesce(prefix, 'default') AS prefix, coalesce(p_in, 1.0) AS p_in, coalesce(p_cached, 0.5) AS p_cached, coalesce(p_out, 4.0) AS p_out FROM b LEFT JOIN m USING (p_brand)),
    u AS (SELECT p_brand, count(*) AS calls, CAST(sum(l_quantity) AS BIGINT) AS tokens_in, CAST(sum(l_linenumber) AS BIGINT) AS cached, count(*) * 3 AS tokens_out FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand),
    c AS (SELECT *, ((tokens_in - cached) * p_in + cached * p_cached + tokens_out * p_out) / 1e6 AS cost FROM u JOIN d USING (p_brand))
"""


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_brand, calls, tokens_in, cached, tokens_out, prefix, cost): usage of each model at its price."""
    rates = spark.createDataFrame([*PRICES, DEFAULT_PRICE], "prefix string, p_in double, p_cached double, p_out double")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    used = rows.groupBy("p_brand").agg(F.count("*").alias("calls"), F.sum("l_quantity").cast("long").alias("tokens_in"), F.sum("l_linenumber").cast("long").alias("cached"), (F.count("*") * 3).alias("tokens_out"))
    priced = evaluate.by_longest_prefix(used, rates, "p_brand", "prefix", default="default")
    return priced.withColumn("cost", scores.token_cost(*(F.col(c) for c in ("tokens_in", "cached", "tokens_out", "p_in", "p_cached", "p_out"))))


@query(f"WITH {_PRICED} SELECT p_brand, prefix, tokens_in, cached, tokens_out, round(cost, 8) AS cost FROM c")
def usage_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by model, priced by the longest prefix of the model's name, or at the default."""
    return _used(spark, sf_dir).select("p_brand", "prefix", "tokens_in", "cached", "tokens_out", F.round("cost", 8).alias("cost"))


@query(f"""
    WITH {_PRICED}
    SELECT coalesce(p_brand, 'total') AS model, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
           CAST(sum(tokens_in) + sum(tokens_out) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost_usd, round(sum(cost) * 100, 4) AS cost_cents
    FROM c GROUP BY ROLLUP (p_brand)
""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage and cost of each model, and of all in a row of its own."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("calls", "tokens_in", "cached", "tokens_out")]
    found = _used(spark, sf_dir).rollup("p_brand").agg(F.grouping("p_brand").alias("all"), *sums, F.sum("cost").alias("cost"))
    model = F.when(F.col("all") == 1, "total").otherwise(F.col("p_brand"))
    return found.select(model.alias("model"), "calls", "tokens_in", "cached", "tokens_out", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.round("cost", 6).alias("cost_usd"), F.round(F.col("cost") * 100, 4).alias("cost_cents"))


@query("""
    WITH f AS (SELECT o_custkey, CASE WHEN o_totalprice > 450000 THEN 'high' WHEN o_totalprice > 400000 THEN 'medium' WHEN o_totalprice > 350000 THEN 'low' END AS severity FROM orders),
    c AS (SELECT o_custkey, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium, count(*) FILTER (WHERE severity = 'low') AS n_low FROM f GROUP BY o_custkey),
    s AS (SELECT *, greatest(0, 100 - 30 * n_high - 15 * n_medium - 5 * n_low) AS score FROM c)
    SELECT *, CASE WHEN n_high > 0 OR score < 60 THEN 'fail' WHEN n_high + n_medium + n_low > 0 OR score < 85 THEN 'warn' ELSE 'pass' END AS verdict FROM s
""")
def flag_score_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    flags = table(spark, sf_dir, "orders").select("o_custkey", F.when(p > 450000, "high").when(p > 400000, "medium").when(p > 350000, "low").alias("severity"))
    return verify.verdicts(flags, "o_custkey")


RULES = [("rush", "<=", 50000.0, 10), ("large", ">", 400000.0, 30), ("exact", "==", 100000.0, 5)]
_RULES = "(VALUES " + ", ".join(f"('{k}', '{o}', {t}, {p})" for k, o, t, p in RULES) + ") AS r(rule, op, threshold, priority)"


@query(f"""
    SELECT rule, op, count(*) AS n, count(*) FILTER (WHERE CASE op WHEN '<=' THEN o_totalprice <= threshold WHEN '>' THEN o_totalprice > threshold ELSE o_totalprice = threshold END) AS n_true FROM orders, {_RULES} GROUP BY rule, op
""")
def threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts against a small table of rules whose operator is data."""
    rules = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(o).alias("op"), F.lit(t).alias("threshold")) for k, o, t, _ in RULES))
    facts = table(spark, sf_dir, "orders").select("o_totalprice", F.explode(rules).alias("r")).select("o_totalprice", "r.*")
    return facts.groupBy("rule", "op").agg(F.count("*").alias("n"), F.count_if(verify.threshold_holds(F.col("o_totalprice"), F.col("op"), F.col("threshold"))).alias("n_true"))


@query(f"""
    WITH t AS (SELECT doc_id, lower(text) AS t, lang FROM documents),
    h AS (SELECT doc_id, CAST(contains(t, 'token') AS INTEGER) + CAST(contains(t, 'password') AS INTEGER) + CAST(contains(t, '@') AS INTEGER) AS hits, (contains(t, 'the') OR contains(t, 'der')) AND (contains(t, 'of') OR contains(t, 'und')) AS every, lang = 'en' AS domain FROM t),
    s AS (SELECT *, CASE WHEN hits > 0 THEN least(45, 20 + 5 * hits) ELSE 0 END + CASE WHEN every THEN 45 ELSE 0 END + CASE WHEN domain THEN 10 ELSE 0 END AS score FROM h)
    SELECT doc_id, CAST(score AS INTEGER) AS score, CAST(least(100, score + least(20, floor(120 / 10.0))) AS INTEGER) AS confidence FROM s
""")
def issue_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    hits = sum((text.holds_any(F.col("text"), [n]).cast("int") for n in ("token", "password", "@")), F.lit(0))
    score, sure = scores.issue_score(hits, text.holds_all_groups(F.col("text"), [["the", "der"], ["of", "und"]]), F.col("lang") == "en", F.lit(120))
    return d.select("doc_id", score.cast("int").alias("score"), sure.cast("int").alias("confidence"))


_SIGNALS = {"secret": ["token", "password"], "legal": ["licens", "copyright"], "contact": ["@"], "common": ["the"]}


@query(f"""
    WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t, coalesce(text, '') AS text, lang, source FROM documents),
    s AS (SELECT *, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS len, regexp_matches(t, '(article|art\\.?)[^0-9]{{0,12}}[0-9]{{1,4}}|[0-9]{{1,4}}[^0-9]{{0,12}}(article|art\\.?)') AS article,
            regexp_matches(text, '[A-Z]{{1,4}}-[0-9]{{1,5}}') AS number, length(text) - length(replace(text, '?', '')) AS marks, length(text) - length(replace(text, chr(10), '')) AS issues,
            {" + ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + " THEN 1 ELSE 0 END" for ws in _SIGNALS.values())} AS domains,
            contains(t, 'the') AND contains(t, 'of') AS both_kinds, contains(t, 'can i') OR contains(t, 'what should') AS pattern,
            CASE lang WHEN 'en' THEN 'find' WHEN 'de' THEN 'advise' WHEN 'fr' THEN 'compare' ELSE 'other' END AS mode FROM t),
    r AS (SELECT *, len <= 160 AND both_kinds AS simple FROM s),
    v AS (SELECT doc_id, greatest(0, least(100, 40 + CASE WHEN len <= 160 THEN -10 WHEN len > 500 THEN 25 WHEN len > 250 THEN 15 ELSE 8 END - CASE WHEN article THEN 18 ELSE 0 END - CASE WHEN number THEN 18 ELSE 0 END - CASE WHEN simple THEN 18 ELSE 0 END
        + CASE WHEN issues >= 3 THEN 22 WHEN issues > 0 THEN 8 ELSE 0 END + CASE WHEN domains > 1 THEN 12 ELSE 0 END + CASE WHEN both_kinds THEN 8 ELSE 0 END + CASE WHEN domains = 1 THEN -8 WHEN domains > 2 THEN 5 ELSE 0 END
        + CASE mode WHEN 'compare' THEN 15 WHEN 'advise' THEN 12 WHEN 'find' THEN -5 ELSE 0 END + CASE WHEN pattern AND NOT simple THEN 15 ELSE 0 END + CASE WHEN marks > 1 THEN 8 ELSE 0 END)) AS score FROM r)
    SELECT doc_id, CAST(score AS INTEGER) AS score, CASE WHEN score <= 30 THEN 'fast' WHEN score >= 61 THEN 'full' ELSE 'normal' END AS level FROM v
""")
def complexity_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much work a question needs; documents stand for questions, their lines for issues, languages for modes."""
    t = F.coalesce("text", F.lit(""))
    low = F.lower(t)
    length = F.length(F.btrim(t, F.lit(" \t\n\r")))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    domains = sum((text.holds_any(t, ws).cast("int") for ws in _SIGNALS.values()), F.lit(0))
    kinds = low.contains("the") & low.contains("of")
    mode = F.when(F.col("lang") == "en", "find").when(F.col("lang") == "de", "advise").when(F.col("lang") == "fr", "compare").otherwise("other")
    article = low.rlike(r"(article|art\.?)[^0-9]{0,12}[0-9]{1,4}|[0-9]{1,4}[^0-9]{0,12}(article|art\.?)")
    score, level_ = scores.complexity(length, article, t.rlike("[A-Z]{1,4}-[0-9]{1,5}"), (length <= 160) & kinds, count("\n"), F.lit(False), domains, kinds, domains, mode, low.contains("can i") | low.contains("what should"), count("?"))
    return table(spark, sf_dir, "documents").select("doc_id", score.cast("int").alias("score"), level_.alias("level"))


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus = 'P' AS outlier FROM orders),
    w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, outlier ORDER BY o_totalprice DESC, o_orderkey) AS n, max(outlier::INTEGER) OVER (PARTITION BY o_custkey) AS a FROM r)
    SELECT o_custkey, o_orderkey, outlier FROM w WHERE CASE WHEN outlier THEN n = 1 ELSE n <= 4 - a END
""")
def advocate_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top four of each group, the last place kept for the best outlier."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "P").alias("outlier"))
    return fuse.with_advocate(o, ["o_custkey"], 4, F.col("outlier"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "outlier")


def _rerank_sql(advocate: bool) -> str:
    tokens = tokens_sql("text")
    reserve = "CASE WHEN 5 - pins > 0 THEN least(n2, 1) ELSE 0 END" if advocate else "0"
    return f"""
    WITH b AS (SELECT item_id, lower(text) AS t, {tokens} AS t_ FROM benchmark), q AS (SELECT item_id, unnest(t_) AS token, len(t_) AS qn FROM b),
    d AS (SELECT doc_id, unnest({tokens}) AS token FROM documents),
    p AS (SELECT item_id, doc_id, count(*) AS shared, max(qn) AS qn FROM q JOIN d USING (token) GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared * 1.0::DOUBLE / qn DESC, doc_id) AS place FROM p WHERE shared >= 0.3 * qn),
    c AS (SELECT w.item_id, w.doc_id, place, CAST(shared AS DOUBLE) / qn AS relevance, shared * 100.0::DOUBLE / qn AS score, lower(text) = t AS same, contains(lower(text), t) AS pasted, contains(lower(text), left(t, 40)) AS exact, lang = 'en' AS card,
                 CASE WHEN quality = 1 THEN row_number() OVER (PARTITION BY w.item_id, quality ORDER BY n_chars DESC, w.doc_id) END AS asked, {"coalesce(toxic = 1, false)" if advocate else "false"} AS outlier
          FROM w JOIN documents d ON d.doc_id = w.doc_id JOIN b ON b.item_id = w.item_id LEFT JOIN labels l ON l.doc_id = w.doc_id WHERE place <= 30),
    e AS (SELECT *, card AND exact AND place <= 5 AS by_card, score >= 90 AS high FROM c),
    f AS (SELECT *, CASE WHEN same OR (pasted AND relevance >= 0.95) OR by_card OR (high AND score >= 50) THEN CASE WHEN same THEN 2 ELSE 1 END END AS priority, CASE WHEN by_card THEN place END AS pin_order FROM e),
    g AS (SELECT *, CASE WHEN priority IS NOT NULL THEN 0 WHEN outlier THEN 2 ELSE 1 END AS cls FROM f),
    h AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, least(5, count(*) FILTER (WHERE cls = 0) OVER (PARTITION BY item_id)) AS pins, count(*) FILTER (WHERE cls = 1) OVER (PARTITION BY item_id) AS n1, count(*) FILTER (WHERE cls = 2) OVER (PARTITION BY item_id) AS n2 FROM g),
    k AS (SELECT *, {reserve} AS kept FROM h),
    i AS (SELECT *, row_number() OVER (PARTITION BY item_id, cls ORDER BY priority DESC NULLS LAST, pin_order NULLS LAST, CASE WHEN cls = 0 THEN score END DESC NULLS LAST, CASE WHEN cls = 1 {"AND n1 > 5 - pins - kept" if advocate else ""} THEN asked END NULLS LAST, place) AS j FROM k),
    r AS (SELECT item_id, doc_id, CASE WHEN n <= 5 THEN row_number() OVER (PARTITION BY item_id ORDER BY place) WHEN cls = 0 THEN CASE WHEN j <= 5 THEN j END WHEN cls = 1 THEN CASE WHEN j <= 5 - pins - kept THEN pins + j END
                 ELSE CASE WHEN j = 1 AND kept > 0 THEN pins + least(n1, 5 - pins - kept) + 1 END END AS rank, priority FROM i)
    SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, priority IS NOT NULL AS pinned FROM r WHERE rank IS NOT NULL
    """


def _reranked(spark: SparkSession, sf_dir: str, advocate: bool) -> DataFrame:
    """Benchmark items ask; the plan's pool of documents by shared tokens is reranked. Labels stand for the order that a
    language model gives (good ones by length) and for minority opinions."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("asked_text"), text.tokens(F.col("text")).alias("t"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    pairs = keyword.token_overlap(items.select(F.col("item_id").alias("query_id"), F.col("t").alias("tokens")), docs, "doc_id", "text", 0.3)
    pool = fuse.top_per(pairs, ["query_id"], RetrievalPlan(k=5).pool, (F.col("shared") / F.col("query_n")).desc(), F.col("doc_id")).withColumnRenamed("rank", "place")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    c = pool.withColumnRenamed("query_id", "item_id").join(docs, "doc_id").join(items.drop("t"), "item_id").join(labels, "doc_id", "left")
    low, relevance, score = F.lower("text"), F.col("shared") / F.col("query_n"), F.col("shared") * 100.0 / F.col("query_n")
    sources = F.array_compact(F.array(F.when(low == F.col("asked_text"), "fingerprint"), F.when(low.contains(F.col("asked_text")), "pasted_text"), F.when(F.col("lang") == "en", "case_card_keyword")))
    good = Window.partitionBy("item_id", "quality").orderBy(F.desc("n_chars"), "doc_id")
    c = c.select("item_id", "doc_id", "place", sources.alias("sources"), relevance.alias("relevance"), score.alias("score"), low.contains(F.left("asked_text", F.lit(40))).alias("exact"), F.when(F.col("quality") == 1, F.row_number().over(good)).alias("asked"), (F.col("toxic") == 1).alias("outlier"))
    priority, order = fuse.pinned(F.col("sources"), F.col("relevance"), F.when(F.col("score") >= 90, "high"), F.col("score"), F.col("exact"), F.col("place"))
    c = c.withColumn("priority", priority).withColumn("pin_order", order)
    ties = [F.desc_nulls_last(F.when(F.col("priority").isNotNull(), F.col("score")))]
    found = fuse.rerank(c, ["item_id"], 5, "priority", "pin_order", ties, "place", "asked", "outlier" if advocate else None)
    return found.select("item_id", "doc_id", "rank", F.col("priority").isNotNull().alias("pinned"))


@query(_rerank_sql(False))
def pin_and_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned rows first, the rest in the order asked for."""
    return _reranked(spark, sf_dir, False)


@query(_rerank_sql(True))
def pin_and_rerank_advocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``pin_and_rerank``, with the last place for a minority opinion."""
    return _reranked(spark, sf_dir, True)


_COVERED = "CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda v: list_contains({0}, v))) / len(q) ELSE 0.0 END"


@query(f"""
    WITH b AS (SELECT item_id, {tokens_sql("text")} AS q FROM benchmark),
    s AS (SELECT source, doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE source IS NOT NULL),
    c AS (SELECT source, doc_id, {tokens_sql("substring(text, 1, 400)")} AS issue, {tokens_sql("substring(text, 401, 2000)")} AS holding, {tokens_sql("substring(text, 2401)")} AS category FROM s WHERE k = 1),
    p AS (SELECT item_id, source, doc_id, greatest({_COVERED.format("issue")}, 0.75 * {_COVERED.format("holding")}, 0.45 * {_COVERED.format("category")}) AS card, {_COVERED.format("issue")} AS hit, {_COVERED.format("holding")} AS most, {_COVERED.format("category")} AS mean FROM b, c)
    SELECT item_id, source, doc_id, round(card, 6)::DOUBLE AS card,
           round(greatest(0.7::DOUBLE * most + 0.3::DOUBLE * mean, CASE WHEN hit > 0 THEN least(1.0::DOUBLE, 1.15::DOUBLE * hit) END, CASE WHEN card > 0 THEN least(1.0::DOUBLE, 0.62::DOUBLE + 0.34::DOUBLE * card) END), 6) AS score
    FROM p WHERE card > 0.2::DOUBLE
""")
def card_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against each source's longest document as its card (issue, holding and category are its parts):
    the card's score, and the parent's from all its branches. The cards are one a source, so they are broadcast."""
    items = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("q"))
    docs = table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    longest = docs.groupBy("source").agg(F.max_by(F.struct("doc_id", "text"), F.struct("n_chars", -F.col("doc_id"))).alias("c")).select("source", "c.*")
    part = lambda a, n: text.tokens(F.substring("text", a, n))
    cards = longest.select("source", "doc_id", part(1, 400).alias("issue"), part(401, 2000).alias("holding"), part(2401, 1 << 30).alias("category"))
    asked = items.select("item_id", "q", F.explode("q").alias("token"))
    every = cards.select("source", F.explode(F.array_union(F.array_union("issue", "holding"), "category")).alias("token"))
    pairs = asked.join(every, "token").select("item_id", "source").distinct()  # a pair without a common token scores nothing
    told = pairs.join(items, "item_id").join(keyword.small(cards), "source")
    covered = lambda c: scores.coverage(F.col("q"), F.col(c))
    told = told.withColumn("card", scores.card_score(*(F.col(c) for c in ("q", "issue", "holding", "category")))).where("card > 0.2")
    score = scores.parent_score(covered("holding"), covered("category"), covered("issue"), F.col("card"))
    return told.select("item_id", "source", "doc_id", F.round("card", 6).alias("card"), F.round(score, 6).alias("score"))


QUERIES, ORACLE_SQL = query.queries, query.sql
