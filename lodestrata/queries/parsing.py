"""Parsing of questions, contexts and reviews over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunkers, parsing, rules, text
from ..operators import verify
from .registry import Registry, table

query = Registry()
COURTS = [("src1", "supreme"), ("src2", "appeal"), ("src", "city")]
ANCHORS = {"code": "code", "codes": "code", "act": "act"}

#: A question about each document: its first words, and a law, an article, a number and years by its columns.
_QUESTION = """(left(coalesce(text, ''), 40) || ' ' || source || CASE WHEN lang = 'en' THEN ' the Tax Codes article ' || (n_chars % 90) WHEN lang = 'de' THEN ' ' || (n_chars % 90) || 'th article of the old civil Act' ELSE '' END
    || CASE WHEN n_chars % 2 = 0 THEN ' case ' || upper(lang) || '-' || doc_id || ' (' || source || ')' ELSE '' END || CASE WHEN lang = 'fr' THEN ' ' || (1980 + n_chars % 50) || ' - ' || (2000 + n_chars % 30) ELSE ' since ' || (1985 + n_chars % 50) END
    || CASE WHEN n_chars % 3 = 0 THEN ' no. ' || (10000 + doc_id) || '/' || (10 + n_chars % 80) || ' judge Ann Marie' ELSE '' END)"""


def _question() -> Column:
    n, lang, source, doc_id = F.col("n_chars"), F.col("lang"), F.col("source"), F.col("doc_id")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    law = F.when(lang == "en", join(" the Tax Codes article ", n % 90)).when(lang == "de", join(" ", n % 90, "th article of the old civil Act")).otherwise("")
    case = F.when(n % 2 == 0, join(" case ", F.upper(lang), "-", doc_id, " (", source, ")")).otherwise("")
    years = F.when(lang == "fr", join(" ", 1980 + n % 50, " - ", 2000 + n % 30)).otherwise(join(" since ", 1985 + n % 50))
    more = F.when(n % 3 == 0, join(" no. ", 10000 + doc_id, "/", 10 + n % 80, " judge Ann Marie")).otherwise("")
    return F.concat(F.left(F.coalesce("text", F.lit("")), F.lit(40)), F.lit(" "), source, law, case, years, more)


@query(rf"""
    WITH q AS (SELECT doc_id, {_QUESTION} AS q FROM documents),
    y AS (SELECT *, nullif(regexp_extract(q, '\b((?:19|20)[0-9]{{2}})[ \t\n\r\f]*[-–][ \t\n\r\f]*((?:19|20)[0-9]{{2}})\b', 0), '') AS both_, regexp_extract(q, '\b((?:19|20)[0-9]{{2}})[ \t\n\r\f]*[-–][ \t\n\r\f]*((?:19|20)[0-9]{{2}})\b', 1) AS a, regexp_extract(q, '\b((?:19|20)[0-9]{{2}})[ \t\n\r\f]*[-–][ \t\n\r\f]*((?:19|20)[0-9]{{2}})\b', 2) AS b,
                 regexp_extract(q, '\b((?:19|20)[0-9]{{2}})\b', 1) AS one, lower(q) AS low FROM q),
    z AS (SELECT *, TRY_CAST(nullif(CASE WHEN both_ IS NOT NULL THEN a ELSE one END, '') AS INTEGER) AS f, TRY_CAST(nullif(b, '') AS INTEGER) AS t FROM y)
    SELECT doc_id, nullif(trim(regexp_extract(q, '[A-Z]{{1,4}}[-/][0-9]+(?:[ \t\n\r\f]*\([^)]+\))?')), '') AS case_number, CASE WHEN f BETWEEN 1990 AND 2026 THEN f END AS year_from, CASE WHEN t BETWEEN 1990 AND 2026 THEN t END AS year_to,
           CASE WHEN contains(low, 'src1') THEN 'supreme' WHEN contains(low, 'src2') THEN 'appeal' WHEN contains(low, 'src') THEN 'city' END AS court, CASE WHEN contains(q, 'judge Ann Marie') THEN 'Ann Marie' END AS judge,
           coalesce(nullif(regexp_extract(low, 'article[ \t\n\r\f]+([0-9]+)', 1), ''), nullif(regexp_extract(low, '([0-9]+)[–-]?(?:st|nd|rd|th)?[ \t\n\r\f]*article', 1), '')) AS article, nullif(regexp_extract(q, '\b([0-9]{{4,6}}/[0-9]{{2,4}})\b', 1), '') AS application
    FROM z
""")
def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question states: case number, years, court, judge, article, application number."""
    d = table(spark, sf_dir, "documents").select("doc_id", _question().alias("q"))
    q = F.col("q")
    year_from, year_to = parsing.year_range(q, 2026)
    return d.select("doc_id", parsing.case_number(q).alias("case_number"), year_from.alias("year_from"), year_to.alias("year_to"), parsing.first_named(q, COURTS).alias("court"), parsing.judge(q).alias("judge"), parsing.article_number(q).alias("article"), parsing.application_number(q).alias("application"))


@query(f"""
    WITH q AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(trim({_QUESTION})), '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS ws FROM documents),
    a AS (SELECT *, list_position(list_transform(ws, lambda w: w IN ('code', 'codes', 'act')), true) AS i FROM q),
    b AS (SELECT *, CASE ws[i] WHEN 'codes' THEN 'code' ELSE ws[i] END AS base, list_filter(ws[greatest(i - 3, 1) : i - 1], lambda w: w NOT IN ('the', 'of')) AS before FROM a)
    SELECT doc_id, CASE WHEN i > 0 THEN CASE WHEN len(before) = 0 THEN base ELSE array_to_string(list_transform(list_concat(before, [base]), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') END END AS law FROM b
""")
def query_law_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law that a question names: up to three words before the kind of law."""
    return table(spark, sf_dir, "documents").select("doc_id", parsing.law_name(_question(), ANCHORS, ("the", "of")).alias("law"))


_LEVELS = [("gold", 1), ("red", 2), ("promo", 4)]


@query("""
    SELECT p_partkey, CAST(CASE WHEN contains(lower(p_type || ' ' || p_name), 'gold') THEN 1 WHEN contains(lower(p_type || ' ' || p_name), 'red') THEN 2 WHEN contains(lower(p_type || ' ' || p_name), 'promo') THEN 4 ELSE 3 END AS INTEGER) AS level,
           CAST(CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'box') THEN 2 ELSE 1 END AS INTEGER) AS specificity FROM part
""")
def law_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level in the hierarchy and specificity by keywords of category and title."""
    return table(spark, sf_dir, "part").select("p_partkey", parsing.hierarchy_level(F.col("p_type"), F.col("p_name"), _LEVELS).alias("level"), parsing.specificity_level(F.col("p_name"), ["ring", "box"]).alias("specificity"))


@query("""
    SELECT year, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) BETWEEN 1993 AND 1997 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders) GROUP BY year
""")
def effective_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(parsing.effective_year(F.date_format("o_orderdate", "yyyy-MM-dd"), 1997, 1993).alias("year")).agg(F.count("*").alias("n"))


CUES = ["the issue", "key question"]
_NOTE = """CASE doc_id % 4 WHEN 0 THEN 'Facts' || chr(10) || 'The issue is: ' || coalesce(left(text, 60), '') || ' Category: x' WHEN 1 THEN 'Key question' || chr(10) || chr(10) || '  ' || coalesce(left(text, 90), '') WHEN 2 THEN coalesce(text, '') ELSE 'Key question:' END"""


@query(rf"""
    WITH n AS (SELECT doc_id, {_NOTE} AS note, lang FROM documents),
    l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(note, '\r\n|[\n\x0B\f\r]'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11))), lambda s: s <> '') AS ls FROM n),
    p AS (SELECT *, list_position(list_transform(ls, lambda s: contains(lower(s), 'the issue') OR contains(lower(s), 'key question')), true) AS i FROM l),
    b AS (SELECT *, trim(regexp_extract(ls[i], '^[^:：]*[:：](.*)$', 1), ' ' || chr(9) || chr(10) || chr(13)) AS behind FROM p),
    r AS (SELECT *, trim(regexp_replace(CASE WHEN i > 0 THEN CASE WHEN behind <> '' THEN behind ELSE ls[i + 1] END END, '[ \t\n\r\f]*Category:.*', ''), ' ' || chr(9)) AS issue FROM b),
    f AS (SELECT *, lower(trim(regexp_replace(coalesce(issue, ''), '[ \t\n\r\f]+', ' ', 'g'), ' ')) AS fi, lower(trim(regexp_replace(note, '[ \t\n\r\f]+', ' ', 'g'), ' ')) AS fq, length(trim(note, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11))) AS nq, length(coalesce(issue, '')) AS ni FROM r)
    SELECT doc_id, md5(issue) AS issue_md5, fi <> '' AND fi <> fq AND NOT (nq <= 500 AND lang <> 'en') AND ni <= greatest(700, floor(nq * 0.85)) AS focused FROM f
""")
def focused_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled issue in a note, and whether it replaces the note as the query; English notes stand for hard ones."""
    k, t = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    note = F.when(k == 0, F.concat(F.lit("Facts\nThe issue is: "), F.left(t, F.lit(60)), F.lit(" Category: x"))).when(k == 1, F.concat(F.lit("Key question\n\n  "), F.left(t, F.lit(90)))).when(k == 2, t).otherwise("Key question:")
    d = table(spark, sf_dir, "documents").select("doc_id", note.alias("note"), F.when(F.col("lang") == "en", "full").otherwise("normal").alias("level"))
    d = d.withColumn("issue", parsing.labelled_issue(F.col("note"), CUES, "Category:"))
    return d.select("doc_id", F.md5("issue").alias("issue_md5"), parsing.use_focused(F.col("note"), F.col("issue"), F.col("level")).alias("focused"))


@query("""
    WITH c AS (SELECT d.doc_id, coalesce(text, '') AS whole, CASE WHEN quality = 1 THEN left(coalesce(text, ''), 900) ELSE '' END AS excerpt, toxic = 1 AS supporting, CASE lang WHEN 'en' THEN 'explain' WHEN 'de' THEN 'summarize' WHEN 'fr' THEN 'compare' ELSE 'find' END AS mode, 1 + n_chars % 6 AS total FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    m AS (SELECT *, CASE WHEN excerpt <> '' THEN excerpt ELSE whole END AS matched, CASE WHEN length(whole) > 7000 THEN 'TRUNCATED' ELSE 'FULL' END AS size FROM c),
    s AS (SELECT doc_id, CASE WHEN supporting THEN left(matched, CASE WHEN mode = 'find' THEN 1200 ELSE 2000 END) WHEN mode = 'find' OR total > 5 THEN left(matched, 1200) WHEN total > 3 AND mode <> 'summarize' THEN left(matched, 7000)
            WHEN mode = 'summarize' THEN left(whole, 7000) WHEN mode = 'compare' THEN left(matched, CASE WHEN total <= 2 THEN 3500 ELSE 2000 END) WHEN excerpt <> '' THEN excerpt || CASE WHEN whole <> '' THEN chr(10) || chr(10) || '---' || chr(10) || left(whole, 7000 - length(excerpt)) ELSE '' END ELSE left(matched, 7000) END AS context,
            CASE WHEN supporting THEN 'SUPPORTING-COMPACT' WHEN mode = 'find' OR total > 5 THEN 'COMPACT' WHEN total > 3 AND mode <> 'summarize' THEN 'PRIMARY-CONTEXT' WHEN mode = 'summarize' THEN size WHEN mode = 'compare' THEN 'COMPARE' WHEN excerpt <> '' THEN 'MATCHED+CONTEXT' ELSE size END AS strategy FROM m)
    SELECT doc_id, strategy, CAST(length(context) AS INTEGER) AS n_chars, md5(context) AS context_md5 FROM s
""")
def context_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a document goes into an answer's context."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    mode = F.when(F.col("lang") == "en", "explain").when(F.col("lang") == "de", "summarize").when(F.col("lang") == "fr", "compare").otherwise("find")
    excerpt = F.when(F.col("quality") == 1, F.left(F.coalesce("text", F.lit("")), F.lit(900)))
    context, name = parsing.context_text(excerpt, F.col("text"), F.when(F.col("toxic") == 1, "supporting"), mode, 1 + F.col("n_chars") % 6)
    return d.select("doc_id", name.alias("strategy"), context.alias("t")).select("doc_id", "strategy", F.length("t").alias("n_chars"), F.md5("t").alias("context_md5"))


TEMPLATES = {"large": "Case:\nThe issue is: {query}{category}\n\nTask:\n1. Name the issue.\n2. Find sources.\n", "full": "Whole case:\n{query}{category}\n\nMore facts:\nLetters were sent.\n"}
_FILL = {k: "'" + v.replace("{query}", "' || q || '").replace("{category}", "' || c || '").replace("\n", "' || chr(10) || '") + "'" for k, v in TEMPLATES.items()}


@query(f"""
    WITH b AS (SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS q, CASE WHEN item_id % 3 = 0 THEN '' ELSE chr(10) || 'Category: c' || (item_id % 7) END AS c FROM benchmark)
    SELECT item_id, 'gold' AS style, md5(q) AS query_md5 FROM b UNION ALL SELECT item_id, 'large', md5(trim({_FILL["large"]}, ' ' || chr(10))) FROM b UNION ALL SELECT item_id, 'full', md5(trim({_FILL["full"]}, ' ' || chr(10))) FROM b
""")
def query_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item in three styles."""
    styles = F.explode(F.array(*(F.lit(s) for s in ("gold", *TEMPLATES)))).alias("style")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", styles)
    category = F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string")))
    return b.select("item_id", "style", F.md5(parsing.styled(F.col("text"), F.col("style"), TEMPLATES, category)).alias("query_md5"))


_LABELS = {"F": "final", "O": "open"}


@query("""
    WITH i AS (SELECT o_custkey, list_sort(list(DISTINCT CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END)) AS labels, count(*) FILTER (WHERE o_totalprice > 300000) > 0 AS high, count(*) FILTER (WHERE o_orderpriority LIKE '1%') > 0 AS urgent FROM orders GROUP BY o_custkey)
    SELECT o_custkey, array_to_string(labels, ',') AS labels, array_to_string(list_filter([CASE WHEN high THEN 'high' END, CASE WHEN urgent THEN 'urgent' END], lambda x: x IS NOT NULL), ',') AS sources FROM i
""")
def label_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all of a group's values, each once, and which of its flags are set."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(parsing.labels(F.col("o_orderstatus"), _LABELS))).alias("l"), F.bool_or(F.col("o_totalprice") > 300000).alias("high"), F.bool_or(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    return g.select("o_custkey", F.array_join("l", ",").alias("labels"), F.array_join(parsing.active({"high": F.col("high"), "urgent": F.col("urgent")}), ",").alias("sources"))


@query("""
    WITH l AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events), u AS (SELECT DISTINCT user_id FROM events)
    SELECT user_id FROM u LEFT JOIN l USING (user_id), n WHERE ts IS NULL OR floor((epoch(now) - epoch(ts)) / 86400) >= 1
""")
def due_for_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without a good event within the last day before the stream's end."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("ts"))
    return last.where(parsing.due(F.col("ts"), e.agg(F.max("ts")).scalar(), 1)).select("user_id")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) % 13 AS score, CASE l_returnflag WHEN 'A' THEN 'correct' WHEN 'R' THEN 'unsafe' ELSE l_returnflag END AS verdict FROM lineitem)
    SELECT array_to_string(list_filter([CASE WHEN score IS NULL OR NOT score BETWEEN 1 AND 10 THEN 'overall_score' END, CASE WHEN verdict IS NULL OR verdict NOT IN ('correct', 'mostly_correct', 'partially_correct', 'incorrect', 'unsafe') THEN 'verdict' END], lambda x: x IS NOT NULL), ',') AS faults, count(*) AS n FROM r GROUP BY 1
""")
def review_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by what is wrong with them."""
    r = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") % 13).alias("score"), F.when(F.col("l_returnflag") == "A", "correct").when(F.col("l_returnflag") == "R", "unsafe").otherwise(F.col("l_returnflag")).alias("verdict"))
    faults = parsing.review_faults({"overall_score": F.col("score"), "verdict": F.col("verdict")})
    return r.groupBy(F.array_join(faults, ",").alias("faults")).agg(F.count("*").alias("n"))


#: (flag, severity, anchor, phrase, within, excuse)
RULES = [
    ("overclaim", "high", "the", "always|never|all", 40, ""),
    ("unsourced", "medium", "token|password", "[0-9]{3}", 60, "copyright|licen[sc]e"),
    ("vague", "low", "de|und", "que|oder", 20, ""),
    ("stale", "medium", "licen[sc]e", "(?:19|20)[0-9]{2}", 80, ""),
    ("contact", "high", "@", "[0-9]{3}-[0-9]{4}", 200, "rights reserved"),
    ("leak", "high", "secret|api_?key", "[a-z0-9]{16}", 30, ""),
    ("address", "low", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "[(][0-9]{3}[)]", 400, "token"),
    ("denial", "medium", "der|die", "nicht|kein", 40, ""),
    ("hedge", "low", "el|los", "no|nunca", 25, "licen[sc]e"),
]


def _flag_sql(flag: str, severity: str, anchor: str, phrase: str, within: int, excuse: str) -> str:
    near = f"regexp_matches(t, '(?s)(?:{anchor}).{{0,{within}}}(?:{phrase})|(?:{phrase}).{{0,{within}}}(?:{anchor})')"
    return f"SELECT doc_id, '{flag}' AS flag, '{severity}' AS severity FROM t WHERE {near}" + (f" AND NOT regexp_matches(t, '{excuse}')" if excuse else "")


@query(f"WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) {' UNION ALL '.join(_flag_sql(*r) for r in RULES)}")
def phrase_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by phrases near each other, from a table of rules."""
    return verify.phrase_flags(table(spark, sf_dir, "documents"), "doc_id", "text", RULES)


@query("""
    SELECT conv_id, count(*) FILTER (WHERE role <> 'user') AS n_answers, CAST(sum(len(regexp_extract_all(text, 'http[^ ]+|[A-Z][a-z]{6,}'))) AS BIGINT) AS n_sources FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id HAVING sum(len(regexp_extract_all(text, 'http[^ ]+|[A-Z][a-z]{6,}'))) > 0
""")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an owner's conversations (odd numbers): how many sources their messages name; those without any go."""
    own = table(spark, sf_dir, "conversations").where("conv_id % 2 = 1")
    n = F.sum(F.size(F.regexp_extract_all("text", F.lit("http[^ ]+|[A-Z][a-z]{6,}"), F.lit(0)))).cast("long")
    return own.groupBy("conv_id").agg(F.count_if(F.col("role") != "user").alias("n_answers"), n.alias("n_sources")).where("n_sources > 0")


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"


@query(rf"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<sup[^>]*>([0-9]+)</sup>', '^\1', 'g'), '(?i)</?(p|div|br|li|tr|h[1-6])[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a),
    c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ 	]+', ' ', 'g'), '
{{3,}}', chr(10) || chr(10), 'g'), {_BLANK}) AS t FROM b)
    SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM c
""")
def page_rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text with their lines. (No page has words in single letters, which SQL could not join.)"""
    found = table(spark, sf_dir, "pages").select("page_id", text.rich_text(F.col("html")).alias("t"))
    return found.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query("""
    WITH o AS (SELECT o_orderkey, 'placed, ' || strftime(o_orderdate, '%d/%m/%Y') || ', no. ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ', changed 1/2/' || (year(o_orderdate) + 1) ELSE '' END AS t, o_orderdate FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (year(o_orderdate) + 1) || '-02-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dated FROM o
""")
def last_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last date that a note names."""
    changed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(", changed 1/2/"), (F.year("o_orderdate") + 1).cast("string"))).otherwise("")
    note = F.concat(F.lit("placed, "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(", no. "), F.col("o_custkey").cast("string"), changed)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.last_date(note).alias("dated"))


@query(f"""
    WITH c AS (SELECT doc_id, unnest(range(0, length(text), 2000)) AS start, text FROM documents), t AS (SELECT doc_id, start, trim(substring(text, start + 1, 2000), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS content FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) AS INTEGER) AS part, md5(content) AS content_md5 FROM t WHERE length(content) >= 30
""")
def doc_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces without overlap, numbered without gaps."""
    return text.numbered_parts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "part", F.md5("content").alias("content_md5"))


@query(r"""
    WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'), ' ')), lambda x: length(x) >= 20) AS ls FROM documents),
    r AS (
        SELECT doc_id, ls, 0 AS i, CAST('' AS VARCHAR) AS buffer, CAST(NULL AS VARCHAR) AS done FROM p
        UNION ALL
        SELECT doc_id, ls, i + 1, CASE WHEN length(buffer) + 1 + length(ls[i + 1]) >= 2000 THEN '' ELSE buffer || ' ' || ls[i + 1] END, CASE WHEN length(buffer) + 1 + length(ls[i + 1]) >= 2000 THEN trim(buffer || ' ' || ls[i + 1], ' ') END FROM r WHERE i < len(ls)),
    c AS (SELECT doc_id, i, done AS content FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, trim(buffer, ' ') FROM r WHERE i = len(ls) AND length(trim(buffer, ' ')) > 50)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, md5(content) AS content_md5 FROM c
""")
def doc_buffered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs gathered to some 2000 characters; each sentence stands for a paragraph."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n")))
    return chunkers.chunk_with(docs, chunkers.buffered_paragraphs, "doc_id", "text").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


TAGS = [("annul", ["license", "copyright"]), ("damages", ["token", "password"]), ("order", ["the", "und", "que"]), ("stay", ["@"])]


@query(f"""
    WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
    SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {(' AND ' if k == 'order' else ' OR ').join(chr(99) + f'ontains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}' END" for k, ws in TAGS)}], lambda x: x IS NOT NULL), ',') AS tags FROM t
""")
def outcome_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the outcomes and stages that a text speaks of; one needs all its needles."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rules.tagged(F.col("text"), TAGS, ("order",)), ",").alias("tags"))


@query()
def attributed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in texts with the nearest keyword before them; tested against a plain version."""
    kinds = [("counter", ("und", "token", "onthe")), ("main", ("de", "the", "password"))]
    return rules.extract_claims(table(spark, sf_dir, "documents"), "doc_id", "text", currency=("a", "e"), context=("the", "de", "que"), kinds=kinds, default="claim")


#: What an issue (an order's priority) is expected to rest on: laws (return flags) and their articles (line numbers).
EXPECTED = [("1-URGENT", "A", 1), ("1-URGENT", "A", 2), ("1-URGENT", "R", None), ("2-HIGH", "N", 1), ("2-HIGH", "N", 3), ("3-MEDIUM", "A", None), ("5-LOW", "R", 2), ("5-LOW", "R", 4), ("5-LOW", "R", 5)]
_EXPECTED = "(VALUES " + ", ".join(f"('{i}', '{law}', {'NULL::INTEGER' if a is None else a})" for i, law, a in EXPECTED) + ") AS x(issue, law, article)"


@query(f"""
    WITH i AS (SELECT DISTINCT o_orderkey AS key, o_orderpriority AS issue FROM orders),
    f AS (SELECT DISTINCT l_orderkey AS key, l_returnflag AS law, l_linenumber AS article FROM lineitem),
    w AS (SELECT key, i.issue, law, article FROM i JOIN {_EXPECTED} ON x.issue = i.issue),
    m AS (SELECT w.*, EXISTS (SELECT 1 FROM f WHERE f.key = w.key AND f.law = w.law) AS any_, EXISTS (SELECT 1 FROM f WHERE f.key = w.key AND f.law = w.law AND f.article = w.article) AS hit FROM w)
    SELECT key, issue, law, coalesce(string_agg(article, ',' ORDER BY article) FILTER (WHERE article IS NOT NULL), '') AS missing FROM m WHERE CASE WHEN article IS NULL THEN NOT any_ ELSE NOT hit END GROUP BY key, issue, law
""")
def source_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was expected by issue and not found: articles of a law, or a law as a whole."""
    issues = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("issue"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("law"), F.col("l_linenumber").alias("article"))
    gaps = rules.coverage_gaps(issues, found, spark.createDataFrame(EXPECTED, "issue string, law string, article int"))
    return gaps.select("key", "issue", "law", F.array_join(F.transform("missing", lambda a: a.cast("string")), ",").alias("missing"))


UNITS = {"day": ("day", "days"), "month": ("month", "months"), "week": ("week", "weeks")}
DEADLINES = [("appeal", ("appeal", "review")), ("limitation", ("lapse", "limitation")), ("response", ("answer", "defence"))]


@query("""
    WITH t AS (SELECT o_orderkey, (ARRAY['An appeal lies within ', 'Claims lapse after ', 'The defence is due in ', 'Goods are shipped in '])[o_custkey % 4 + 1] AS a, ' of delivery. ' || repeat('Further terms are in the annex. ', 4) || 'The price is ' || CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) || ' and delivery takes ' AS b, 2 + o_custkey % 90 AS n, 1 + o_orderkey % 40 AS m FROM orders),
    u AS (SELECT *, length(a || n || ' days' || b) AS second FROM t)
    SELECT o_orderkey, CASE WHEN starts_with(a, 'An') THEN 'appeal' WHEN starts_with(a, 'Cl') THEN 'limitation' WHEN starts_with(a, 'The') THEN 'response' ELSE 'procedural' END AS kind, CAST(n AS BIGINT) AS value, 'day' AS unit, CAST(length(a) AS INTEGER) AS "offset" FROM u
    UNION ALL SELECT o_orderkey, 'procedural', CAST(m AS BIGINT), 'week', CAST(second AS INTEGER) FROM u
""")
def deadline_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines in the orders' terms and what they are for, by the words around them."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 4
    first = F.when(k == 0, "An appeal lies within ").when(k == 1, "Claims lapse after ").when(k == 2, "The defence is due in ").otherwise("Goods are shipped in ")
    between = F.concat(F.lit(" of delivery. " + "Further terms are in the annex. " * 4 + "The price is "), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(" and delivery takes "))
    terms = F.concat(first, (2 + F.col("o_custkey") % 90).cast("string"), F.lit(" days"), between, (1 + F.col("o_orderkey") % 40).cast("string"), F.lit("-weeks."))
    return rules.extract_deadlines(o.select("o_orderkey", terms.alias("terms")), "o_orderkey", "terms", units=UNITS, kinds=DEADLINES, default="procedural")


QUERIES, ORACLE_SQL = query.queries, query.sql
