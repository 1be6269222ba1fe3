"""Chunking, tokens, keyword search and text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunkers, text
from ..operators import fuse, keyword, verify
from ..sources import markup, readers
from ..storage import cut
from .registry import Registry, table

query = Registry()
WHITE = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def runs_sql(column: str, which: str = "w <> ''") -> str:
    parts = f"regexp_split_to_array(lower(replace(coalesce({column}, ''), chr(160), ' ')), '[^\\p{{L}}\\p{{N}}/.\\-]+')"
    return f"list_filter(list_transform({parts}, lambda w: trim(w, '.')), lambda w: {which})"


def meaningful_sql(column: str) -> str:
    return runs_sql(column, f"length(w) >= 4 AND w NOT IN ({STOP})")


def windows_sql(tokens: str = "w") -> str:
    last = f"greatest(len({tokens}) - 7, 0)"
    return f"list_distinct([0, least(8, {last}), least(18, {last}), CAST(floor({last} * 0.45) AS INTEGER), CAST(floor({last} * 0.70) AS INTEGER)])"


BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"


def tokens_sql(column: str) -> str:
    return f"list_distinct(list_filter({words_sql(column)}, lambda w: length(w) >= 4 AND w NOT IN ({STOP})))"


@query(f"""
    WITH c AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS chunk_index, unnest(s) AS start, text FROM (SELECT doc_id, text, range(0, length(text), 1300) AS s FROM documents)),
    t AS (SELECT doc_id, chunk_index, trim(substring(text, start + 1, 1500), {WHITE}) AS content FROM c)
    SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5 FROM t WHERE length(content) >= 1
""")
def doc_chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query(f"""
    WITH c AS (SELECT doc_id, unnest(CASE WHEN length(text) <= 1000 THEN range(0, least(1, length(text))) ELSE range(0, length(text), 850) END) AS start, text FROM documents),
    t AS (SELECT doc_id, trim(substring(text, start + 1, 1000), {WHITE}) AS content FROM c)
    SELECT doc_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars FROM t WHERE length(content) >= 50 GROUP BY doc_id
""")
def doc_chunks_with_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 150, least=50, one_if_short=True)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content").cast("long")).alias("n_chars"))


@query("""
    SELECT doc_id, CAST(ceil(length(text) / 700.0) AS BIGINT) AS n_chunks, md5(text) AS content_md5 FROM documents WHERE length(text) > 0
""")
def doc_chunk_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut without overlap and joined again in order: the text as it was."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(700))
    pieces = docs.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(700)))).alias("i", "piece"))
    whole = readers.document(pieces, "doc_id", "i", "piece", "")
    counts = pieces.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return whole.join(counts, "doc_id").select("doc_id", "n_chunks", F.md5("content").alias("content_md5"))


def _end_sql() -> str:
    """Where a window of 1500 characters is cut, counted from its end: sentence ends in order, in its last 600 only."""
    marks = ["chr(10) || chr(10)", *("'" + m[::-1] + "'" for m in chunkers.SENTENCE_ENDS), "chr(10)"]
    sizes = [2, *map(len, chunkers.SENTENCE_ENDS), 1]
    return "CASE " + " ".join(f"WHEN strpos(reverse(w), {m}) BETWEEN 1 AND {601 - n} THEN 1501 - strpos(reverse(w), {m})" for m, n in zip(marks, sizes, strict=True)) + " ELSE 1500 END"


@query(f"""
    WITH RECURSIVE r AS (
        SELECT doc_id, text, 0 AS pos, CAST(NULL AS VARCHAR) AS piece, CAST(-1 AS INTEGER) AS came_from FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, text, CAST(pos + greatest(100, length(p) - 300) AS INTEGER), p, CAST(pos AS INTEGER)
        FROM (SELECT *, trim(CASE WHEN pos + 1500 < length(text) THEN left(w, {_end_sql()}) ELSE w END, {BLANK}) AS p FROM (SELECT *, substring(text, pos + 1, 1500) AS w FROM r WHERE pos < length(text))))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY came_from) - 1 AS INTEGER) AS chunk_index, CAST(length(piece) AS INTEGER) AS n_chars, md5(piece) AS content_md5 FROM r WHERE length(piece) > 20
""")
def doc_chunks_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's end depends on the one before; the SQL steps through a text by recursion."""
    return chunkers.chunk_with(table(spark, sf_dir, "documents"), chunkers.sentence_chunks, "doc_id", "text").select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query(f"""
    WITH RECURSIVE t AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents),
    p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: trim(x, {BLANK})), lambda x: x <> '') AS ps FROM t WHERE length(text) >= 100),
    r AS (
        SELECT doc_id, ps, 0 AS i, CAST('' AS VARCHAR) AS buffer, CAST(NULL AS VARCHAR) AS done FROM p
        UNION ALL
        SELECT doc_id, ps, i + 1, CASE WHEN buffer = '' THEN ps[i + 1] WHEN length(buffer) + length(ps[i + 1]) > 800 THEN right(buffer, 80) || chr(10) || ps[i + 1] ELSE buffer || chr(10) || chr(10) || ps[i + 1] END,
               CASE WHEN buffer <> '' AND length(buffer) + length(ps[i + 1]) > 800 THEN buffer END
        FROM r WHERE i < len(ps)),
    c AS (SELECT doc_id, i, done AS content FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, buffer FROM r WHERE i = len(ps) AND buffer <> '' UNION ALL SELECT doc_id, 0, coalesce(text, '') FROM t WHERE coalesce(length(text), 0) < 100)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5 FROM c
""")
def doc_chunks_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts have no blank lines; each sentence stands for a paragraph."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return chunkers.chunk_with(docs, chunkers.packed_paragraphs, "doc_id", "text").select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query(f"""
    WITH c AS (SELECT doc_id, text, unnest(CASE WHEN length(text) > 750 THEN range(0, length(text), 650) ELSE [0] END) AS start FROM documents WHERE text IS NOT NULL)
    SELECT CAST(doc_id AS VARCHAR) || CASE WHEN start > 0 THEN '.' || (start // 650 + 1) ELSE '' END AS part_id, md5(CASE WHEN length(text) > 750 THEN trim(substring(text, start + 1, 750), {BLANK}) ELSE text END) AS content_md5 FROM c
""")
def doc_sub_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sub_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("part_id", F.md5("content").alias("content_md5"))


_STEM = "CASE " + " ".join(f"WHEN word LIKE '%{s}' AND length(word) >= {len(s) + 3} THEN left(word, length(word) - {len(s)})" for s in text.SUFFIXES) + " ELSE word END"


@query(f"""
    WITH w AS (SELECT unnest({words_sql("text")}) AS word, lang FROM documents),
    s AS (SELECT {_STEM} AS root, word, lang FROM w WHERE length(word) >= 4)
    SELECT root, count(*) AS n, arg_min(word, (length(word), word)) AS form, bool_or(lang = 'en') AS in_en, bool_or(lang <> 'en') AS in_other
    FROM s WHERE length(root) >= 3 GROUP BY root HAVING count(*) >= 20
""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems with their counts and shortest form; frequent ones. Counted before the shuffle."""
    found = table(spark, sf_dir, "documents").select("lang", F.explode_outer(text.words(F.col("text"))).alias("word")).where(F.length("word") >= 4)
    counted = found.groupBy("word").agg(F.count("*").alias("n"), F.bool_or(F.col("lang") == "en").alias("in_en"), F.bool_or(F.col("lang") != "en").alias("in_other"))
    roots = counted.withColumn("root", text.stem(F.col("word"))).where(F.length("root") >= 3)
    return roots.groupBy("root").agg(F.sum("n").alias("n"), F.min_by("word", F.struct(F.length("word"), "word")).alias("form"), F.bool_or("in_en").alias("in_en"), F.bool_or("in_other").alias("in_other")).where("n >= 20")


PHRASES = ["the thing", "license", "copyright", "de la", "und die", "token"]
_HITS = " + ".join(f"CASE WHEN contains(lower(left(text, 80)), '{p}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), '{p}') THEN 1 ELSE 0 END" for p in PHRASES)


@query(f"""
    WITH s AS (SELECT doc_id, source, {_HITS} AS hits, CASE WHEN contains(lower(left(text, 80)), 'copyright') THEN 0.35 WHEN contains(lower(left(text, 80)), 'licens') THEN 1.08 ELSE 1.0 END AS quality FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits * quality DESC, doc_id) AS n FROM s WHERE hits > 0)
    SELECT source, doc_id, CAST(hits AS INTEGER) AS hits, CAST(quality AS DOUBLE) AS quality, round(least(0.58, 0.30 + 0.06 * hits * quality), 6)::DOUBLE AS score FROM r WHERE n = 1
""")
def keyword_score_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase hits in the head and the text, times the head's quality; the best document of each source."""
    docs = table(spark, sf_dir, "documents")
    title = F.substring("text", 1, 80)
    rows = docs.select("source", "doc_id", keyword.phrase_hits(title, F.col("text"), PHRASES).alias("hits"), keyword.title_quality(title, "licens", "copyright").alias("quality")).where("hits > 0")
    best = keyword.best_per(rows, "source", (F.col("hits") * F.col("quality")).desc(), F.col("doc_id"))
    return best.select("source", "doc_id", "hits", "quality", F.round(keyword.keyword_rank(F.col("hits") * F.col("quality")), 6).alias("score"))


@query("""
    SELECT p_partkey, p_name, p_brand, p_type FROM part
    WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'eco')
    ORDER BY p_partkey LIMIT 30
""")
def metadata_or_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of several fields holds its needle; the first thirty by key."""
    p = table(spark, sf_dir, "part")
    hit = keyword.contains(F.col("p_name"), "ring") | keyword.contains(F.col("p_brand"), "brand#1") | keyword.contains(F.col("p_type"), "eco")
    return p.where(hit).orderBy("p_partkey").limit(30).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""
    WITH h AS (SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'token') AND contains(lower(text), 'on'))
    SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM h) WHERE n = 1
""")
def multi_term_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(keyword.all_terms(["the", "token", "on"], F.col("text")))
    return keyword.best_per(docs.select("source", "doc_id", "n_chars"), "source", F.desc("n_chars"), F.col("doc_id"))


@query(f"""
    WITH t AS (SELECT item_id, {meaningful_sql("text")} AS w FROM benchmark),
    k AS (SELECT item_id, w, unnest({windows_sql()}) AS s FROM t WHERE len(w) >= 6)
    SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 7], ' ') AS win FROM k WHERE len(w[s + 1 : s + 7]) >= 5
""")
def pasted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of seven meaningful tokens at fixed places of a pasted text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", text.meaningful(F.col("text")).alias("w"))
    return items.select("item_id", F.explode(keyword.token_windows(F.col("w"))).alias("win")).distinct()


@query(rf"""
    WITH n AS (SELECT doc_id, text, trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\r\f]+', ' ', 'g'), ' ') AS plain FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, regexp_extract_all(plain, '(?:№ *)?[0-9]{{1,4}}/[0-9]{{4,}}(?:[-/][0-9]+)?') AS nums,
                 list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda s: trim(regexp_replace(replace(s, chr(160), ' '), '[ \t\f]+', ' ', 'g'), ' ')), lambda s: length(s) BETWEEN 35 AND 170) AS lines FROM n),
    g AS (SELECT doc_id, list_concat(flatten(list_transform(nums, lambda s: [s, trim(regexp_replace(s, '^№ *', ''), ' ')])), list_filter(lines, lambda s: len({meaningful_sql("s").replace("lambda w", "lambda v").replace("(w", "(v").replace("w NOT", "v NOT")}) >= 4))[1:8] AS l FROM f),
    o AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM g)
    SELECT doc_id, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, '|')) AS needles_md5 FROM o
""")
def pasted_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document numbers and characteristic lines of a text, to look it up by."""
    found = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", keyword.needles(F.col("text")).alias("l"))
    return found.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("needles_md5"))


@query(f"""
    WITH b AS (SELECT item_id, {tokens_sql("text")} AS t FROM benchmark),
    q AS (SELECT item_id, unnest(t) AS token, len(t) AS query_n FROM b),
    d AS (SELECT doc_id, unnest(t) AS token, len(t) AS doc_n FROM (SELECT doc_id, {tokens_sql("text")} AS t FROM documents)),
    p AS (SELECT item_id, doc_id, count(*) AS shared, max(query_n) AS query_n, max(doc_n) AS doc_n FROM q JOIN d USING (token) GROUP BY ALL)
    SELECT item_id AS query_id, doc_id, shared, CAST(query_n AS INTEGER) AS query_n, CAST(doc_n AS INTEGER) AS doc_n FROM p WHERE shared >= 0.7 * query_n
""")
def token_coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and documents with 70 per cent of their tokens, over an inverted index."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("tokens"))
    return keyword.token_overlap(items, table(spark, sf_dir, "documents"), "doc_id", "text", 0.7)


@query(f"""
    WITH w AS (SELECT item_id, list_filter({words_sql("text")}, lambda w: length(w) >= 4 AND w NOT IN ({STOP})) AS w FROM benchmark),
    b AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:10] AS t FROM w),
    q AS (SELECT item_id, unnest(t) AS token, len(t) AS n FROM b WHERE len(t) >= 3),
    d AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL),
    p AS (SELECT item_id, doc_id, count(*) AS hits, max(n) AS n FROM q JOIN d ON contains(low, token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id DESC) AS k FROM p WHERE hits >= greatest(3, ceil(0.7 * n)))
    SELECT item_id, doc_id, CAST(hits AS INTEGER) AS hits, round(least(0.99, 0.68 + 0.31 * hits / n), 6) AS score FROM r WHERE k <= 30
""")
def card_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten tokens of a query in text order, 70 per cent of which must occur, be it inside words."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("tokens"))
    top = keyword.card_search(q, table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    return top.select(F.col("query_id").alias("item_id"), "doc_id", "hits", F.round("score", 6).alias("score"))


@query("""
    SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(^|[\\r\\n])\\s*(Licensed|Copyright|All rights|This work)')
""")
def heading_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line that begins like a heading."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(^|[\r\n])\s*(Licensed|Copyright|All rights|This work)")).select("doc_id", "source")


@query("""
    WITH g AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{5,} [a-z]+')) AS term FROM benchmark)
    SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc FROM g JOIN documents ON contains(lower(text), term) WHERE term <> '' GROUP BY term
""")
def theta_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary of whole terms against texts, by containment."""
    terms = table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]{5,} [a-z]+", 0)).alias("term")).where("term <> ''").distinct()
    found = keyword.terms_in(terms, table(spark, sf_dir, "documents").select("doc_id", "text"), "term", "text")
    return found.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""
    WITH e AS (SELECT p_type AS canonical, split_part(p_name, ' ', 2) AS synonym, count(*) AS n FROM part GROUP BY ALL),
    i AS (SELECT synonym, arg_max(canonical, (n, canonical)) AS canonical, max(n) AS n FROM e GROUP BY synonym)
    SELECT synonym, canonical, n FROM i
""")
def glossary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each synonym's canonical entry: the most frequent one."""
    entries = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("canonical"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("synonym")).agg(F.count("*").alias("n"))
    return keyword.best_per(entries, "synonym", F.desc("n"), F.desc("canonical"))


@query(r"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b),
    d AS (SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f\x0B\x{A0}]+', ' ', 'g')) AS t FROM c)
    SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM d
""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return found.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query(r"""
    WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages),
    p AS (SELECT page_id, title, trim(regexp_replace(title, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS plain FROM t)
    SELECT page_id, title, CASE WHEN length(plain) <= 60 THEN plain ELSE regexp_replace(substring(plain, 1, 60), ' [^ ]*$', '') || '…' END AS short FROM p
""")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.page_title(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), text.short_title(title).alias("short"))


@query("""
    SELECT link, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY link
""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link")).distinct().groupBy("link").agg(F.count("*").alias("n_pages"))


@query(r"""
    WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS ips, list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS mails FROM documents)
    SELECT doc_id, CAST(len(ips) AS INTEGER) AS n_ips, CAST(len(mails) AS INTEGER) AS n_mails, array_to_string(list_sort(mails), ',') AS mails FROM f WHERE len(ips) + len(mails) > 0
""")
def pattern_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips, mails = verify.extracted(F.col("text"), r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), verify.extracted(F.col("text"), r"[A-Za-z0-9._]+@[A-Za-z0-9.]+")
    found = table(spark, sf_dir, "documents").select("doc_id", ips.alias("i"), mails.alias("m")).where(F.size("i") + F.size("m") > 0)
    return found.select("doc_id", F.size("i").alias("n_ips"), F.size("m").alias("n_mails"), F.array_join(F.array_sort("m"), ",").alias("mails"))


@query(r"""
    WITH n AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS t FROM orders)
    SELECT o_orderkey, regexp_replace(regexp_replace(t, '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS plain FROM n
""")
def number_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"\.", ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normal_number(amount).alias("plain"))


@query("""
    SELECT doc_id, CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secrets' WHEN contains(lower(text), 'licens') OR contains(lower(text), 'copyright') THEN 'legal'
        WHEN contains(lower(text), '@') THEN 'contact' ELSE 'general' END AS domain,
        (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND (contains(lower(text), 'of') OR contains(lower(text), 'und')) AS gated
    FROM documents
""")
def signal_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signal list with a hit names the domain; a gate asks for a hit in each of its groups."""
    routes = [("secrets", ["password", "token"]), ("legal", ["licens", "copyright"]), ("contact", ["@"])]
    return table(spark, sf_dir, "documents").select("doc_id", text.first_signal(F.col("text"), routes, "general").alias("domain"), text.holds_all_groups(F.col("text"), [["the", "der"], ["of", "und"]]).alias("gated"))


@query(r"""
    SELECT doc_id, md5(substring(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')), 1, 8000)) AS clean_md5,
           md5(CASE WHEN length(text) <= 2500 THEN text ELSE left(text, 500) || ' … ' || right(text, 2000) END) AS excerpt_md5
    FROM documents
""")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an embedding call gets: cleaned and capped text, and the head and tail of long ones."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_for_embedding(F.col("text"))).alias("clean_md5"), F.md5(text.head_and_tail(F.col("text"))).alias("excerpt_md5"))


@query(r"""
    WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) BETWEEN 25 AND 400) AS s FROM documents),
    t AS (SELECT doc_id, flatten(list_transform(['the', 'und', 'que'], lambda k: list_filter(s, lambda x: contains(lower(x), k)))) AS l FROM s),
    o AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS l FROM t)
    SELECT doc_id, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, '|')) AS evidence_md5 FROM o
""")
def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.evidence(F.col("text"), ["the", "und", "que"])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("evidence_md5"))


@query(r"""
    WITH c AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{9,}')) FILTER (WHERE role = 'assistant'))) AS cited,
                      list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{9,}')) FILTER (WHERE role <> 'assistant'))) AS valid
               FROM conversations GROUP BY conv_id)
    SELECT conv_id, CAST(coalesce(len(cited), 0) AS INTEGER) AS n_cited, CAST(coalesce(len(list_filter(cited, lambda x: NOT list_contains(coalesce(valid, []), x))), 0) AS INTEGER) AS n_unsupported FROM c
""")
def citation_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers cite that no source of their conversation holds: a join, so no list grows with a conversation."""
    rows = table(spark, sf_dir, "conversations")
    every = rows.select("conv_id").distinct()
    found = rows.select("conv_id", (F.col("role") == "assistant").alias("answer"), F.explode(verify.extracted(F.lower("text"), "[a-z]{9,}")).alias("cite"))
    per = found.groupBy("conv_id", "cite").agg(F.bool_or("answer").alias("cited"), F.bool_or(~F.col("answer")).alias("valid"))
    counts = per.groupBy("conv_id").agg(F.count_if("cited").alias("c"), F.count_if(F.col("cited") & ~F.col("valid")).alias("u"))
    return every.join(counts, "conv_id", "left").select("conv_id", F.coalesce("c", F.lit(0)).cast("int").alias("n_cited"), F.coalesce("u", F.lit(0)).cast("int").alias("n_unsupported"))


@query("""
    SELECT doc_id, md5(replace(replace(text, 'All rights reserved.', '[rights]'), ' the ', ' THE ')) AS text_md5,
           array_to_string(list_filter([CASE WHEN contains(text, 'All rights reserved.') THEN 'rights' END, CASE WHEN contains(replace(text, 'All rights reserved.', '[rights]'), ' the ') THEN 'article' END], lambda x: x IS NOT NULL), ',') AS rules
    FROM documents
""")
def rewrite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, names = verify.rewrite(F.col("text"), [("rights", "All rights reserved.", "[rights]"), ("article", " the ", " THE ")])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(new).alias("text_md5"), F.array_join(names, ",").alias("rules"))


#: The given pages' own layout: every paragraph of an article element.
PAGE_LAYOUTS = (markup.Layout("each", "tag = 'p'", within="tag = 'article'"),)


@query(r"""
    WITH b AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)(</article>|<footer|$)', 1), '<p>')[2:] AS ps FROM pages),
    p AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM b),
    t AS (SELECT page_id, k, regexp_replace(regexp_replace(split_part(p, '</p>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM p),
    d AS (SELECT page_id, k, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS content FROM t)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS place, md5(content) AS content_md5, CAST(length(content) AS INTEGER) AS n_chars FROM d WHERE length(content) >= 20
""")
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of pages, whatever stands open in their markup: by elements and a layout rule."""
    e = cut(markup.elements(markup.tokenized(table(spark, sf_dir, "pages"), "page_id", "html")), "elements")
    return markup.articles(e, PAGE_LAYOUTS).select("page_id", "place", F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"))


@query(r"""
    WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS h,
        trim(regexp_replace(trim(regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')), '\s*[|·—-].*$', '')) AS t FROM pages),
    m AS (SELECT page_id, length(html) - length(replace(html, '<li>', '123')) AS n FROM pages)
    SELECT page_id, md5(CASE WHEN length(h) > 5 THEN h WHEN length(t) > 5 THEN t ELSE '' END) AS title_md5, n AS n_items FROM t JOIN m USING (page_id)
""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's title and the number of its list items, from its table of elements."""
    e = cut(markup.elements(markup.tokenized(table(spark, sf_dir, "pages"), "page_id", "html")), "elements")
    items = e.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("n_items"))
    return markup.titles(e).join(items, "page_id").select("page_id", F.md5("title").alias("title_md5"), "n_items")


QUERIES, ORACLE_SQL = query.queries, query.sql
