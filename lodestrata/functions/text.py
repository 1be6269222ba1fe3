"""Text functions: Column in, Column out. Lengths and offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
#: A small neutral list; corpora bring their own.
STOP_WORDS = ("that", "with", "this", "from", "were", "which", "dans", "pour", "avec", "para", "nicht", "eine", "einer", "sich", "queda", "como")
#: Common entities; the ampersand last, so that none is decoded twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Tried in this order; what is left must have three characters or more.
SUFFIXES = ("ation", "ement", "ungen", "mente", "ing", "ung", "ion", "ed", "en", "er", "es", "s")


def words(text: Column) -> Column:
    """Lower-case words in order, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def tokens(text: Column, least: int = 4, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct meaningful words: of ``least`` characters or more and not in the stop list."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


def runs(text: Column) -> Column:
    """Lower-case tokens of a text in order, repeats included: letters, digits and / . - make one; points at its ends go."""
    parts = F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" "))), r"[^\p{L}\p{N}/.\-]+")
    return F.filter(F.transform(parts, lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def meaningful(text: Column, least: int = 4, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Those of a text's ``runs`` that are neither short nor stop words."""
    return F.filter(runs(text), lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def token_prefixes(found: Column, length: int = 7) -> Column:
    return F.array_distinct(F.transform(found, lambda w: F.substring(w, 1, length)))


def stem(word: Column, suffixes: tuple[str, ...] = SUFFIXES, least: int = 3) -> Column:
    """The word without the first suffix of the list that fits and leaves enough."""
    out = word
    for s in reversed(suffixes):
        out = F.when(word.endswith(s) & (F.length(word) - len(s) >= least), F.left(word, F.length(word) - len(s))).otherwise(out)
    return out


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1500, overlap: int = 200, least: int = 1, one_if_short: bool = False) -> DataFrame:
    """(id, chunk_index, content): windows of ``size`` characters every ``size - overlap``, trimmed; those of fewer than
    ``least`` characters go. With ``one_if_short`` a text that fits is one chunk. Null and empty texts have none."""
    step = size - overlap
    length = F.length(text_col)
    starts = F.when(length > 0, F.sequence(F.lit(0), F.when((length <= size) & F.lit(one_if_short), 0).otherwise(length - 1), F.lit(step)))
    cut = docs.select(id_col, text_col, F.posexplode(starts).alias("chunk_index", "start"))
    content = F.btrim(F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)), F.lit(" \t\n\r\u000b\f"))
    return cut.select(id_col, "chunk_index", content.alias("content")).where(F.length("content") >= least)


#: What trimming takes away.
BLANK = " \t\n\r\x00\x0b"


def headed_chunks(rows: DataFrame, id_col: str, header: Column, body: Column, size: int = 1500, overlap: int = 200, least: int = 20) -> DataFrame:
    """(id, chunk_index, content): a body cut into pieces that each repeat the header in a line of its own.

    A header leaves max(200, size - its length - 1) characters for a piece, and pieces begin every max(100, that -
    overlap). Chunks of ``least`` characters or fewer go, and so do rows without a body.
    """
    told = rows.select(id_col, F.btrim(F.coalesce(header, F.lit("")), F.lit(BLANK)).alias("head"), F.btrim(F.coalesce(body, F.lit("")), F.lit(BLANK)).alias("body")).where("body <> ''")
    limit = F.greatest(F.lit(200), size - F.length("head") - 1)
    told = told.withColumn("limit", limit).withColumn("step", F.greatest(F.lit(100), F.col("limit") - overlap))
    cut = told.select(id_col, "head", "body", "limit", F.posexplode(F.sequence(F.lit(0), F.length("body") - 1, F.col("step"))).alias("place", "start"))
    piece = F.btrim(F.substring(F.col("body"), F.col("start") + 1, F.col("limit")), F.lit(BLANK))
    whole = F.btrim(F.concat("head", F.lit("\n"), piece), F.lit(BLANK))
    return cut.select(id_col, F.col("place").alias("chunk_index"), whole.alias("content")).where(F.length("content") > least)


def sub_chunks(rows: DataFrame, id_col: str, text_col: str, size: int = 750, overlap: int = 100) -> DataFrame:
    """(id, part_id, content): texts of up to ``size`` characters as they are; longer ones in overlapping trimmed parts,
    whose ids are the text's, from the second on with the part's number behind a point."""
    long_ = F.length(text_col) > size
    starts = F.when(long_, F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(size - overlap))).otherwise(F.array(F.lit(0)))
    cut = rows.where(F.col(text_col).isNotNull()).select(id_col, text_col, long_.alias("long"), F.posexplode(starts).alias("place", "start"))
    name = F.concat(F.col(id_col).cast("string"), F.when(F.col("place") > 0, F.concat(F.lit("."), (F.col("place") + 1).cast("string"))).otherwise(""))
    piece = F.substring(F.col(text_col), F.col("start") + 1, F.lit(size))
    return cut.select(id_col, name.alias("part_id"), F.when(F.col("long"), F.btrim(piece, F.lit(BLANK))).otherwise(piece).alias("content"))


def normal_number(text: Column) -> Column:
    """Digits without spaces, decimal point for comma, no trailing zeros after it."""
    plain = F.regexp_replace(F.regexp_replace(text, "[   ]", ""), ",", ".")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block tags become spaces, common entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r\f\x0B ]+", " "))


#: Fixed value: letters whose words come apart into single letters.
SPACED = "[\u10d0-\u10ff]"


def rich_text(html: Column, plain: Column | None = None, letter: str = SPACED) -> Column:
    """Text of a page with its line structure; ``plain`` instead if the page has no text.

    Raised numbers become ^N, block tags line breaks, entities characters; words of ``letter`` that are set in single
    letters, three or more, are joined; control characters go, blanks and more than two line breaks are reduced.
    """
    out = F.regexp_replace(html, r"(?i)<sup[^>]*>([0-9]+)</sup>", r"^$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</?(p|div|br|li|tr|h[1-6])[^>]*>", "\n"), r"<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    if plain is not None:
        out = F.when(F.btrim(F.regexp_replace(html, r"<[^>]*>", ""), F.lit(BLANK)) != "", out).otherwise(F.coalesce(plain, F.lit("")))
    out = F.regexp_replace(out, f"(?<={letter} {letter}) (?={letter})|(?<={letter}) (?={letter} {letter})", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(BLANK))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def short_title(text: Column, most: int = 60) -> Column:
    """At most ``most`` characters, cut at a word's end, with an ellipsis if something was cut."""
    plain = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    head = F.substring(plain, 1, most)
    whole = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(whole, F.lit("…")))


def any_date(text: Column) -> Column:
    """YYYY-MM-DD, YYYY-MM, YYYY or DD/MM/YYYY; null for anything else."""
    padded = F.when(text.rlike(r"^[0-9]{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    return F.coalesce(F.try_to_date(padded, "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy"))


def last_date(text: Column) -> Column:
    """The last DD/MM/YYYY in a text as YYYY-MM-DD."""
    dates = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), F.lit(0))
    parts = F.split(F.try_element_at(dates, F.lit(-1)), "/")
    return F.when(F.size(dates) > 0, F.concat_ws("-", F.get(parts, 2), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 0), 2, "0")))


def numbered_parts(docs: DataFrame, id_col: str, text_col: str, size: int = 2000, least: int = 30) -> DataFrame:
    """(id, part, content): trimmed pieces of ``size`` characters of ``least`` characters or more, numbered from one
    without gaps."""
    found = fixed_chunks(docs, id_col, text_col, size, 0, least)
    return found.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("chunk_index")).alias("part"), "content")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\n\r\f\x0B]+"), lambda s: s != "")


def evidence(text: Column, terms: list[str], least: int = 25, most: int = 400, number: int = 5) -> Column:
    """Up to ``number`` sentences of fitting length that hold a term, all of the first term before the next one's."""
    fitting = F.filter(sentences(text), lambda s: F.length(s).between(least, most))
    return F.slice(F.array_distinct(F.flatten(F.array(*(F.filter(fitting, _holding(t)) for t in terms)))), 1, number)


def _holding(term: str):
    return lambda s: F.lower(s).contains(term)


def clean_for_embedding(text: Column, most: int = 8000) -> Column:
    """Control characters out, white space single, cut to ``most`` characters."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"[ \t\n\r\f\x0B]+", " ")
    return F.substring(F.btrim(plain), 1, most)


def head_and_tail(text: Column, head: int = 500, tail: int = 2000) -> Column:
    """The whole text if short, else its beginning and its end."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" … "), F.right(text, F.lit(tail))))


def holds_any(text: Column, needles: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for n in needles:
        out = out | low.contains(n)
    return out


def holds_all_groups(text: Column, groups: list[list[str]]) -> Column:
    """Of each group at least one needle."""
    out = F.lit(True)
    for g in groups:
        out = out & holds_any(text, g)
    return out


def first_signal(text: Column, signals: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first signal list with a hit."""
    out = F.lit(default)
    for name, needles in reversed(signals):
        out = F.when(holds_any(text, needles), name).otherwise(out)
    return out
