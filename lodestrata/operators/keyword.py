"""Keyword search: phrase scores, field matches, token coverage by an inverted index, pasted-text windows."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import digits, optional
from ..functions.text import meaningful, runs, tokens, words
from ..storage import over_blocks


def contains(text: Column, needle: str | Column) -> Column:
    """Case-blind containment; the needle is literal, no wildcards."""
    n = F.lit(needle.lower()) if isinstance(needle, str) else F.lower(needle)
    return F.lower(F.coalesce(text, F.lit(""))).contains(n)


def title_quality(title: Column, canonical: str, amendment: str) -> Column:
    return F.when(contains(title, amendment), 0.35).when(contains(title, canonical), 1.08).otherwise(1.0)


def phrase_hits(title: Column, content: Column, phrases: list[str]) -> Column:
    """Per phrase: 2 for the title, 1 for the content."""
    out = F.lit(0)
    for p in phrases:
        out = out + F.when(contains(title, p), 2).otherwise(0) + F.when(contains(content, p), 1).otherwise(0)
    return out


def keyword_rank(score: Column) -> Column:
    return F.least(F.lit(0.58), 0.30 + 0.06 * score)


def best_per(rows: DataFrame, parent: str | list[str], *order: Column) -> DataFrame:
    """The first row of each parent in an order; the order must be total."""
    w = Window.partitionBy(*([parent] if isinstance(parent, str) else parent)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def any_field(needle: str, *fields: Column) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | contains(f, needle)
    return out


def all_terms(terms: list[str], *fields: Column) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & any_field(t, *fields)
    return out


def token_windows(found: Column, size: int = 7, least: int = 5, enough: int = 6) -> Column:
    """Runs of ``size`` tokens: the first one, from 8 and 18, and from 45 and 70 per cent of the last place that a whole
    run can begin at, none of them later than that; distinct, ``least`` tokens long. None for fewer than ``enough``."""
    last = F.greatest(F.size(found) - size, F.lit(0))
    starts = F.array_distinct(F.array(F.lit(0), F.least(last, F.lit(8)), F.least(last, F.lit(18)), F.floor(last * 0.45).cast("int"), F.floor(last * 0.70).cast("int")))
    runs = F.filter(F.transform(starts, lambda s: F.slice(found, s + 1, size)), lambda r: F.size(r) >= least)
    joined = F.array_distinct(F.transform(runs, lambda r: F.array_join(r, " ")))
    return F.when(F.size(found) >= enough, joined).otherwise(F.array().cast("array<string>"))


#: A document's number: up to four digits, a slash, four digits or more and perhaps a part; perhaps with its sign.
DOCUMENT_NUMBER = optional("№", r"\s*") + "/".join((digits(1, 4), digits(4))) + optional("[-/]", digits(1))


def needles(text: Column, pattern: str = DOCUMENT_NUMBER, most: int = 8) -> Column:
    """Document numbers that match a pattern, with and without their number sign, then lines of 35 to 170 characters with
    four meaningful tokens; the first ``most``, each once."""
    plain = F.btrim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), lambda s: F.btrim(s))
    numbers = F.flatten(F.transform(numbers, lambda s: F.array(s, F.btrim(F.regexp_replace(s, "^№\\s*", "")))))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R+"), lambda s: F.btrim(F.regexp_replace(F.replace(s, F.lit("\u00a0"), F.lit(" ")), r"\s+", " ")))
    lines = F.filter(lines, lambda s: F.length(s).between(35, 170) & (F.size(meaningful(s)) >= 4))
    return F.array_distinct(F.slice(F.concat(numbers, lines), 1, most))


#: Queries that are broadcast at once.
ASKED = 20_000


def token_overlap(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, least_share: float) -> DataFrame:
    """(query_id, id, shared, query_n, doc_n) of pairs in which the text has ``least_share`` of the query's tokens or more,
    and one at least.

    ``queries``: (query_id, tokens), the tokens distinct; a stated set, in blocks against all texts. A text's tokens are
    made once; its task looks them up in the block's inverted index and counts them for all queries together, so
    whatever the share and however frequent a token, only pairs of the share leave the task and none is shuffled here.
    """
    held = docs.select(id_col, tokens(F.col(text_col)).alias("_t"))

    def of_block(block: DataFrame) -> DataFrame:
        rows = [(r["query_id"], r["tokens"]) for r in block.select("query_id", "tokens").where(F.size("tokens") > 0).collect()]  # one block
        lists: dict[str, list[int]] = {}
        for i, (_, own) in enumerate(rows):
            for t in own:
                lists.setdefault(t, []).append(i)
        ids, sizes = np.array([q for q, _ in rows], dtype=np.int64), np.array([len(t) for _, t in rows], dtype=np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(({t: np.array(x, dtype=np.int32) for t, x in lists.items()}, ids, sizes))

        @F.arrow_udf("array<struct<query_id: long, shared: long, query_n: int>>")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            by_token, ids, sizes = shared.value
            least = np.maximum(1, least_share * sizes)
            for batch in batches:
                found, ends = [], [0]
                for own in batch.to_pylist():
                    hits = [by_token[t] for t in own if t in by_token]
                    n = np.bincount(np.concatenate(hits), minlength=len(ids)) if hits else np.zeros(0, np.int64)
                    at = np.flatnonzero(n >= least) if hits else n
                    found.append((at, n[at]))
                    ends.append(ends[-1] + len(at))
                at, n = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1)) if found else (np.zeros(0, np.int64),) * 2
                pairs = pa.StructArray.from_arrays([pa.array(ids[at]), pa.array(n), pa.array(sizes[at].astype(np.int32))], ["query_id", "shared", "query_n"])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

        told = held.select(id_col, F.size("_t").alias("doc_n"), F.inline(counted("_t")))
        return told.select("query_id", id_col, "shared", "query_n", "doc_n")

    return over_blocks(queries, "query_id", ASKED, of_block)


#: Entries of a stated set that are broadcast at once.
ENTRIES = 20_000


def _held(spark: SparkSession, terms: list[str]):
    """A function of a text column: the array of those ``terms`` that a text contains, in one walk over the text."""
    shared = spark.sparkContext.broadcast(terms)

    @F.arrow_udf("array<string>")
    def held(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for t in shared.value:
            if t:
                automaton.add_word(t, t)
        everywhere = [""] if "" in shared.value else []
        automaton.make_automaton()
        walk = automaton.iter if len(automaton) else lambda text: ()
        for batch in texts:
            yield pa.array([everywhere + sorted({t for _, t in walk(text)}) for text in batch.to_pylist()], pa.list_(pa.string()))

    return held


def terms_in(terms: DataFrame, docs: DataFrame, term_col: str, text_col: str) -> DataFrame:
    """Each text with each term that it contains, case-blind and literally. Null texts are empty, null terms in none.

    Terms are a stated set, in blocks; an automaton over a block's terms finds them all in one walk over a text, so the
    work does not grow with texts times terms.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))

    def of_block(block: DataFrame) -> DataFrame:
        own = block.withColumn("_term", F.lower(term_col)).where("_term is not null")
        found = [r[0] for r in own.select("_term").distinct().collect()]  # one block
        return docs.withColumn("_term", F.explode(_held(docs.sparkSession, found)(low))).join(F.broadcast(own), "_term").drop("_term")

    return over_blocks(terms, term_col, ENTRIES, of_block)


def small(rows: DataFrame, most: int = 10 * ENTRIES) -> DataFrame:
    """``rows``, to be broadcast if their number, which is counted, allows it."""
    return F.broadcast(rows) if rows.count() <= most else rows


def passages_in(passages: DataFrame, docs: DataFrame, passage_col: str, text_col: str) -> DataFrame:
    """Each text with each passage that it holds, word for word and case for case.

    A passage's words but the first and the last stand whole in a text that holds it: passages are joined to texts by
    the longest of these, and then compared. Passages of two words or fewer are found by an automaton over them, in blocks.
    """
    found = words(F.col(passage_col))
    inner = F.slice(found, 2, F.greatest(F.size(found) - 2, F.lit(0)))
    keyed = passages.where(F.col(passage_col) != "").withColumn("_word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    holds = F.contains(F.col(text_col), F.col(passage_col))
    by_word = docs.select("*", F.explode(F.array_distinct(words(F.col(text_col)))).alias("_word")).join(small(keyed.where("_word is not null")), "_word").where(holds).drop("_word")
    short = keyed.where("_word is null").drop("_word")

    def of_block(block: DataFrame) -> DataFrame:
        found = [r[0] for r in block.select(passage_col).distinct().collect()]  # one block
        return docs.withColumn(passage_col, F.explode(_held(docs.sparkSession, found)(F.coalesce(text_col, F.lit(""))))).join(F.broadcast(block), passage_col)

    return by_word.unionByName(over_blocks(short, passage_col, ENTRIES, of_block).select(*by_word.columns))


def card_search(queries: DataFrame, cards: DataFrame, id_col: str, text_col: str, k: int = 30, most: int = 10) -> DataFrame:
    """(query_id, id, hits, query_n, score, rank): the ``k`` cards that contain most of a query's first ``most`` tokens,
    case-blind and also inside words; ``needed_matches`` of them at least. More hits first, then the greater id.

    ``queries``: (query_id, tokens) in text order, distinct, a stated set, in blocks; those of fewer than three tokens
    ask for nothing. A task walks over a text once for all tokens of a block and counts them by query, so only pairs
    with enough hits leave it.
    """
    asked = queries.where(F.size("tokens") >= 3).select("query_id", F.slice("tokens", 1, most).alias("tokens"))
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))

    def of_block(block: DataFrame) -> DataFrame:
        rows = [(r["query_id"], r["tokens"]) for r in block.collect()]  # one block
        by_token: dict[str, list[int]] = {}
        for i, (_, tokens_) in enumerate(rows):
            for t in tokens_:
                by_token.setdefault(t, []).append(i)
        needs = [(q, len(t), max(3, ceil(0.7 * len(t) - 1e-9))) for q, t in rows]
        shared = cards.sparkSession.sparkContext.broadcast((by_token, needs))

        @F.arrow_udf("array<struct<query_id: long, hits: int, query_n: int>>")
        def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            by_token, needs = shared.value
            automaton = ahocorasick.Automaton()
            for t in by_token:
                automaton.add_word(t, t)
            automaton.make_automaton()
            kind = pa.list_(pa.struct([("query_id", pa.int64()), ("hits", pa.int32()), ("query_n", pa.int32())]))
            for batch in texts:
                out = []
                for text in batch.to_pylist():
                    hits: Counter = Counter(i for t in {t for _, t in automaton.iter(text)} for i in by_token[t]) if by_token else Counter()
                    out.append([{"query_id": needs[i][0], "hits": n, "query_n": needs[i][1]} for i, n in hits.items() if n >= needs[i][2]])
                yield pa.array(out, kind)

        return cards.select(id_col, F.explode(counted(low)).alias("c")).select("c.query_id", id_col, "c.hits", "c.query_n")

    w = Window.partitionBy("query_id").orderBy((F.col("hits") / F.col("query_n")).desc(), F.desc(id_col))
    top = over_blocks(asked, "query_id", ENTRIES, of_block).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.withColumn("score", card_rank(F.col("hits"), F.col("query_n")))


def needed_matches(n: Column) -> Column:
    """Of n query tokens (three or more) so many must match: 70 per cent, three at least."""
    return F.greatest(F.lit(3), F.ceil(0.7 * n).cast("int"))


def card_rank(hits: Column, n: Column) -> Column:
    return F.least(F.lit(0.99), 0.68 + 0.31 * hits / n)


def pasted_rank(rank: Column) -> Column:
    return F.least(F.lit(1.0), 0.58 + F.log(1 + rank) / 2.5)


#: What a cover of no other words counts, and what a needle counts.
COVER, NEEDLE = 0.1, 4.0


def cover_density(found: list[str], terms: frozenset[str]) -> float:
    """The sum over a text's minimal intervals that hold all ``terms``, of 0.1 by one more than the interval's other
    words. ``found``: the text's tokens in order; 0 for a text that lacks a term."""
    total, hits, last, begun = 0.0, [], {}, -1
    for i, w in enumerate(found):
        if w in terms:
            hits.append(i)
            last[w] = i
            if len(last) == len(terms) and (a := min(last.values())) != begun:
                begun = a
                total += COVER / (1 + i - a + 1 - (len(hits) - bisect_left(hits, a)))
    return total


def windows_in(windows: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with ``win`` and ``density``: each window (win: its tokens, joined by a space) all of whose tokens a text
    has, with its cover density there.

    Windows are a stated set, in blocks. One walk of an automaton over a text tells which windows' longest tokens it
    contains, be it inside words; only texts that contain all tokens of a window are cut into tokens and compared, with
    the windows that they may hold.
    """
    told = texts.withColumn("_plain", F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u00a0"), F.lit(" "))))

    def of_block(block: DataFrame) -> DataFrame:
        asked = [(r["win"], frozenset(r["win"].split(" "))) for r in block.where("win is not null").collect()]  # one block
        shared = texts.sparkSession.sparkContext.broadcast(asked)

        @F.arrow_udf("array<int>")
        def likely(plain: Iterator[pa.Array]) -> Iterator[pa.Array]:
            keyed: dict[str, list[int]] = {}
            for i, (_, terms) in enumerate(shared.value):
                keyed.setdefault(max(terms, key=lambda t: (len(t), t)), []).append(i)
            automaton = ahocorasick.Automaton()
            for t in filter(None, keyed):
                automaton.add_word(t, t)
            automaton.make_automaton()
            walk = automaton.iter if len(automaton) else lambda text: ()
            for batch in plain:
                rows = [[i for key in {t for _, t in walk(text)} for i in keyed[key] if all(t in text for t in shared.value[i][1])] for text in batch.to_pylist()]
                yield pa.array(rows, pa.list_(pa.int32()))

        @F.arrow_udf("array<struct<win: string, density: double>>")
        def held(tokens_: pa.Array, asked_: pa.Array) -> pa.Array:
            rows = []
            for found, at in zip(tokens_.to_pylist(), asked_.to_pylist()):
                own = set(found)
                fitting = [shared.value[i] for i in at if shared.value[i][1] <= own]
                rows.append([{"win": w, "density": cover_density(found, terms)} for w, terms in fitting])
            return pa.array(rows, pa.list_(pa.struct([("win", pa.string()), ("density", pa.float64())])))

        # not to be run once for the condition and once for the column
        some = told.withColumn("_likely", likely.asNondeterministic()("_plain")).where(F.size("_likely") > 0)
        return some.select(*texts.columns, F.inline(held(runs(F.col(text_col)), F.col("_likely"))))

    return over_blocks(windows.select("win").distinct(), "win", ENTRIES, of_block)


def pasted_search(pasted: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, parent, chunk_index, text_rank, similarity, rank): the ``k`` parents that most look like the source of a
    pasted text, by their best chunk.

    ``pasted``: (item_id, text); ``chunks``: (parent, chunk_index, content). A chunk's rank is the sum of the cover
    densities of the text's windows (see ``token_windows``) that it holds all tokens of, and 4 for each of its needles
    (see ``needles``) that it contains. Of chunks of equal rank the first counts, of parents the one of smallest id.
    """
    windows = pasted.select("item_id", F.explode(token_windows(meaningful(F.col("text")))).alias("win")).distinct()
    wanted = pasted.select("item_id", F.explode(needles(F.col("text"))).alias("needle")).distinct()
    dense = windows_in(windows, chunks, "content").join(small(windows), "win").select("item_id", "parent", "chunk_index", F.col("density").alias("value"))
    literal = terms_in(wanted, chunks, "needle", "content").select("item_id", "parent", "chunk_index", F.lit(NEEDLE).alias("value"))
    ranked = dense.unionByName(literal).groupBy("item_id", "parent", "chunk_index").agg(F.round(F.sum("value"), 9).alias("text_rank"))
    best = ranked.groupBy("item_id", "parent").agg(F.min_by("chunk_index", F.struct(-F.col("text_rank"), "chunk_index")).alias("chunk_index"), F.max("text_rank").alias("text_rank"))
    w = Window.partitionBy("item_id").orderBy(F.desc("text_rank"), "parent")
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("item_id", "parent", "chunk_index", "text_rank", pasted_rank(F.col("text_rank")).alias("similarity"), "rank")
