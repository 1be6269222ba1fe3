"""Fusing result lists: priority unions, merges by score, deduplication, grouping of chunks by parent."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def priority_union(stages: list[tuple[str, DataFrame]], key: str, always: tuple[str, ...] = ()) -> DataFrame:
    """Stages in order of priority: a key's rows come from its first stage only; those of ``always`` are kept beside."""
    tagged = [df.withColumn("stage", F.lit(name)).withColumn("_s", F.lit(i)) for i, (name, df) in enumerate(stages)]
    both = reduce(DataFrame.unionByName, tagged)
    fixed = F.col("stage").isin(*always) if always else F.lit(False)
    first = F.min(F.when(~fixed, F.col("_s"))).over(Window.partitionBy(key))
    return both.withColumn("_first", first).where(fixed | (F.col("_s") == F.col("_first"))).drop("_s", "_first")


def unseen(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``first`` and the rows of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def group_chunks(chunks: DataFrame, parent: str | list[str], score: str, order: str, text: str, pieces: int = 3, most: int = 1500, most_of: str | None = None) -> DataFrame:
    """Per parent: max and mean score, number of chunks, and its best chunks' text joined and cut; with ``most_of`` also
    the highest value of that column (``also``)."""
    keys = [parent] if isinstance(parent, str) else parent
    top = top_per(chunks.select(*keys, score, order, text), keys, pieces, F.desc(score), F.col(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda s: s[text]), "\n")
    excerpts = top.groupBy(*keys).agg(F.substring(texts, 1, most).alias("excerpt"))
    also = [F.max(most_of).alias("also")] if most_of else []
    return chunks.groupBy(*keys).agg(F.max(score).alias("most"), F.avg(score).alias("mean"), F.count("*").alias("n"), *also).join(excerpts, keys)


def top_per(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_advocate(rows: DataFrame, keys: list[str], k: int, outlier: Column, *order: Column) -> DataFrame:
    """Top k per key; if there is an outlier among the rows, the best one takes the last place. Only the first rows of
    each key are moved."""
    marked = rows.withColumn("_o", F.coalesce(outlier, F.lit(False)))
    best = top_per(marked.where("_o"), keys, 1, *order).drop("rank", "_o")
    has = best.select(*keys).withColumn("_has", F.lit(1))
    others = top_per(marked.where("not _o"), keys, k, *order).join(has, keys, "left")
    return others.where(F.col("rank") <= k - F.coalesce("_has", F.lit(0))).select(*rows.columns).unionByName(best.select(*rows.columns))


def cascade(open_keys: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], keys: list[str], id_col: str, k: int) -> DataFrame:
    """(keys, id, stage, rank): up to ``k`` rows per key, filled from the stages in order, within a stage by id; a row
    counts in its first stage only.

    Stages run one after the other. Each is a function of the keys that still lack rows and gives (keys, id) for them,
    so what it reads can be kept to those keys; a stage runs only if a key is left. Results of stages are tables on the
    shared folder; keys that are null get nothing.
    """
    found: DataFrame | None = None
    open_ = cut(open_keys.select(*keys).dropna().distinct().withColumn("lacks", F.lit(k)), "open")
    for i, stage in enumerate(stages):
        if not open_.head(1):
            break
        fresh = stage(open_.select(*keys)).select(*keys, id_col).distinct()
        if found is not None:
            fresh = fresh.join(found, [*keys, id_col], "left_anti")
        fresh = top_per(fresh.join(open_, keys), keys, k, F.col(id_col)).where("rank <= lacks")
        fresh = cut(fresh.select(*keys, id_col, F.lit(i).alias("stage"), (F.lit(k) - F.col("lacks") + F.col("rank")).cast("int").alias("rank")), "stage")
        found = fresh if found is None else found.unionByName(fresh)
        now = found.groupBy(*keys).agg(F.count("*").alias("has"))
        open_ = cut(open_.join(now, keys, "left").select(*keys, (F.lit(k) - F.coalesce("has", F.lit(0))).cast("int").alias("lacks")).where("lacks > 0"), "open")
    return open_keys.select(*keys, F.lit(None).cast("long").alias(id_col), F.lit(0).alias("stage"), F.lit(0).alias("rank")).where("false") if found is None else found


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """The primary rows, and the fallback's for keys without any."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti").select(*primary.columns))


def pinned(sources: Column, relevance: Column, confidence: Column, score: Column, exact_issue: Column, place: Column) -> tuple[Column, Column]:
    """(priority, order) of rows that keep their place whatever a reranker says; a null priority: not pinned.

    A number (3), a fingerprint (2), a pasted text of relevance 0.95 or more, an exact issue of a card among the first
    five places, or high confidence with a score of 50 or more (1 each). Cards go by their place, others come last.
    """
    has = lambda name: F.array_contains(sources, name)
    card = has("case_card_keyword") & F.coalesce(exact_issue, F.lit(False)) & place.between(1, 5)
    high = F.coalesce(confidence == "high", F.lit(False))
    pin = has("case_number") | has("fingerprint") | (has("pasted_text") & (relevance >= 0.95)) | card | (high & (score >= 50))
    priority = F.when(has("case_number"), 3).when(has("fingerprint"), 2).when(has("pasted_text") | card | high, 1).otherwise(0)
    return F.when(F.coalesce(pin, F.lit(False)), priority), F.when(card, place)


def rerank(rows: DataFrame, keys: list[str], k: int, priority: str, pin_order: str, pin_ties: list[Column], place: str, asked: str, outlier: str | None = None) -> DataFrame:
    """Up to ``k`` rows per key with their ``rank``: pinned rows first, then the others in the order that a reranker
    gave (``asked``; null for those it left out, which follow), all ties by ``place``, their order before.

    A key of ``k`` rows or fewer keeps its order. With ``outlier``, a boolean column, the last place is the first
    unpinned outlier's, if pinned rows leave one, and the order asked for counts only if the others do not all fit.
    """
    group = Window.partitionBy(*keys)
    pin, out = F.col(priority).isNotNull(), F.lit(False) if outlier is None else F.coalesce(F.col(outlier), F.lit(False)) & F.col(priority).isNull()
    told = rows.withColumn("_class", F.when(pin, 0).when(out, 2).otherwise(1))
    count = lambda c: F.count_if(F.col("_class") == c).over(group)
    told = told.select("*", F.count("*").over(group).alias("_n"), F.least(count(0), F.lit(k)).alias("_pins"), count(1).alias("_plain"), F.least(count(2), F.lit(1)).alias("_kept"))
    slots = F.lit(k) - F.col("_pins")
    kept = F.when(slots > 0, F.col("_kept")).otherwise(0)
    heard = F.lit(True) if outlier is None else F.col("_plain") > slots - kept
    order = Window.partitionBy(*keys, "_class").orderBy(F.desc(priority), F.asc_nulls_last(F.when(pin, F.col(pin_order))), *pin_ties, F.asc_nulls_last(F.when(heard & ~pin & ~out, F.col(asked))), place)
    told = told.withColumn("_i", F.row_number().over(order))
    first = F.col("_pins")
    rank = F.when(F.col("_n") <= k, F.row_number().over(group.orderBy(place))).when(F.col("_class") == 0, F.when(F.col("_i") <= k, F.col("_i"))).when(F.col("_class") == 1, F.when(F.col("_i") <= slots - kept, first + F.col("_i")))
    rank = rank.otherwise(F.when((F.col("_i") == 1) & (kept > 0), first + F.least(F.col("_plain"), slots - kept) + 1))
    return told.withColumn("rank", rank.cast("int")).where("rank is not null").drop("_class", "_n", "_pins", "_plain", "_kept", "_i")
