"""A retrieval plan, and hybrid retrieval as one lazy DataFrame program: candidates, fusion, scores, top k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import same_issue, text_similarity
from ..functions.text import tokens, words
from ..operators import keyword


@dataclass(frozen=True)
class RetrievalPlan:
    """What a parsed question asks of retrieval."""

    k: int = 5
    candidates: int = 30
    least_share: float = 0.3
    year: int | None = None
    kinds: tuple[str, ...] = ()

    @property
    def pool(self) -> int:
        """Candidates to rank for k results."""
        return min(30, max(6 * self.k, 18))


def hybrid(queries: DataFrame, docs: DataFrame, plan: RetrievalPlan) -> DataFrame:
    """(query_id, doc_id, shared, similarity, match, rank): the plan's top k documents of each query.

    ``queries``: (query_id, text); ``docs``: (doc_id, text). Candidates share tokens with the query, found over an
    inverted index; of the best ones by coverage the full text similarity decides, and a text that holds the whole
    query counts as a direct match, one of the same issue (``scores.same_issue``) as an equivalent one.
    """
    q = queries.select("query_id", F.col("text").alias("query_text"), tokens(F.col("text")).alias("query_tokens"))
    pairs = keyword.token_overlap(q.select("query_id", F.col("query_tokens").alias("tokens")), docs, "doc_id", "text", plan.least_share)
    by_cover = Window.partitionBy("query_id").orderBy((F.col("shared") / F.col("query_n")).desc(), F.col("doc_n"), "doc_id")
    pool = pairs.withColumn("place", F.row_number().over(by_cover)).where(F.col("place") <= plan.candidates)
    rows = pool.join(q, "query_id").join(docs.select("doc_id", "text"), "doc_id").repartition("query_id", "doc_id")
    rows = rows.withColumn("doc_tokens", tokens(F.col("text"))).withColumn("doc_words", words(F.col("text")))  # columns of their own are made once
    d = F.col("doc_tokens")
    scored = rows.select(
        "query_id", "doc_id", "shared",
        F.round(text_similarity(F.col("query_tokens"), d), 6).alias("similarity"),
        F.when(F.col("text").contains(F.col("query_text")), "direct").when(same_issue(words(F.col("query_text")), F.col("doc_words")), "equivalent").otherwise("partial").alias("match"),
    )
    order = Window.partitionBy("query_id").orderBy((F.col("match") == "direct").desc(), F.desc("similarity"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= plan.k)
