"""Shaping of records: tolerant JSON, card normalisation, expansion of queries, coverage of issues, projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

OUTCOMES = ("upheld", "dismissed", "partial", "remanded", "unclear")


def loose_json(text: Column, schema: str, required: str) -> Column:
    """The first object of a model's output, with or without fences around it; null if the required key is missing."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "```(json)?", "")
    parsed = F.from_json(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), schema)
    return F.when(parsed[required].isNotNull(), parsed)


def normal_card(issue: Column, holding: Column, stated: Column, found: Column, outcome: Column, most: int = 500, articles: int = 10) -> Column:
    """Capped texts, the stated articles with the first ten found ones, and an outcome of the known five."""
    return F.struct(
        F.substring(F.coalesce(issue, F.lit("")), 1, most).alias("issue"),
        F.substring(F.coalesce(holding, F.lit("")), 1, most).alias("holding"),
        F.array_union(stated, F.slice(found, 1, articles)).alias("articles"),
        F.when(F.lower(outcome).isin(*OUTCOMES), F.lower(outcome)).otherwise("unclear").alias("outcome"),
    )


def expanded(query: Column, rules: list[tuple[str, list[str]]], most: int = 24) -> Column:
    """The query's words, then the terms of every rule whose phrase it holds; each once, ``most`` in all."""
    low = F.lower(F.coalesce(query, F.lit("")))
    none = F.array().cast("array<string>")
    extra = [F.when(low.contains(phrase), F.array(*map(F.lit, terms))).otherwise(none) for phrase, terms in rules]
    return F.slice(F.array_distinct(F.concat(words(query), *extra)), 1, most)


def issue_addressed(answer: Column, title: Column, keywords: Column) -> Column:
    """A title word of four letters or a keyword of three occurs in the answer."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.filter(words(title), lambda w: F.length(w) >= 4), lambda w: low.contains(w)) | F.exists(F.filter(keywords, lambda w: F.length(w) >= 3), lambda w: low.contains(w))


def project(items: Column, *names: str) -> Column:
    """An array of structs with these fields only."""
    return F.transform(items, lambda s: F.struct(*(s[n].alias(n) for n in names)))


def stated_limit(sentence: Column, operator_words: dict[str, str]) -> tuple[Column, Column]:
    """(operator, number) that a sentence states, by the first operator word it holds."""
    op = F.lit(None).cast("string")
    for word, symbol in reversed(operator_words.items()):
        op = F.when(F.lower(sentence).contains(word), symbol).otherwise(op)
    return op, F.try_to_number(F.regexp_extract(sentence, "([0-9]+)", 1), F.lit("999999999999")).cast("long")
