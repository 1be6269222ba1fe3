"""Scoring formulas as Column expressions. Every threshold is a fixed value of the ranking model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_score(most: Column, mean: Column, parent_hit: Column | None = None, card: Column | None = None) -> Column:
    """0.7 max + 0.3 mean; raised by a hit on the parent itself (x 1.15) or by its card's score (0.62 + 0.34 card)."""
    out = 0.7 * most + 0.3 * mean
    if parent_hit is not None:
        out = F.greatest(out, F.when(parent_hit > 0, F.least(F.lit(1.0), 1.15 * parent_hit)))
    if card is not None:
        out = F.greatest(out, F.when(card > 0, F.least(F.lit(1.0), 0.62 + 0.34 * card)))
    return out


def coverage(query: Column, target: Column) -> Column:
    """Share of the query's tokens that the target has; 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, target)) / F.size(query)).otherwise(0.0)


def same_issue(expected: Column, candidate: Column, least: int = 4, share: float = 0.92) -> Column:
    """Whether two texts, given by their words, are of one issue: the same words in the same order, or ``share`` of the
    expected text's distinct words of four letters or more among the candidate's, of which both have ``least`` or more.
    A text without words is of none."""
    long = lambda w: F.array_distinct(F.filter(w, lambda x: F.length(x) >= 4))
    e, c = long(expected), long(candidate)
    return (F.size(expected) > 0) & (F.size(candidate) > 0) & ((expected == candidate) | ((F.size(e) >= least) & (F.size(c) >= least) & (coverage(e, c) >= share)))


def card_score(query: Column, issue: Column, holding: Column, category: Column) -> Column:
    return F.greatest(coverage(query, issue), 0.75 * coverage(query, holding), 0.45 * coverage(query, category))


def text_similarity(query: Column, target: Column, most: int = 35) -> Column:
    """0.55 query coverage + 0.35 target coverage + 0.10 Jaccard, over the query's first ``most`` tokens."""
    q = F.slice(query, 1, most)
    shared, either = F.size(F.array_intersect(q, target)), F.size(F.array_union(q, target))
    value = 0.55 * shared / F.size(q) + 0.35 * shared / F.size(target) + 0.10 * shared / either
    return F.when(shared > 0, F.least(F.lit(1.0), value)).otherwise(0.0)


def authority(level: Column, year: Column, joint: Column, as_of: int) -> Column:
    """Court level 1, 2, other: 800, 400, 200; 25 a year since 2010, 350 at most; 300 for a joint chamber."""
    court = F.when(level == 1, 800).when(level == 2, 400).otherwise(200)
    recent = F.when(year.between(2010, as_of), F.least(F.lit(350), (year - 2010) * 25)).otherwise(0)
    return court + recent + F.when(joint, 300).otherwise(0)


def combined(relevance: Column, authority_: Column, outlier: Column, advocate: Column | None = None) -> Column:
    base = 0.6 * relevance + 0.4 * authority_ / 1450
    damped = outlier if advocate is None else outlier & ~advocate
    return F.round(F.when(damped, base * 0.7).otherwise(base), 4)


def rank_bonus(rank: Column) -> Column:
    return F.when(rank == 1, 8.0).when(rank == 2, 6.0).when(rank == 3, 4.5).when(rank <= 5, 3.0).when(rank <= 8, 1.5).otherwise(0.0)


def clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def semantic_relevance(issue: Column, holding: Column, facts: Column, articles: Column, concepts: Column, relevance: Column, rank: Column, combined_: Column, floor: Column) -> Column:
    """0 to 100 from matches of parts; a direct source gives a floor."""
    value = 40 * issue + 20 * holding + 15 * facts + 10 * articles + 5 * concepts + 7 * clip(relevance) + rank_bonus(rank) + 3 * clip(combined_)
    return F.least(F.lit(100.0), F.greatest(value, floor))


def match_confidence(score: Column, lead: Column, direct: Column) -> Column:
    high = (direct >= 2) | ((score >= 70) & (lead >= 8)) | ((score >= 50) & (lead >= 10)) | ((score >= 45) & (lead >= 15))
    return F.when(high, "high").when(score >= 45, "medium").otherwise("low")


def retrieval_confidence(most: Column, mean: Column, parents: Column, chunks: Column, variance: Column) -> Column:
    one = F.lit(1.0)
    return 0.5 * most + 0.25 * mean + 0.1 * F.least(one, parents / 3) + 0.1 * F.least(one, chunks / 10) + 0.05 * F.greatest(F.lit(0.0), 1 - F.least(one, 10 * variance))


def confidence_label(score: Column, most: Column) -> Column:
    return F.when((score >= 0.70) & (most >= 0.65), "high").when((score >= 0.50) | (most >= 0.50), "medium").when(score > 0, "low").otherwise("none")


def outcome(text: Column) -> Column:
    """granted, denied, stopped or empty; negations are tested first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("not granted") | low.contains("denied") | low.contains("dismissed"), "denied").when(low.contains("granted") | low.contains("upheld"), "granted").when(low.contains("stopped") | low.contains("discontinued"), "stopped").otherwise("")


def flag_score(high: Column, medium: Column, low: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 30 * high - 15 * medium - 5 * low)


def flag_verdict(score: Column, high: Column, flags: Column) -> Column:
    return F.when((high > 0) | (score < 60), "fail").when((flags > 0) | (score < 85), "warn").otherwise("pass")


def answer_score(retrieval: Column, verdict: Column, unflagged: Column, reference: Column) -> Column:
    return 50 * retrieval + F.when(verdict == "pass", 30).when(verdict == "warn", 15).otherwise(0) + F.when(unflagged, 10).otherwise(0) + F.when(reference, 10).otherwise(0)


def answer_status(score: Column, verdict: Column) -> Column:
    return F.when(verdict == "fail", "fail").when(score >= 85, "pass").when(score >= 65, "warn").otherwise("fail")


def issue_score(any_hits: Column, all_groups: Column, domain: Column, priority: Column) -> tuple[Column, Column]:
    """(score, confidence) of a rule: any-keyword hits, all keyword groups, the domain."""
    score = F.when(any_hits > 0, F.least(F.lit(45), 20 + 5 * any_hits)).otherwise(0) + F.when(all_groups, 45).otherwise(0) + F.when(domain, 10).otherwise(0)
    return score, F.least(F.lit(100), score + F.least(F.lit(20), F.floor(priority / 10)))


def complexity(length: Column, exact_article: Column, exact_number: Column, simple_rule: Column, issues: Column, complex_: Column, domains: Column, norms_and_cases: Column, sources: Column, mode: Column, fact_pattern: Column, questions: Column) -> tuple[Column, Column]:
    """(score 0 to 100, level): 40 and signals; up to 30 is the fast level, from 61 the full one, between them normal."""
    raw = (
        F.lit(40)
        + F.when(length <= 160, -10).when(length > 500, 25).when(length > 250, 15).otherwise(8)
        - F.when(exact_article, 18).otherwise(0)
        - F.when(exact_number, 18).otherwise(0)
        - F.when(simple_rule, 18).otherwise(0)
        + F.when((issues >= 3) | complex_, 22).when(issues > 0, 8).otherwise(0)
        + F.when(domains > 1, 12).otherwise(0)
        + F.when(norms_and_cases, 8).otherwise(0)
        + F.when(sources == 1, -8).when(sources > 2, 5).otherwise(0)
        + F.when(mode == "compare", 15).when(mode.isin("advise", "advocate"), 12).when(mode.isin("find", "explain"), -5).otherwise(0)
        + F.when(fact_pattern & ~simple_rule, 15).otherwise(0)
        + F.when(questions > 1, 8).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    return score, F.when(score <= 30, "fast").when(score >= 61, "full").otherwise("normal")


def token_cost(tokens_in: Column, cached: Column, tokens_out: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """Cost by prices for a million tokens."""
    return ((tokens_in - cached) * price_in + cached * price_cached + tokens_out * price_out) / 1e6
