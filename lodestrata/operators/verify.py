"""Checks of texts against their sources: set differences, flags, deterministic rewrites, threshold rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import flag_score, flag_verdict


def extracted(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)))


def unsupported(found: Column, valid: Column) -> Column:
    """What is cited but not in the sources."""
    return F.array_except(found, F.coalesce(valid, F.array().cast("array<string>")))


def verdicts(flags: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    """Per key score and verdict from a table of flags with severities high, medium and low; a null severity counts as no flag."""
    n = {s: F.count_if(F.col(severity) == s) for s in ("high", "medium", "low")}
    agg = flags.groupBy(key).agg(*(v.alias(f"n_{k}") for k, v in n.items()))
    score = flag_score(F.col("n_high"), F.col("n_medium"), F.col("n_low"))
    return agg.withColumn("score", score).withColumn("verdict", flag_verdict(F.col("score"), F.col("n_high"), F.col("n_high") + F.col("n_medium") + F.col("n_low")))


def rewrite(text: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(new text, names of the rules that changed it): literal replacements (name, old, new) in order."""
    names, out = [], text
    for name, old, new in rules:
        names.append(F.when(out.contains(old), F.lit(name)))
        out = F.replace(out, F.lit(old), F.lit(new))
    return out, F.array_compact(F.array(*names))


def threshold_holds(value: Column, operator: Column, threshold: Column) -> Column:
    """value operator threshold, the operator being data: < <= > >= = ==; null for others."""
    return (
        F.when(operator == "<", value < threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == ">", value > threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator.isin("=", "=="), value == threshold)
    )


def phrase_flags(texts: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str, str, str, int, str]]) -> DataFrame:
    """(id, flag, severity) of each rule (flag, severity, anchor, phrase, within, excuse) that a text breaks: the phrase
    stands within so many characters behind the anchor, or before it, and the excuse nowhere in the text. Anchor, phrase
    and excuse are patterns; an empty excuse excuses nothing."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    flags = []
    for flag, severity, anchor, phrase, within, excuse in rules:
        near = low.rlike(f"(?s)(?:{anchor}).{{0,{within}}}(?:{phrase})|(?:{phrase}).{{0,{within}}}(?:{anchor})")
        hit = near & ~low.rlike(excuse) if excuse else near
        flags.append(F.when(hit, F.struct(F.lit(flag).alias("flag"), F.lit(severity).alias("severity"))))
    return texts.select(id_col, F.explode(F.array_compact(F.array(*flags))).alias("f")).select(id_col, "f.flag", "f.severity")
