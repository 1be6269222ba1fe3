"""Rules as data: query parsing, alias references, lists of tags, status machines, fact extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def years(text: Column, low: int = 1900, high: int = 2100) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda n: F.when(F.length(n) == 4, n.cast("int")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(low, high))))


def relevant_year(stated: Column, parsed: Column, dated: Column, as_of: int) -> Column:
    return F.coalesce(stated, parsed, dated, F.lit(as_of))


def tag_list(text: Column) -> Column:
    """Tags separated by ; or , without sub-numbers (6-1 is 6), but for protocols (P1-1 stays); each once."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda s: F.upper(F.btrim(s)))
    plain = F.transform(parts, lambda s: F.when(s.startswith("P"), s).otherwise(F.regexp_replace(s, "-[0-9]+$", "")))
    return F.array_distinct(F.filter(plain, lambda s: s != ""))


def source_status(routed: Column, needed: Column, attempted: Column, failed: Column, found: Column) -> Column:
    return (
        F.when(~needed, "not_needed")
        .when(~routed, "not_routed")
        .when(~attempted, "not_attempted")
        .when(failed, "failed")
        .when(found > 0, "found")
        .otherwise("not_found")
    )


def authority_kind(level: Column, joint: Column, direct: Column) -> Column:
    return F.when(~direct, "supporting").when(joint, "binding_full_chamber").when(level == 1, "persuasive_supreme").when(level == 2, "appellate").otherwise("lower")


def alias_references(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, alias): for every name the longest of its aliases that a text holds."""
    from ..operators.fuse import first_by
    from ..operators.keyword import terms_in

    hits = terms_in(aliases, texts.select(id_col, text_col), "alias", text_col)
    return first_by(hits.select(id_col, "name", "alias"), [id_col, "name"], F.desc(F.length("alias")), F.col("alias"))


AMOUNT = re.compile(r"(?<![\w.])(\d{1,3}(?:[ ,]\d{3})+|\d+)(?:\.(\d{1,2}))?")
UNITS = {"day": ("day", "days", "tag", "tage", "jour", "jours"), "month": ("month", "months", "monat", "mois"), "year": ("year", "years", "jahr", "an", "ans")}
MONEY = ("eur", "euro", "usd", "dollar", "€", "$")


def facts(text: str, window: int = 12) -> list[tuple[str, float, int]]:
    """(kind, value, offset): numbers with a currency or a unit of time within ``window`` characters after or before."""
    out = []
    low = text.lower()
    for m in AMOUNT.finditer(low):
        after, before = low[m.end() : m.end() + window].split(), low[max(0, m.start() - window) : m.start()].split()
        value = float(re.sub("[ ,]", "", m[1]) + (f".{m[2]}" if m[2] else ""))
        near = (after[:1] or [""])[0].strip(".,;:"), (before[-1:] or [""])[0].strip(".,;:")
        if any(n in MONEY for n in near):
            out.append(("money", value, m.start()))
        out += [(unit, value, m.start()) for unit, names in UNITS.items() if near[0] in names]
    return out


def extract_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, value, offset) of every fact in every text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in facts(t or "")]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32())], [id_col, "kind", "value", "offset"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, kind string, value double, offset int")


def tagged(text: Column, tags: list[tuple[str, list[str]]], every: tuple[str, ...] = ()) -> Column:
    """The tags of which a needle occurs (of those in ``every``: all needles), in order."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def holds(name: str, needles: list[str]) -> Column:
        out = F.lit(name in every)
        for n in needles:
            out = out & low.contains(n) if name in every else out | low.contains(n)
        return out

    return F.array_compact(F.array(*(F.when(holds(n, ws), F.lit(n)) for n, ws in tags)))


def numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, digits) of numbers that stand by themselves: a run of digits, or one of up to three and runs of just
    three behind it with one blank between, and a fraction behind a point or comma. What touches a letter or a further
    digit is no part of a number."""
    runs = [m.span() for m in re.finditer("[0-9]+", text)]
    free = lambda at: at < 0 or at >= len(text) or not text[at].isalnum()
    i = 0
    while i < len(runs):
        start, end = runs[i]
        i += 1
        if not free(start - 1) or not free(end):
            continue
        group = end - start <= 3
        while group and i < len(runs) and runs[i][0] == end + 1 and text[end].isspace() and runs[i][1] - runs[i][0] == 3 and free(runs[i][1]):
            end = runs[i][1]
            i += 1
        whole = "".join(text[start:end].split())
        if i < len(runs) and runs[i][0] == end + 1 and text[end] in ".," and free(runs[i][1]):
            whole, end = f"{whole}.{text[runs[i][0] : runs[i][1]]}", runs[i][1]
            i += 1
        yield start, end, whole


#: Digits of a sum; what is longer is an identifier, and no 64-bit number holds it.
LONGEST = 15


def claims(text: str, currency: tuple[str, ...], context: tuple[str, ...], kinds: list[tuple[str, tuple[str, ...]]], default: str) -> list[tuple[str, int, int]]:
    """(kind, value, offset) of sums: numbers above zero, of ``LONGEST`` digits at most, without their fraction, with a currency within 70 characters behind their start
    and a word of ``context`` within 180 before or 140 behind it. The kind is that whose keyword stands nearest before,
    within 220 characters, the first of equals; ``default`` if none does."""
    out, low = [], text.lower()
    for at, _, written in numbers(low):
        value = int(float(written)) if len(written.partition(".")[0]) <= LONGEST else 0
        if value <= 0 or not any(c in low[at : at + 70] for c in currency) or not any(c in low[max(0, at - 180) : at + 140] for c in context):
            continue
        before = low[max(0, at - 220) : at]
        near = [(max(before.rfind(w) for w in words), -i, kind) for i, (kind, words) in enumerate(kinds)]
        best = max(near, default=(-1, 0, default))
        out.append((best[2] if best[0] >= 0 else default, value, at))
    return out


def deadlines(text: str, units: dict[str, tuple[str, ...]], kinds: list[tuple[str, tuple[str, ...]]], default: str) -> list[tuple[str, int, str, int]]:
    """(kind, value, unit, offset): whole numbers of up to four digits above zero with a unit's word behind them, blanks
    or a dash between. The kind is the first with a keyword within 80 characters before or 100 behind the number."""
    out, low = [], text.lower()
    for at, end, written in numbers(low):
        behind = low[end:].lstrip(" \t\n\r\xa0").removeprefix("-").removeprefix("–").lstrip(" \t\n\r")
        word = re.match(r"\w*", behind)[0]
        unit = next((u for u, names in units.items() if word in names), None)
        if unit is None or not written.isdigit() or len(low[at:end]) > 4 or not int(written):
            continue
        around = low[max(0, at - 80) : at + 100]
        out.append((next((k for k, words in kinds if any(w in around for w in words)), default), int(written), unit, at))
    return out


def extract_deadlines(docs: DataFrame, id_col: str, text_col: str, **rules) -> DataFrame:
    """(id, kind, value, unit, offset) of every deadline in every text (see ``deadlines``)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *d) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in deadlines(t or "", **rules)]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int32())], [id_col, "kind", "value", "unit", "offset"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, kind string, value long, unit string, offset int")


def coverage_gaps(issues: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """(key, issue, law, missing): for each issue that a key raises and each law that the issue is expected to rest on,
    the expected articles that were not found for the key, sorted; no row where none is missing. A law without expected
    articles is missing as a whole (an empty list) if nothing of it was found.

    ``issues``: (key, issue); ``found``: (key, law, article); ``expected``: (issue, law, article), a null article for a
    law as a whole.
    """
    wanted = issues.select("key", "issue").distinct().join(expected.distinct(), "issue")
    laws = found.select("key", "law").distinct().withColumn("_law", F.lit(True))
    hits = found.select("key", "law", "article").distinct().withColumn("_hit", F.lit(True))
    told = wanted.join(laws, ["key", "law"], "left").join(hits, ["key", "law", "article"], "left")
    lacking = told.where(F.when(F.col("article").isNull(), F.col("_law").isNull()).otherwise(F.col("_hit").isNull()))
    return lacking.groupBy("key", "issue", "law").agg(F.array_sort(F.collect_set("article")).alias("missing"))


def extract_claims(docs: DataFrame, id_col: str, text_col: str, **rules) -> DataFrame:
    """(id, kind, value, offset) of every claim in every text (see ``claims``)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in claims(t or "", **rules)]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())], [id_col, "kind", "value", "offset"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, kind string, value long, offset int")
