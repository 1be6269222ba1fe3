"""Soft-membership mixing: document rates under which the expected token totals of domains meet target weights.

A classifier learned from a labelled table gives each document posteriors over the domains; a document of n tokens
brings n times its posterior to each domain's total. Rates of ``least`` or more (zero: nonnegative; one: no document
shrinks), as near to one as the targets allow, are fitted by distributed projected-gradient least squares: one
aggregation over the documents a step gives the domains' residual, and the next step's rates follow from it. Only
numbers per domain reach the driver.

All work on documents is DataFrame operations. The classifier is naive Bayes on the presence of words of a bounded
vocabulary (``per_domain`` labelled rows a domain, taken by a hash of the id; the ``vocabulary`` words in most of
them); it reads every word of every text when it predicts.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut


def _words(text: Column) -> Column:
    return F.split(F.lower(text), WHITE)


def _unit(id_col: str) -> Column:
    return F.xxhash64(id_col).bitwiseAND(0xFFFFFF) / float(1 << 24)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", per_domain: int = 1500, vocabulary: int = 300) -> dict:
    """Domains, priors and word weights from labelled rows; rows with a null domain are left out, null texts are empty."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(domain_col).alias("domain")).where("domain is not null")
    counts = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row for each domain
    domains = sorted(counts)
    if not domains:
        return {"domains": [], "rows": [], "words": [], "start": [], "weights": {}}
    share = F.lit(0.0)
    for d, n in counts.items():
        share = F.when(F.col("domain") == d, min(1.0, per_domain / n)).otherwise(share)
    sample = cut(rows.where(_unit("doc_id") < share), "sample")
    size = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    numbered = F.lit(-1)
    for i, d in enumerate(domains):
        numbered = F.when(F.col("domain") == d, i).otherwise(numbered)
    present = sample.select(numbered.alias("d"), F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).where("word <> ''")
    by_domain = present.groupBy("word").agg(F.count("*").alias("n"), F.array(*(F.count_if(F.col("d") == i) for i in range(len(domains)))).alias("by"))
    best = by_domain.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    total = sum(counts.values())
    start, weights = [], {}
    for i, d in enumerate(domains):
        start.append(log(counts[d] / total) + sum(log(1 - (r.by[i] + 0.5) / (size.get(d, 0) + 1)) for r in best))
    for r in best:
        chance = [(r.by[i] + 0.5) / (size.get(d, 0) + 1) for i, d in enumerate(domains)]
        weights[r.word] = [log(c / (1 - c)) for c in chance]
    return {"domains": domains, "rows": [counts[d] for d in domains], "words": [r.word for r in best], "start": start, "weights": weights}


def with_posteriors(docs: DataFrame, model: dict, text_col: str = "text", mark: str = "") -> DataFrame:
    """``docs`` with columns ``mark`` + n_tokens and ``mark`` + posterior (array<double> in the order of the domains).

    Tokens are what white space leaves; null texts have none and the prior as posterior. Each row is computed by itself.
    """
    words, at, scaled = f"{mark}words", f"{mark}at", f"{mark}scaled"
    vocabulary = F.array(*(F.lit(w) for w in model["words"])).cast("array<string>")
    columns = [F.array(*(F.lit(float(v[i])) for v in model["weights"].values())) for i in range(len(model["domains"]))]
    split = docs.withColumn(words, F.array_remove(_words(F.coalesce(F.col(text_col), F.lit(""))), ""))
    found = split.withColumn(at, F.transform(F.array_intersect(words, vocabulary), lambda w: F.array_position(vocabulary, w).cast("int")))
    sums = [F.aggregate(at, F.lit(float(model["start"][i])), _adding(c)) for i, c in enumerate(columns)]
    told = found.withColumn(scaled, F.array(*sums).cast("array<double>"))
    told = told.withColumn(scaled, F.transform(scaled, lambda e: F.exp(e - F.array_max(scaled))))
    whole = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)
    told = told.withColumn(f"{mark}n_tokens", F.size(words).cast("long")).withColumn(f"{mark}posterior", F.transform(scaled, lambda x: x / whole))
    return told.drop(words, at, scaled)


def _adding(weights: Column):
    return lambda total, k: total + F.element_at(weights, k)


def fit_rates(told: DataFrame, size: int, weights: list[float] | None = None, least: float = 1.0, steps: int = 12, tolerance: float = 1e-6) -> tuple[list[float], list[float], list[float]]:
    """Multipliers y such that the rates max(``least``, 1 + y . posterior) meet the targets in the least-squares sense;
    and the targets and totals reached.

    ``weights``: wanted shares of tokens; without them the square roots of the present shares, scaled to one.
    Below a ``least`` of one the targets are these shares of the present total. From one on no row may shrink, so the
    total is not given beforehand: the domain that has most against its share gets no multiplier, and the targets of
    the others follow from what it reaches; domains of weight zero get none either.

    Gradients are summed before they are projected onto rates of ``least`` or more, so a step is one aggregation and
    keeps nothing per document. It is scaled by the inverse of the curvature (``size`` squared numbers) over the rows
    whose rate is above ``least``, as only these move; the same aggregation gives it for the next step. A step after
    which the residual is larger is halved. Steps end when the residual is small, or when steps of the full and of
    halved lengths do not lower it by a thousandth; the multipliers of the smallest residual are returned.
    """
    p = [F.col("posterior")[i] for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    n = F.col("n_tokens")

    def totals(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The totals reached, and the curvature over the rows above the bound."""
        r, free = _at_least(least, p, y.tolist()), _plain(p, y.tolist()) > least
        free = free | F.lit(not y.any())  # at the start all rows may move
        whole = [F.coalesce(F.sum(r * n * x), F.lit(0.0)) for x in p]
        bent = [F.coalesce(F.sum(F.when(free, n * p[i] * p[j])), F.lit(0.0)) for i, j in pairs]
        found = told.agg(F.array(*whole), F.array(*bent)).first()
        gram = np.zeros((size, size))
        for (i, j), v in zip(pairs, found[1], strict=True):
            gram[i, j] = gram[j, i] = v
        return np.array(found[0], dtype=float), gram

    present, gram = totals(np.zeros(size))
    wanted = np.sqrt(present) if weights is None else np.array(weights, dtype=float)
    if not present.sum() or not wanted.sum():
        return [0.0] * size, present.tolist(), present.tolist()
    share, wanted = present / present.sum(), wanted / wanted.sum()
    if least >= 1:
        full = max((i for i in range(size) if wanted[i] > 0), key=lambda i: share[i] / wanted[i])
        free = [i for i in range(size) if wanted[i] > 0 and i != full]
    else:
        full, free = None, list(range(size))

    def apart(reached: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        target = wanted * (present.sum() if full is None else reached[full] / wanted[full])
        return float(np.linalg.norm((reached - target)[free]) / target.max()), (reached - target)[free], target

    y, reached = np.zeros(size), present
    (far, off, target), length, slow = apart(present), 1.0, 0
    for _ in range(steps):
        if far <= tolerance or slow >= 3 or not free:
            break
        bent = gram[np.ix_(free, free)]
        if full is not None:
            bent = bent - np.outer(wanted[free] / wanted[full], gram[full, free])
        trial = y.copy()
        trial[free] -= length * (np.linalg.pinv(bent, rcond=1e-12) @ off)
        now, curved = totals(trial)
        told_far, told_off, told_target = apart(now)
        if told_far < far:
            slow = slow + 1 if told_far > 0.999 * far else 0
            y, reached, gram, far, off, target, length = trial, now, curved, told_far, told_off, told_target, min(1.0, 2 * length)
        else:
            length, slow = length / 4, slow + 1
    return y.tolist(), target.tolist(), reached.tolist()


def _plain(p: list[Column], y: list[float]) -> Column:
    return sum((x * float(v) for x, v in zip(p, y, strict=True)), F.lit(1.0))


def _at_least(least: float, p: list[Column], y: list[float]) -> Column:
    return F.greatest(F.lit(float(least)), _plain(p, y))


def rate(y: list[float], posterior: str = "posterior", least: float = 1.0) -> Column:
    return F.round(_at_least(least, [F.col(posterior)[i] for i in range(len(y))], y), 3)


def copies(y: list[float], id_col: str = "doc_id", posterior: str = "posterior", least: float = 1.0) -> Column:
    """The rate's floor or the next number, by a hash of the id, so that the copies' mean is the rate."""
    unit = F.xxhash64(id_col, F.lit("copies")).bitwiseAND(0xFFFFFF) / float(1 << 24)
    return F.floor(rate(y, posterior, least) + unit).cast("int")


def mix(docs: DataFrame, model: dict, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) for each row of ``docs``.

    ``rate`` is rounded to three places. Without domains all rates are one. Rows repeat as in ``docs``; an empty table
    gives an empty result; other columns are not read.
    """
    told = cut(with_posteriors(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).drop("text"), "posteriors")
    y = fit_rates(told, len(model["domains"]), weights, least)[0]
    return told.select("*", rate(y, least=least).alias("rate"), copies(y, least=least).cast("long").alias("copies"))


def mixed(docs: DataFrame, model: dict, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies tell, with the same columns. Rates are one or more, so none goes.

    The rows are written once with their posteriors, which the fit and the copies then read; no text is shuffled.
    """
    mark = "_" + "".join(docs.columns) + "_"
    told = cut(with_posteriors(docs, model, text_col, mark), "posteriors")
    y = fit_rates(told.select(F.col(f"{mark}n_tokens").alias("n_tokens"), F.col(f"{mark}posterior").alias("posterior")), len(model["domains"]), weights)[0]
    rows = told.withColumn(mark, F.array_repeat(F.lit(0), copies(y, id_col, f"{mark}posterior")))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(mark).alias(f"{mark}copy")).drop(f"{mark}copy")
