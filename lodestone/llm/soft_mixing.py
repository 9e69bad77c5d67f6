"""Mixing to target weights with soft domain membership, in DataFrame expressions only.

A classifier learned from the labelled table gives every document a posterior
over domains. Each document then gets a nonnegative rate (how often it should
be seen) so that the expected tokens of every domain, sum of rate * tokens *
posterior, match its target. The rates come from projected gradient steps on the squared
gaps, starting from rate 1. Each step tries the plain gradient step of length
1/L (L: the largest eigenvalue of the posteriors' second moments), which never
raises the squares, and steps scaled by the second moments of the documents
that are at no bound, with ridges; the one that leaves the smallest squares is
taken, and none if all would leave larger ones. So the squares fall until they
are at their least over nonnegative rates.

A step needs the totals and moments at the rates that it would lead to: one
aggregate of a few numbers for each try and pair of domains. A rate follows
from the posterior alone, so documents of equal posteriors are one row of the
descent, with the tokens of all. The rate is a fold over an array of the steps'
few numbers, so nothing is kept or rewritten between steps, a lost executor
costs its tasks of one aggregate, and the plan of a step does not grow with the
steps before it: the driver compiles it once.

The classifier is a Bernoulli naive Bayes over a bounded vocabulary: words,
and marks for surface traits, that speak most for each domain. It is fitted on
a bounded sample of labelled documents (``fit_docs``, those of the smallest id
hashes); all documents are scored whole.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, written

FIT_DOCS, WORDS_PER_DOMAIN = 6000, 40
#: The descent ends where so many steps together shorten the gaps by at most this share of the budget.
STILL_STEPS, STILL = 12, 1e-5
#: Ridges of the scaled steps, as shares of the moments' trace.
RIDGES = (1e-12, 1e-6, 1e-4, 1e-3, 1e-2, 1e-1)
#: A vocabulary token is at least this many times as frequent in its domain's documents as in the others: words of one language alone say nothing.
ODDS = 4.0
SPACES = r"[\x20\x09-\x0D]+"


def label_domain(quality: Column, toxic: Column) -> Column:
    """The domain that a row of the labelled table names; null if it names none."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")


def _tokens(docs: DataFrame, id_col: str, text_col: str, extra: list[Column]) -> DataFrame:
    """id, ``n_tokens``, ``kinds`` (the distinct words, lower-cased) and ``marks`` (which hold white space, as no word does)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    bare = F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)))
    # Columns that the next step uses more than once are not folded into it, so each is worked out once a row.
    rows = rows.withColumns({"n_tokens": F.size("words").cast("long"), "kinds": F.array_distinct("words")})
    share = lambda pattern: F.length(F.regexp_replace("text", pattern, "")) / F.greatest(F.length("text"), F.lit(1))
    n, kinds = F.col("n_tokens"), F.size("kinds")
    marks = F.array_compact(
        F.array(
            F.when(share(r"[^#*$%&|<>]+") > 0.02, " symbols"),
            F.when(share(r"[^A-Z]+") > 0.3, " upper"),
            F.when((n >= 20) & (kinds < 0.3 * n), " repeats"),
        )
    )
    return rows.withColumn("marks", marks).drop("words", "text")


@dataclass
class DomainModel:
    """``domains``; log priors; for each vocabulary token the log odds shift of each domain where it is present; the sums where all are absent."""

    domains: list[str]
    prior: list[float]
    absent: list[float]
    shifts: dict[str, list[float]]

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds ``p``, array<double> over ``domains``, to rows with ``kinds`` and ``marks``, and drops these."""
        base = [p + a for p, a in zip(self.prior, self.absent, strict=True)]
        score = F.array(*map(F.lit, base))
        if self.shifts:
            names = sorted(self.shifts)
            known = F.array(*map(F.lit, names))
            held = F.concat(F.array_intersect("kinds", known), F.array_intersect("marks", known))
            table = F.map_from_arrays(known, F.array(*(F.array(*map(F.lit, self.shifts[w])) for w in names)))
            score = F.aggregate(held, score, lambda a, w: F.zip_with(a, table[w], lambda x, y: x + y))
        rows = rows.withColumn("score", score).drop("kinds", "marks")
        top = F.array_max("score")
        rows = rows.withColumn("odds", F.transform("score", lambda x: F.exp(x - top))).drop("score")
        total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
        return rows.withColumn("p", F.transform("odds", lambda x: x / total)).drop("odds")


def fit_domains(
    docs: DataFrame,
    labelled: DataFrame,
    domains: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    fit_docs: int = FIT_DOCS,
    words: int = WORDS_PER_DOMAIN,
) -> DomainModel:
    """Learn from at most ``fit_docs`` labelled documents; a document with several labels takes the first in the alphabet.

    ``words`` is the size of the model: the tokens that speak most for each domain are its features.
    """
    known = labelled.where(F.col(id_col).isNotNull() & F.col(domain_col).isin(domains)).groupBy(F.col(id_col).alias("known_id")).agg(F.min(domain_col).alias("domain"))
    known = known.orderBy(F.xxhash64("known_id"), "known_id").limit(fit_docs)
    # At most fit_docs rows of an id and a name: the bound of this broadcast.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("known_id"))
    at = scratch(docs.sparkSession, "domain-sample")
    sample = written(_tokens(sample, "id", "text", [F.col("domain")]), at)
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    if not total:
        return DomainModel(domains, prior, [0.0] * len(domains), {})
    counts = sample.select("domain", F.explode(F.concat("kinds", "marks")).alias("token")).groupBy("token").pivot("domain", domains).count().na.fill(0)
    n = {d: sizes.get(d, 0) for d in domains}
    share = {d: (F.col(f"`{d}`") + 0.5) / (n[d] + 1) for d in domains}
    held = sum((F.col(f"`{d}`") for d in domains), F.lit(0))
    wanted: dict[str, dict] = {}
    for d in domains:
        rest = (held - F.col(f"`{d}`") + 0.5) / (total - n[d] + 1)
        best = counts.withColumn("gain", share[d] * F.log(share[d] / rest)).where((F.col(f"`{d}`") >= max(3.0, 0.02 * n[d])) & (share[d] >= ODDS * rest)).orderBy(F.desc("gain"), "token").limit(words)
        wanted |= {r["token"]: r for r in best.collect()}
    absent, shifts = [0.0] * len(domains), {w: [] for w in wanted}
    for k, d in enumerate(domains):
        for w, r in wanted.items():
            p = (r[d] + 0.5) / (n[d] + 1)
            absent[k] += math.log(1 - p)
            shifts[w].append(math.log(p / (1 - p)))
    return DomainModel(domains, prior, absent, shifts)


def _moved(rate: Column, p: list[Column], step: list[Column], top: float | None) -> Column:
    """A rate moved against a step, between 0 and ``top``."""
    moved = F.greatest(F.lit(0.0), rate - sum((x * g for x, g in zip(p[1:], step[1:], strict=True)), p[0] * step[0]))
    return moved if top is None else F.least(F.lit(float(top)), moved)


def _listed(steps: list[list[float]]) -> Column:
    """Steps as one array of structs ``g0``, ``g1``, ...: data of the plan, not part of its code."""
    return F.array(*(F.struct(*(F.lit(float(g)).alias(f"g{i}") for i, g in enumerate(step))) for step in steps))


def _rate(p: list[Column], steps: list[list[float]], top: float | None = None) -> Column:
    """Rate 1, moved against each step in turn."""
    if not steps:
        return F.lit(1.0)
    return F.aggregate(_listed(steps), F.lit(1.0), lambda rate, step: _moved(rate, p, [step[f"g{i}"] for i in range(len(p))], top))


def _sums(alike: DataFrame, k: int, steps: list[list[float]], tries: list[list[float]], top: float | None) -> DataFrame:
    """For each try, after the steps: ``at``, the totals of the k domains, and the moments of rows within bounds."""
    p = [F.col(f"p{i}") for i in range(k)]
    rated = alike.select("n_tokens", *p, _rate(p, steps, top).alias("base"), F.posexplode(_listed(tries)).alias("at", "step"))
    rated = rated.select("n_tokens", *p, "at", _moved(F.col("base"), p, [F.col(f"step.g{i}") for i in range(k)], top).alias("rate"))
    within = F.col("rate") > 0 if top is None else (F.col("rate") > 0) & (F.col("rate") < top)
    sums = [F.col("rate") * F.col("n_tokens") * x for x in p]
    sums += [F.when(within, F.col("n_tokens")).otherwise(0) * x * y for x in p for y in p]
    return rated.groupBy("at").agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in sums))


@dataclass
class Fit:
    """The steps of the descent, each domain's gap at the end (share of the budget), whether all are within the tolerance, and all gaps' length by step."""

    steps: list[list[float]]
    gaps: list[float]
    met: bool
    lengths: list[float]


def descend(evaluate: Callable[[list[list[float]], list[list[float]]], np.ndarray], targets: list[float], tolerance: float = 1e-4) -> Fit:
    """Steps of the descent. ``evaluate(steps, tries)`` gives for each try, after the steps, the totals and the moments of documents within bounds."""
    wanted = np.array(targets, dtype=float)
    k, budget = len(targets), max(wanted.sum(), 1.0)
    steps: list[list[float]] = []
    row = evaluate(steps, [[0.0] * k])[0]
    gap, answer = row[:k] - wanted, row[k:].reshape(k, k)
    widest = max(float(np.linalg.eigvalsh(answer)[-1]), 1e-300)
    lengths = [float(np.linalg.norm(gap)) / budget]
    while True:
        if (np.abs(gap) <= tolerance * budget).all():
            return Fit(steps, (gap / budget).tolist(), True, lengths)
        if len(lengths) > STILL_STEPS and lengths[-1 - STILL_STEPS] - lengths[-1] <= STILL:
            return Fit(steps, (gap / budget).tolist(), False, lengths)
        inside = max(float(np.linalg.eigvalsh(answer)[-1]), 1e-300)
        trace = np.trace(answer) + 1e-300
        tries = [gap / widest, gap / inside, *(np.linalg.solve(answer + ridge * trace * np.eye(k), gap) for ridge in RIDGES)]
        tries = [t.tolist() for t in tries if np.isfinite(t).all()]
        rows = evaluate(steps, tries)
        left = np.linalg.norm(rows[:, :k] - wanted, axis=1) / budget
        best = int(left.argmin())
        if left[best] < lengths[-1]:
            steps.append(tries[best])
            gap, answer = rows[best, :k] - wanted, rows[best, k:].reshape(k, k)
        lengths.append(min(float(left[best]), lengths[-1]))


def fit_rates(scored: DataFrame, targets: list[float], tolerance: float = 1e-4, top: float | None = None) -> Fit:
    """Steps that bring the domains' expected tokens to ``targets`` (tokens), over (n_tokens, p), with rates up to ``top``.

    They go on until every gap is within ``tolerance`` of the budget, or until
    twelve steps together no longer shorten the gaps: no nonnegative rates come
    (noticeably) closer then. The gaps are never longer than at rate 1.
    """
    k = len(targets)
    alike = scored.groupBy(*(F.get("p", i).alias(f"p{i}") for i in range(k))).agg(F.sum("n_tokens").alias("n_tokens"))
    alike = written(alike, scratch(scored.sparkSession, "alike"))

    def evaluate(steps: list[list[float]], tries: list[list[float]]) -> np.ndarray:
        out = np.zeros((len(tries), k + k * k))
        for row in _sums(alike, k, steps, tries, top).collect():
            out[row[0]] = row[1:]
        return out

    return descend(evaluate, targets, tolerance)


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    total: float | None = None,
    keep_total_of: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    fit_docs: int = FIT_DOCS,
    words: int = WORDS_PER_DOMAIN,
    keep: tuple[str, ...] = (),
    slack: float = 0.0,
    max_rate: float | None = None,
    report: dict[str, float] | None = None,
) -> DataFrame:
    """Per row: id, ``n_tokens`` (words), ``p`` (posterior in the order of ``weights``), ``rate`` and ``copies``.

    ``weights`` are each domain's wanted share of the expected tokens. The
    budget is ``total`` tokens; without it, as many as there are; with
    ``keep_total_of`` the budget under which that domain keeps the tokens it
    has. ``copies`` rounds the rate up or down by a hash of id and text, so
    that it is right on average. With ``slack`` a rate that close to a whole
    number of at least 1 is that number: such documents stay as they are, and
    only rates near 0 and between whole numbers are drawn.

    Targets that no nonnegative rates meet (a domain without tokens, say) are
    met as closely as the least squares allow, never worse than rate 1 meets
    them; a warning names the gaps. ``max_rate`` bounds the rates, and with them
    the copies of a document. A ``report`` dictionary takes each domain's gap as
    a share of the budget, and the number of "steps".

    A null or empty text has no tokens; its rate is its posterior's. Repeated
    rows get equal rates and copies. Null ids are scored. Where nothing is
    labelled, posteriors are equal. An empty table gives an empty result.
    ``keep`` names columns to carry along; others are not read.
    """
    domains = list(weights)
    model = fit_domains(docs, labelled, domains, id_col, text_col, domain_col, fit_docs, words)
    chance = F.pmod(F.xxhash64(id_col, text_col, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    carried = [F.col(x).alias(f"keep_{x}") for x in keep]
    rows = _tokens(docs, id_col, text_col, [chance.alias("chance"), *carried])
    # Written once, with what is carried along: the steps read the few numbers of a document alone, and no later filter works a posterior out again.
    scored = written(model.scored(rows), scratch(docs.sparkSession, "posteriors"))
    held = [float(x or 0) for x in scored.agg(*(F.sum(F.col("n_tokens") * F.get("p", k)).alias(f"t{k}") for k in range(len(domains)))).first()]
    share = sum(weights.values())
    if total is None:
        total = held[domains.index(keep_total_of)] * share / weights[keep_total_of] if keep_total_of else sum(held)
    fit = fit_rates(scored, [total * w / share for w in weights.values()], top=max_rate)
    gaps = dict(zip(domains, fit.gaps, strict=True))
    if report is not None:
        report.update(gaps)
        report["steps"] = len(fit.lengths) - 1
    if not fit.met:
        warnings.warn(f"no nonnegative rates meet the targets; gaps as shares of the budget: {gaps}", stacklevel=2)
    whole = F.round("rate")
    near = (whole >= 1) & (F.abs(F.col("rate") - whole) <= slack)
    copies = F.when(near, whole).otherwise(F.floor(F.col("rate") + F.col("chance"))).cast("long")
    out = scored.withColumn("rate", _rate([F.get("p", k) for k in range(len(domains))], fit.steps, max_rate))
    return out.withColumn("copies", copies).select(F.col("id").alias(id_col), "n_tokens", "p", "rate", "copies", *(F.col(f"keep_{x}").alias(x) for x in keep))
