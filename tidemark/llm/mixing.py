"""Mixing sources to target weights with soft domain membership.

A naive Bayes classifier over the presence of a few telling words, trained on a labelled table, gives each document
a posterior over domains. Projected gradient descent then fits a nonnegative rate per document such that the
expected tokens of each domain, the sum of rate * words * posterior, meet the targets in weighted least squares.
Each iteration is one aggregation; a document's rate is a fold of its posterior over the few residual vectors found
so far, so no per-document state is stored or moved. Everything runs as DataFrame functions.

Results for unusual input: null and empty texts have no words, the prior as posterior, and a rate like any other;
texts are read whole; repeated rows count each; an empty table gives an empty table (rates 1); a domain that no
document can belong to can't be met and is left out of the fit; labelled rows with a null domain or text are no
evidence; columns of the input called like a result column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, forget, fresh, materialise

#: Labelled rows that the classifier is trained on (those with the smallest hashes), and its words.
LABELLED, DICTIONARY = 20_000, 64
#: Projected-gradient steps, and the relative residual at which they end.
STEPS, TOLERANCE = 30, 1e-6


def letters(text: Column) -> Column:
    """The distinct runs of letters of a text, in lower case."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    base: tuple[float, ...]  # per domain: log prior and log odds of absence of all words
    weights: dict[str, tuple[float, ...]]  # per word and domain: what its presence adds

    def posterior(self, own: Column) -> Column:
        """Array of domain probabilities, given the array of a document's words."""
        if not self.weights:
            scores = F.array(*(F.lit(b) for b in self.base))
        else:
            table = F.create_map(*(F.lit(x) if i % 2 == 0 else F.array(*(F.lit(v) for v in x)) for w, v in self.weights.items() for i, x in enumerate((w, v))))
            found = F.transform(F.array_intersect(own, F.array(*(F.lit(w) for w in self.weights))), lambda w: F.element_at(table, w))
            scores = F.aggregate(found, F.array(*(F.lit(b) for b in self.base)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
        return F.transform(F.array(scores), lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s))))[0]


def train(labelled: DataFrame, domains: tuple[str, ...], limit: int = LABELLED, n_words: int = DICTIONARY) -> Classifier:
    """Fit the classifier on ``limit`` labelled rows (text, domain): those with the smallest hashes, and equal rows with them."""
    rows = labelled.select("text", "domain").where(F.col("domain").isin(*domains) & F.col("text").isNotNull())
    at = F.xxhash64("text", "domain")
    last = rows.select(at.alias("at")).orderBy("at").limit(limit).agg(F.max("at")).first()[0]
    chosen = rows.where(at <= last) if last is not None else rows.limit(0)
    drawn = materialise(chosen.select("domain", letters(F.col("text")).alias("words")), "labelled")
    sizes = {r["domain"]: r["count"] for r in drawn.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    rate = lambda d: (F.coalesce(F.sum(F.when(F.col("domain") == d, 1)), F.lit(0)) + 1) / (sizes.get(d, 0) + 2)
    seen = drawn.select("domain", F.explode("words").alias("word")).where("word != ''").groupBy("word").agg(F.array(*(rate(d) for d in domains)).alias("p"))
    top = seen.orderBy(F.desc(F.array_max("p") - F.array_min("p")), "word").limit(n_words).collect()
    forget(drawn)
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    base = tuple(b + sum(math.log(1 - r["p"][k]) for r in top) for k, b in enumerate(prior))
    return Classifier(domains, base, {r["word"]: tuple(math.log(p / (1 - p)) for p in r["p"]) for r in top})


def with_posterior(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add n_words and posterior (one probability per domain of the model)."""
    own, raw = fresh(docs, "__own", "__raw")
    docs = docs.drop("n_words", "posterior").withColumn(own, letters(F.col(text))).withColumn(raw, model.posterior(F.col(own)))
    total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
    divided = F.transform(F.arrays_zip(F.col(raw).alias("v"), F.array_repeat(total, len(model.domains)).alias("t")), lambda x: x["v"] / x["t"])
    return docs.withColumns({"n_words": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"), "posterior": divided}).drop(own, raw)


@dataclass(frozen=True)
class Rates:
    """The residual vectors that projected gradient descent has met, in order."""

    residuals: tuple[tuple[float, ...], ...] = ()
    least: float = 0.0

    def column(self) -> Column:
        """The rate of a document: 1, moved against each residual in turn and held at ``least`` or more."""
        if not self.residuals:
            return F.lit(1.0)
        steps = F.array(*(F.array(*(F.lit(float(v)) for v in g)) for g in self.residuals))
        along = lambda g: F.aggregate(F.zip_with(g, F.col("posterior"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(self.least), r - along(g)))


def _totals(scored: DataFrame, rates: Rates, k: int) -> list[float]:
    rated = scored.withColumn("__rate", rates.column())
    return [float(v or 0.0) for v in rated.agg(*(F.sum(F.col("__rate") * F.col("n_words") * F.col("posterior")[i]) for i in range(k))).first()]


def fit(scored: DataFrame, domains: tuple[str, ...], targets: dict[str, float], keep_all: bool = False, steps: int = STEPS) -> Rates:
    """Rates whose expected domain tokens meet the target weights.

    The tokens aimed at are as many as there are, or, with ``keep_all``, the fewest for which no domain shrinks;
    then rates are held at 1 or more instead of 0, and no document is dropped.
    """
    have = _totals(scored, Rates(), len(domains))
    weight = sum(targets[d] for d in domains)
    share = [targets[d] / weight for d in domains]
    budget = max((h / s for h, s in zip(have, share, strict=True) if s), default=0.0) if keep_all else sum(have)
    aim = [s * budget for s in share]
    rates, now = Rates(least=float(keep_all)), have
    for _ in range(steps if sum(have) else 0):
        residual = tuple((n - a) / h if h else 0.0 for n, a, h in zip(now, aim, have, strict=True))
        if max(abs(r) * h for r, h in zip(residual, have, strict=True)) <= TOLERANCE * budget:
            break
        rates = Rates((*rates.residuals, residual), rates.least)
        now = _totals(scored, rates, len(domains))
    return rates


def with_rate(scored: DataFrame, rates: Rates, domains: tuple[str, ...]) -> DataFrame:
    """Add domain (the likeliest), probability (its posterior) and rate."""
    best = F.array_max(F.transform("posterior", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    names = F.array(*(F.lit(d) for d in domains))
    return scored.withColumns({"domain": F.get(names, -best["i"]), "probability": best["p"], "rate": rates.column()})


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: its rate, rounded up or down by its key's hash so that the mean is the rate."""
    share = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + share).cast("int")
