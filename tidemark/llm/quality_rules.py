"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can
be trusted, and the posterior probability of quality replaces an all-must-pass filter.

Everything runs as DataFrame functions. A document's votes form a pattern; the label model needs only the number
of documents of each pattern (at most 3 to the power of the number of rules), counted over all documents.

Results for unusual input: null and empty texts have no words and fail the base rule; a text of any length is
counted whole; repeated rows are judged alike; an empty table gives an empty table and the model of the prior;
columns of the input called like a result column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, materialise, words

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_plain_words", "n_sentence_ends", "n_lines")
GOOD, BAD, ABSTAIN = "1", "0", "-"


def _repeated_words(of: Column, grams: Column, ordered: Column, repeated: Column) -> Column:
    """Words covered by windows at the sorted positions ``repeated``."""
    last = F.size(repeated) - 1
    steps = F.transform(repeated, lambda p, i: F.when(i < last, F.least(F.lit(WINDOW), F.element_at(repeated, F.least(i, last - 1) + 2) - p)).otherwise(WINDOW))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules judge by, as long columns; one pass, no shuffle."""
    counts = set(COUNTS)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in counts))
    w, lines, grams, ordered, at = fresh(docs, "__words", "__lines", "__grams", "__ordered", "__at")
    whole = F.coalesce(F.col(text), F.lit(""))
    # each step is a projection of its own: a lambda would evaluate an inlined array again for every element
    df = docs.withColumns({w: words(F.col(text)), lines: F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(grams, F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(WINDOW)))))
    alike = F.size(F.array_distinct(grams)) == F.size(grams)
    pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    df = df.withColumn(ordered, F.when(alike, F.array().cast("array<struct<g:bigint,i:int>>")).otherwise(F.sort_array(pairs)))
    o = F.col(ordered)
    again = F.filter(o, lambda x, i: (F.get(o, i - 1)["g"] == x["g"]) | F.coalesce(F.get(o, i + 1)["g"] == x["g"], F.lit(False)))
    df = df.withColumn(at, F.sort_array(F.transform(again, lambda x: x["i"])))
    n_lines = F.size(lines)
    out = df.withColumns(
        {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")),
            "n_dup_lines": n_lines - F.size(F.array_distinct(lines)),
            "n_repeat_words": F.when(F.size(at) == 0, 0).otherwise(_repeated_words(F.col(w), F.col(grams), o, F.col(at))),
            "n_capitals": F.regexp_count(whole, F.lit(r"\p{Lu}")),
            "n_plain_words": F.regexp_count(whole, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:!?]?(?![^\x20\x09-\x0D])")),
            "n_sentence_ends": F.regexp_count(whole, F.lit(r"\p{L}[.!?](?![^\x20\x09-\x0D])")),
            "n_lines": n_lines,
        }
    )
    return out.drop(w, lines, grams, ordered, at).withColumns({c: F.col(c).cast("long") for c in COUNTS})


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with its counts in place of the text, written to the shared folder: votes refer to each count many
    times, and the optimiser would put the whole expression of a count in each place."""
    return materialise(with_counts(docs, text).drop(text), "counted")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where a condition holds, else abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), BAD).when(F.expr(self.good), GOOD).otherwise(ABSTAIN)


RULES = (
    Rule("symbols", "20 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("duplicate lines", "n_dup_lines = 0", "4 * n_dup_lines > n_lines"),
    Rule("repeated words", "20 * n_repeat_words <= n_words", "10 * n_repeat_words > n_words"),
    Rule("capitals", "10 * n_capitals <= word_chars", "3 * n_capitals > word_chars"),
    Rule("word length", "word_chars BETWEEN 3 * n_words AND 8 * n_words", "word_chars NOT BETWEEN 2 * n_words AND 12 * n_words"),
    Rule("plain words", "10 * n_plain_words >= 9 * n_words", "10 * n_plain_words < 7 * n_words"),
    Rule("sentences", "30 * n_sentence_ends >= n_words", "90 * n_sentence_ends < n_words"),
)


def pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.concat(*(r.vote() for r in rules))


@dataclass(frozen=True)
class LabelModel:
    """``right[j]``: how often rule j, when it votes, is right about good and about bad documents."""

    prior: float
    right: tuple[tuple[float, float], ...]

    def posterior(self, votes: str) -> float:
        """Probability that a document with these votes is good."""
        odds = math.log(self.prior / (1 - self.prior))
        for vote, (on_good, on_bad) in zip(votes, self.right, strict=True):
            if vote == GOOD:
                odds += math.log(on_good / (1 - on_bad))
            elif vote == BAD:
                odds += math.log((1 - on_good) / on_bad)
        return 1 / (1 + math.exp(-max(-700, min(700, odds))))


def fit(counts: dict[str, int], n_rules: int, rounds: int = 50, prior: float = 0.8, weight: float = 20.0) -> LabelModel:
    """Expectation-maximisation over the number of documents of each vote pattern.

    Rules start out as right about 97 of 100 good and 50 of 100 bad documents that they vote on; this belief
    counts as ``weight`` documents, so that a small or one-sided table can't turn the meaning of the classes round.
    """
    start = (0.97, 0.5)
    model = LabelModel(prior, (start,) * n_rules)
    for _ in range(rounds if counts else 0):
        good = {p: n * model.posterior(p) for p, n in counts.items()}
        total = sum(counts.values())
        right = []
        for j in range(n_rules):
            hit, cast = [weight * start[0], weight * start[1]], [weight, weight]
            for p, n in counts.items():
                if p[j] != ABSTAIN:
                    for k, share in enumerate((good[p], n - good[p])):
                        cast[k] += share
                        hit[k] += share * (p[j] == (GOOD, BAD)[k])
            right.append(tuple(min(0.999, max(0.02, h / c)) for h, c in zip(hit, cast, strict=True)))
        model = LabelModel((sum(good.values()) + weight * prior) / (total + weight), tuple(right))
    return model


def fit_on(table: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """The label model of a table made by :func:`counted`; at most 3 ** len(rules) rows come to the driver."""
    found = table.where(~base_failed()).groupBy(pattern(rules).alias("votes")).count().collect()
    return fit({r["votes"]: r["count"] for r in found}, len(rules))


def judge(table: DataFrame, model: LabelModel, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, quality (the posterior) and kept."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for rule, (on_good, on_bad) in zip(rules, model.right, strict=True):
        vote = rule.vote()
        odds = odds + F.when(vote == GOOD, math.log(on_good / (1 - on_bad))).when(vote == BAD, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    quality = 1 / (1 + F.exp(-odds))
    return table.withColumns({"base_failed": base_failed(), "quality": quality}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
