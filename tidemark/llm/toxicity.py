"""Toxicity: a linear-chain conditional random field tags toxic spans, and its marginals score documents.

Labels are of documents; labelled tokens follow from them. A unit is a word or the first letters of one. Units that
occur in toxic documents far more often than in others, after more than a few different words (so that copies of one
document are no evidence), make the lexicon; in toxic documents the words that have such units are tagged toxic, all
other words not. The field has weights for the units of a word and for the transitions of two tags, and is trained on
windows around lexicon words and on windows without any. Forward-backward gives the probability of each lexicon word
to be toxic in its text; a logistic function of their sum and maximum, fitted on the labelled documents, is the score.

Between lexicon words all words look alike to the field, so a gap is a power of one matrix, and a text costs as many
steps as it has lexicon words, exactly as if each word had been visited.

Results for unusual input: null and empty texts have no spans and the score of a text without lexicon words; texts are
read whole; repeated rows are scored alike; labels that are null or contradict each other count as toxic if any says
so; without labels the score is 0 everywhere; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents learned from, at most (those with the smallest hashes of their ids), and units of the lexicon.
LABELLED, LEXICON = 20_000, 2_000
#: Different words before a unit in toxic documents, at least, and the share of all such words that are in toxic ones.
SUPPORT, PRECISION = 5, 0.9
RADIUS = 3
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)


def units(word: str) -> list[str]:
    """The word, and its first letters where it is longer."""
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) > n)]


@dataclass(frozen=True)
class Field:
    """Weights of the units for the toxic tag, its bias, and the log weights of transitions (from, to)."""

    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    #: Of the score: constant, and weights of log(1 + sum) and maximum of the marginals.
    score: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def emission(self, word: str) -> float | None:
        """The toxic tag's weight for a word of the lexicon; None for any other."""
        own = [self.weights[u] for u in units(word) if u in self.weights]
        return self.bias + sum(own) if own else None

    def document_score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        a, b, c = self.score
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * most, -500, 500)))


class Chain:
    """Forward-backward over a text that is given by its length and its lexicon words (positions, emissions)."""

    def __init__(self, field: Field):
        step = np.exp(field.transitions) * np.exp([0.0, field.bias])
        self.step, self.transition, self.start = step, np.exp(field.transitions), np.array([1.0, np.exp(field.bias)])
        self.squares = [step / step.sum()]  # the matrix of a word outside the lexicon, scaled, to the powers of two
        self.gaps: dict[int, np.ndarray] = {0: np.eye(2)}

    def gap(self, n: int) -> np.ndarray:
        """The scaled power of the matrix for n words outside the lexicon, exact for any n."""
        if n not in self.gaps:
            while len(self.squares) < n.bit_length():
                square = self.squares[-1] @ self.squares[-1]
                self.squares.append(square / square.sum())
            out = np.eye(2)
            for k in range(n.bit_length()):
                if n >> k & 1:
                    out = out @ self.squares[k]
                    out = out / out.sum()
            if len(self.gaps) > 100_000:
                self.gaps = {0: np.eye(2)}
            self.gaps[n] = out
        return self.gaps[n]

    def marginals(self, length: int, at: list[int], emissions: list[float]) -> np.ndarray:
        """P(toxic) of each lexicon word of the text."""
        emit = [np.array([1.0, np.exp(min(e, 50.0))]) for e in emissions]
        forward, now, last = [], None, -1
        for p, e in zip(at, emit, strict=True):
            if now is None:
                now = e if p == 0 else (self.start @ self.gap(p - 1)) @ self.transition * e
            else:
                now = now @ self.gap(p - last - 1) @ self.transition * e
            now = now / now.sum()
            forward.append(now)
            last = p
        out, back, after = [], None, length
        for k in range(len(at) - 1, -1, -1):
            if back is None:
                back = self.gap(length - 1 - at[k]) @ np.ones(2)
            else:
                back = self.gap(after - at[k] - 1) @ self.transition @ (emit[k + 1] * back)
            back = back / back.sum()
            both = forward[k] * back
            out.append(both[1] / both.sum())
            after = at[k]
        return np.array(out[::-1])


def _hits(words: list[str], emission: dict[str, float | None], field: Field) -> tuple[list[int], list[float]]:
    """Positions and emissions of the lexicon words; ``emission`` remembers words seen before."""
    at, found = [], []
    for i, w in enumerate(words):
        e = emission.get(w, 0)
        if e == 0:
            if len(emission) > 500_000:
                emission.clear()
            e = emission[w] = field.emission(w)
        if e is not None:
            at.append(i)
            found.append(e)
    return at, found


def _sampled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``limit`` labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # limit rows at most


def _candidates(sample: DataFrame) -> list[str]:
    """Units in at least SUPPORT toxic documents, most of them toxic; the LEXICON * 10 most frequent."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                counts[int(toxic > 0)].update({u for w in set(_WORD.findall((text or "").lower())) for u in units(w)})
            table = pd.DataFrame({"toxic": pd.Series(counts[1]), "clean": pd.Series(counts[0])}).fillna(0).astype("int64")
            yield table.rename_axis("unit").reset_index().astype({"unit": str})

    counted = sample.mapInPandas(rows, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = sample.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    # as often in a toxic as in a clean document would be a share of the toxic documents; far more is asked for
    precise = F.col("toxic") >= F.lit(max(0.5, share) * 0.8) * (F.col("toxic") + F.col("clean"))
    return [r["unit"] for r in counted.where((F.col("toxic") >= SUPPORT) & precise).orderBy(F.desc("toxic"), "unit").limit(LEXICON * 10).collect()]


def lexicon(sample: DataFrame) -> list[str]:
    """Units of toxic words, by how many different words stand before them in toxic documents and in others."""
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(_candidates(sample)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = wanted.value
        for batch in batches:
            seen: set[tuple[str, str, int]] = set()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                before = ""
                for w in _WORD.findall((text or "").lower()):
                    seen.update((u, before, int(toxic > 0)) for u in units(w) if u in known)
                    before = w
            yield pd.DataFrame(list(seen), columns=["unit", "before", "toxic"]).astype({"unit": str, "before": str, "toxic": "int64"})

    contexts = sample.mapInPandas(rows, "unit string, before string, toxic long").groupBy("unit", "before").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("both"))
    counted = contexts.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.count_if(F.col("both") == 0).alias("clean"))
    strong = counted.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    return [r["unit"] for r in strong.orderBy(F.desc("toxic"), "unit").limit(LEXICON).collect()]


def _windows(sample: DataFrame, known: list[str]) -> pd.DataFrame:
    """Per labelled document: toxic, its number of words, and positions and words of the lexicon."""
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(known))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = wanted.value
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = _WORD.findall((text or "").lower())
                at = [i for i, w in enumerate(words) if any(u in seen for u in units(w))]
                out.append((int(toxic > 0), len(words), at, [words[i] for i in at]))
            yield pd.DataFrame(out, columns=["toxic", "length", "at", "words"])

    return sample.mapInPandas(rows, "toxic int, length int, at array<int>, words array<string>").toPandas()  # LABELLED rows at most


def _train_field(docs: pd.DataFrame, known: list[str], steps: int = 150, rate: float = 0.3) -> Field:
    """Gradient ascent (Adam) on the log-likelihood of the tags of windows of 2 * RADIUS + 1 words."""
    index = {u: i for i, u in enumerate(known)}
    most = max((sum(u in index for u in units(w)) for ws in docs["words"] for w in ws), default=1)
    width, none = 2 * RADIUS + 1, len(known)
    rows, tags = [], []
    for toxic, length, at, words in docs.itertuples(index=False):
        here = dict(zip(map(int, at), words, strict=True))
        for p in [*here, length // 3] if length else ():  # each lexicon word's window, and one wherever it falls
            row = np.full((width, most), none)
            for k in range(width):
                own = [index[u] for u in units(here[p - RADIUS + k]) if u in index] if p - RADIUS + k in here else []
                row[k, : len(own)] = own
            rows.append(row)
            tags.append([int(toxic and p - RADIUS + k in here) for k in range(width)])
    if not rows:
        return Field({}, -5.0, np.zeros((2, 2)))
    x, y = np.array(rows), np.array(tags)
    w, a, state = np.zeros(none + 2), np.zeros((2, 2)), [np.zeros(none + 6) for _ in range(2)]
    w[-1] = -3.0  # the bias
    for step in range(1, steps + 1):
        emit = np.stack([np.zeros(y.shape), w[-1] + w[x].sum(2)], 2)
        unary, pair = _expectations(emit, a)
        diff = y - unary[:, :, 1]
        g_w = np.bincount(x.ravel(), np.repeat(diff.ravel(), most), none + 2)
        g_w[none], g_w[-1] = 0, diff.sum()
        g_a = np.array([[((y[:, :-1] == s) & (y[:, 1:] == t)).sum() for t in (0, 1)] for s in (0, 1)]) - pair
        grad = np.concatenate([g_w, g_a.ravel()]) / len(x) - 1e-5 * np.concatenate([w, a.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w += move[: none + 2]
        w[none] = 0
        a += move[none + 2 :].reshape(2, 2)
    return Field({u: float(w[i]) for u, i in index.items()}, float(w[-1]), a)


def _expectations(emit: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag marginals (sequence, place, tag) and summed pair marginals (tag, tag) of sequences of equal length."""
    e, t = np.exp(np.clip(emit, -50, 50)), np.exp(a)
    n, length, _ = e.shape
    forward, back = np.empty_like(e), np.empty_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, length):
        f = (forward[:, i - 1] @ t) * e[:, i]
        forward[:, i] = f / f.sum(1, keepdims=True)
    back[:, -1] = 0.5
    for i in range(length - 2, -1, -1):
        b = (e[:, i + 1] * back[:, i + 1]) @ t.T
        back[:, i] = b / b.sum(1, keepdims=True)
    unary = forward * back
    unary /= unary.sum(2, keepdims=True)
    pair = np.zeros((2, 2))
    for i in range(length - 1):
        p = forward[:, i, :, None] * t * (e[:, i + 1] * back[:, i + 1])[:, None, :]
        pair += (p / p.sum((1, 2), keepdims=True)).sum(0)
    return unary, pair


def _calibrate(field: Field, docs: pd.DataFrame) -> Field:
    """Fit the score's three numbers by regularised logistic regression on the labelled documents (Newton steps)."""
    chain, rows = Chain(field), []
    for length, at, words in zip(docs["length"], docs["at"], docs["words"], strict=True):
        p = chain.marginals(length, list(map(int, at)), [field.emission(w) for w in words]) if len(at) else np.zeros(1)
        rows.append((1.0, np.log1p(p.sum()), p.max()))
    x, y, beta = np.array(rows), docs["toxic"].to_numpy(float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        beta = beta + np.linalg.solve(hessian, x.T @ (y - p) - np.array([1e-3, 1e-2, 1e-2]) * beta)
    return Field(field.weights, field.bias, field.transitions, tuple(beta.tolist()))


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Field:
    """Learn the field and its score from labels (doc_id, toxic) of documents (doc_id, text)."""
    sample = _sampled(docs, labels, limit)
    known = lexicon(sample)
    windows = _windows(sample, known)
    if not len(windows):
        return Field({}, -5.0, np.zeros((2, 2)), (-30.0, 0.0, 0.0))
    return _calibrate(_train_field(windows, known), windows)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, and spans: start and end offset (code points), word and probability of each toxic word."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        chain, emission = Chain(model), {}
        for batch in batches:
            totals, most, spans = np.zeros(len(batch)), np.zeros(len(batch)), []
            for i, text in enumerate(batch["text"]):
                low = (text or "").lower()
                words = _WORD.findall(low)
                at, found = _hits(words, emission, model)
                if not at:
                    spans.append([])
                    continue
                p = chain.marginals(len(words), at, found)
                totals[i], most[i] = p.sum(), p.max()
                spans.append(_offsets(text, low, at, p))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.document_score(totals, most), "spans": spans})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, "doc_id long, score double, spans array<struct<start:int,end:int,word:string,probability:double>>")


def _offsets(text: str, low: str, at: list[int], p: np.ndarray) -> list[dict]:
    """Spans of the words that are toxic rather than not. Lower-casing may lengthen a text, so offsets are of the
    original text where both are equally long, and of the lower-cased one elsewhere."""
    source, wanted = text if len(text) == len(low) else low, {i: float(v) for i, v in zip(at, p, strict=True) if v >= 0.5}
    out = []
    for i, m in enumerate(_WORD.finditer(low)):
        if i in wanted:
            out.append({"start": m.start(), "end": m.end(), "word": source[m.start() : m.end()], "probability": wanted[i]})
    return out
